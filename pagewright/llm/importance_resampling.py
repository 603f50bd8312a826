"""Importance resampling towards a target: hashed n-grams, bucket gains, a Gumbel draw.

Each partition of Spark has a DuckDB of its own, which splits texts into words by
SQL, makes runs of words by windows, hashes them with zlib's CRC as a registered
function and counts buckets.  Spark writes these counts as Parquet in the shared
folder, merges them over all rows, scores each row by the gains of its buckets and
draws the rows with the highest perturbed scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.arrow import pieces
from pagewright.operators.site import numbered
from pagewright.plans.session import saved, table

NAME = "op11_importance_resampling"

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: What a word is, after A-Z have been lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Texts that one statement takes at once, and what DuckDB may hold.
BATCH_BYTES, MEMORY = 4 << 20, "600MB"


def _crc(texts: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in texts.cast(pa.large_binary()).to_pylist()], pa.int64())


def counting_sql(most_words: int, buckets: int) -> str:
    """DuckDB SQL over ``texts`` (nr, text): rows (nr, n_words, n_features, counts), one for each text, in order."""
    runs = ["SELECT nr, word AS feature FROM words"]
    for n in range(2, most_words + 1):
        run = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER run" for i in range(1, n))])
        runs.append(f"SELECT nr, feature FROM (SELECT nr, {run} AS feature FROM words WINDOW run AS (PARTITION BY nr ORDER BY place)) WHERE feature IS NOT NULL")
    return f"""
        WITH split AS MATERIALIZED (SELECT nr, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) AS found FROM texts),
        words AS (SELECT nr, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM split),
        counted AS MATERIALIZED (SELECT nr, feature, count(*) AS n FROM ({" UNION ALL ".join(runs)}) GROUP BY nr, feature),
        known AS MATERIALIZED (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
        summed AS (SELECT nr, CAST(bucket AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN known USING (feature) GROUP BY nr, bucket),
        listed AS (SELECT nr, CAST(sum(n) AS BIGINT) AS n_features, list(struct_pack(bucket := bucket, n := n) ORDER BY bucket) AS counts FROM summed GROUP BY nr)
        SELECT nr, CAST(len(found) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(counts, []) AS counts
        FROM split LEFT JOIN listed USING (nr) ORDER BY nr"""


def bucket_counts(docs: DataFrame, keep: list[str], text: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Rows (k0, k1 ... for ``keep``, n_words, n_features, counts) for every row; counts holds (bucket, n) pairs.

    Features are all runs of up to ``most_words`` words of the whole text; null and
    empty texts have none.  A text is held whole by the task that counts it, its
    counts are ``buckets`` pairs at most.
    """
    inner = {f"k{i}": c for i, c in enumerate(keep)}
    sql = counting_sql(most_words, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as own:
            own.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for whole in batches:
                for batch in pieces(whole, "text", BATCH_BYTES):
                    texts = pa.table({"nr": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column("text")})
                    own.register("texts", texts)
                    made = own.sql(sql).to_arrow_table().combine_chunks()
                    own.unregister("texts")
                    new = [made.column(c).combine_chunks() for c in ("n_words", "n_features", "counts")]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), *new], [*inner, "n_words", "n_features", "counts"])

    made = rows.schema(*((c, rows.kind(docs, k)) for c, k in inner.items()), ("n_words", "bigint"), ("n_features", "bigint"), ("counts", "array<struct<bucket:int,n:bigint>>"))
    return rows.chosen(docs, **inner, text=text).mapInArrow(run, made)


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket a thousand times the log ratio of its smoothed share in the target's counts over that in ``raw``'s.

    Counts are merged by Spark; what reaches the driver is a pair of sums for each bucket.
    """
    sides = [counted.select(F.lit(i).alias("side"), F.inline("counts")) for i, counted in enumerate((raw, target))]
    sums = [F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in (0, 1)]
    found = {r["bucket"]: (r["n0"], r["n1"]) for r in sides[0].unionByName(sides[1]).groupBy("bucket").agg(*sums).collect()}
    all_raw, all_target = (sum(x[i] for x in found.values()) for i in (0, 1))
    shares = (found.get(b, (0, 0)) for b in range(buckets))
    return [math.floor(1000 * math.log(float(t + 1) * float(all_raw + buckets) / (float(s + 1) * float(all_target + buckets)))) for s, t in shares]


def resample(docs: DataFrame, target: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` with n_features, weight, score and rank.

    Of the N rows with ``least_words`` words or more, the ``percent`` hundredths
    with the highest scores are drawn and ranked from 1; other ranks are null.  Ties
    go by ``key`` (null first), then weight and number of features.  Null and empty
    texts have no features and weight 0; a null key is hashed as an empty text;
    repeated rows are rows of their own with equal scores; an empty table gives no
    rows, and an empty target smooths to equal shares.  Other columns are not read
    and may have any names.
    """
    counted = saved(bucket_counts(docs, [key, *keep], text, most_words, buckets), "buckets")
    wanted = saved(bucket_counts(target, [], text, most_words, buckets), "target")
    gains = F.split(F.lit(",".join(map(str, bucket_gains(counted, wanted, buckets)))), ",").cast("array<bigint>")
    weight = F.aggregate("counts", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"] * F.get(gains, x["bucket"]))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k0").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    kept = [f"k{i}" for i in range(len(keep) + 1)]
    weighted = counted.select(*kept, "n_words", "n_features", weight.alias("weight"), noise.alias("noise"))
    scored = saved(weighted.select(*kept, "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")), "scores")
    wide = F.col("n_words") >= least_words
    able, rest = scored.where(wide), scored.where(~wide).withColumn("rank", F.lit(None).cast("bigint"))
    drawn = able.count() * percent // 100
    ranked = numbered(able.withColumn("low", -F.col("score")), [], ["low", "k0", "weight", "n_features"], "rank").drop("low")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")))
    made = ["n_features", "weight", "score", "rank"]
    return ranked.unionByName(rest).select(*kept[1:], *made).toDF(*keep, *made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


#: CRC-32 is computed for each distinct word, byte by byte, from its table of 256 values.
ORACLE_SQL = rf"""
WITH table_ AS (
  SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
split AS (
  SELECT 0 AS side, doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS found FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '{WORD}') FROM benchmark),
counted AS (
  SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(found) AS word FROM split) GROUP BY side, doc_id, word),
bytes AS (
  SELECT word, list_transform(range(1, len(h), 2), lambda i: CAST((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted))),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) % {BUCKETS} AS bucket
  FROM bytes, table_),
sums AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + {BUCKETS} AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(t_all + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM sums, totals),
weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""
