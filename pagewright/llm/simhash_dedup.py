"""SimHash near duplicates by deletion variants of two segments.

A 64-bit fingerprint is cut into two segments of 32 bits.  Of two fingerprints
that differ in two bits at most, one segment is equal, or both differ in one
bit.  So the index holds each segment as it is, and one variant of the upper
segment for each bit that is taken out.  To keep buckets small where many
fingerprints share a segment, a key also names an equal part of the other
segment: of the two bits that may still differ there, one of three parts stays
untouched; of one bit, one of two halves.  An equality join of keys gives the
candidates, each of which is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.arrow import byte_texts, pieces
from pagewright.llm.graph import components
from pagewright.plans.session import cut_lineage, table

NAME = "op10_simhash_dedup"
ORACLE_SQL = None

#: Fixed values of the shingle hash.
SEED, SHINGLE_WORDS, MOST_BITS = 42, 3, 2
#: Fingerprints with at least so many copies are joined by broadcast; so are at most MOST_HOT of them, as a hot one
#: has at least one in MOST_HOT of all rows.
HOT_COPIES, MOST_HOT = 1_000, 50_000
#: Rows (key, hash) up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 500_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit number; zero without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return int(np.uint64(digest(line, SEED)).view(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: n - 1].tolist()]
    hashes = np.fromiter([digest(line[i:j], SEED) for i, j in zip(begins, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(majority, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, fp, h) per row of ``docs``, h a hash that tells texts of equal keys apart.

    A null or empty text has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                fps = [fingerprint(x) for x in byte_texts(batch.column("text"))]
                yield pa.record_batch([batch.column("key"), pa.array(fps, pa.int64()), batch.column("h")], ["key", "fp", "h"])

    own = rows.chosen(docs, key=key, text=text).withColumn("h", F.xxhash64("text"))
    return own.mapInArrow(run, rows.schema(("key", rows.kind(docs, key)), ("fp", "bigint"), ("h", "bigint")))


def _bits(x: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def _entry(kind: int, segment: Column, part: Column, taken: Column) -> Column:
    key = F.lit(kind << 48).bitwiseOR(F.shiftleft(segment, 16)).bitwiseOR(part)
    return F.struct(key.alias("key"), taken.alias("taken"))


def index(fps: DataFrame) -> DataFrame:
    """Rows (fp, key, taken) for each distinct ``fp``; taken is the bit taken out, null in a whole segment."""
    high, low = _bits(F.col("fp"), 32, 32), _bits(F.col("fp"), 0, 32)
    parts = ((0, 11), (11, 11), (22, 10))
    none = F.lit(None).cast("long")
    entries = [_entry(i, high, _bits(low, *p), none) for i, p in enumerate(parts)]
    entries += [_entry(3 + i, low, _bits(high, *p), none) for i, p in enumerate(parts)]
    for i in range(32):
        cut = high.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i)))
        entries += [_entry(6 + 2 * i + h, cut, _bits(low, 16 * h, 16), _bits(high, i, 1)) for h in (0, 1)]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.key", "e.taken")


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``fps`` that differ in ``most`` bits at most, each once.

    ``most`` may be 0 to 2: the index finds pairs up to two bits apart.
    """
    if not 0 <= most <= 2:
        raise ValueError("the index finds pairs of up to two differing bits")
    entries = index(fps)
    left = entries.where("taken is null or taken = 0").select("key", F.col("fp").alias("a"), F.col("taken").alias("s"))
    right = entries.where("taken is null or taken = 1").select("key", F.col("fp").alias("b"), F.col("taken").alias("t"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    side = (F.col("s").isNull() & (F.col("a") < F.col("b"))) | (F.col("s") == 0)
    found = left.join(right, "key").where(side & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, fp, h, root, component_id) per row of ``docs``; root is the component's smallest fingerprint.

    A fingerprint that many rows share is never gathered: its component is sent to where its rows are.
    """
    fps = cut_lineage(fingerprints(docs, key, text))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("copies")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    grouped = distinct.join(roots, "fp").select("fp", "root", "least")
    ids = grouped.groupBy("root").agg(F.min("least").alias("id"))
    linked = grouped.join(ids, "root").select("fp", "root", "id")
    alone = distinct.join(linked, "fp", "left")
    named = cut_lineage(alone.select("fp", "copies", F.coalesce("root", "fp").alias("root"), F.coalesce("id", "least").alias("component_id")))
    count = distinct.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") >= max(HOT_COPIES, -(-count // MOST_HOT))
    hot = named.where(is_hot).drop("copies")
    many = fps.join(F.broadcast(hot), "fp")
    few = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named.where(~is_hot).drop("copies"), "fp")
    return many.unionByName(few)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, fp, component_id) per row of ``docs``.

    component_id is the smallest key that links reach, itself included.
    Repeated rows share a fingerprint and so a component; texts without words
    (null, empty) all have fingerprint zero.  Null keys take part but never name a
    component (it is null where no other key is there).  A text is one row of a
    task, however long.  An empty table gives no rows; other columns of ``docs``
    are not read and may have any names and types.
    """
    return _members(docs, key, text).select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near duplicates: one row of each component stays, that with its smallest key.

    Of several rows with that key, that whose text has the smallest hash stays, and
    of rows that repeat key and text, that with the smallest other columns (as
    JSON).  A row with a null key stays only if its component has no other key;
    null, empty and blank texts are one component.  Rows of different components
    never meet, whatever their keys.  An empty table stays empty; columns may have
    any names and types.

    Representatives are picked on rows (key, hash), so no text is moved for that.
    The rows that go are then taken out of ``docs`` where they are, if they are few
    enough to be broadcast; else by one shuffle whose large partitions can be split.
    """
    members = cut_lineage(_members(docs, key, text).select("key", "h", "root", "component_id"))
    heads = members.where(F.col("key").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("root").agg(F.min("component_id").alias("key"), F.min("h").alias("h")).select("key", "h", F.lit(True).alias("stays"))
    counts = members.groupBy("key", "h").agg(F.count("*").alias("n"))
    judged = _joined(counts, heads, "left").select("key", "h", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    out_of_place = cut_lineage(judged.where("not stays or n > 1"))
    repeated = out_of_place.where("stays")
    own = rows.packed(docs, key=key, text=text).select("row", "key", F.xxhash64("text").alias("h"))
    kept = _joined(own, _small(out_of_place.select("key", "h")), "left_anti").select("row")
    if not repeated.isEmpty():
        again = _joined(own, _small(repeated.select("key", "h")), "left_semi")
        kept = kept.unionByName(again.groupBy("key", "h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return rows.unpacked(kept, docs)


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on key and hash, null keys among themselves."""
    right = right.withColumnsRenamed({"key": "_key", "h": "_h"})
    return left.join(right, F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")), how)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
