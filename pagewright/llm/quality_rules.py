"""Quality rules with adaptive thresholds.

Each text gives whole-number metrics.  A quantile sketch per language, source and
metric is a histogram whose bins widen with the value (six leading bits are
kept, so a quantile is right within 1/32 of its value).  Sketches merge by adding
counts, so those of a language or the whole corpus are sums of those of its
sources.  A threshold lies beyond an outer quantile by a multiple of that quantile's
distance from the median and of the mean excess over it, which is there where most
documents have a zero.  Quantiles and excess of a source are blended with those of
its language, and these with those of the corpus, by the numbers of documents seen,
so small sources lean on larger ones without a switch.  Thresholds are joined to the
documents and filter them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.plans.session import cut_lineage, table

NAME = "op1_quality_rules"

#: What parts words, and what counts as a symbol.
SPACE, NOT_SYMBOL = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW_WORDS, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20

#: Metric: the least distance from the outer quantile, and whether small values are bad as well.  Shares are in
#: thousandths (in a text of four lines one repeated line is 250), word lengths in hundredths of a character.
METRICS = {"symbols": (10, False), "capitals": (10, False), "marks": (10, False), "dup_lines": (250, False), "repeats": (100, False), "word_length": (10, True)}
#: The outer quantile in percent (on the lower side its mirror), and how many distances from the median and mean excesses lie beyond it.
OUTER, FENCE = 90, 3
#: A wider sketch counts as this many documents when it is blended with a narrower one.
PRIOR_DOCS = 200
#: Rows of thresholds up to which they are broadcast (some 200 bytes each).
BROADCAST_ROWS = 20_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "metrics")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in ``words``."""
    n = F.size(words)
    hashes = F.when(n < WINDOW_WORDS, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW_WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW_WORDS)]))
    )

    def again(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(by_hash, lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda s, p: F.struct((p + WINDOW_WORDS).alias("end"), (s["n"] + p + WINDOW_WORDS - F.greatest(p, s["end"])).alias("n")), lambda s: s["n"])

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(again(h))).otherwise(F.lit(0)))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the metrics.

    A null text has no words.  Each row's features come from its own text alone,
    so repeated rows agree and an empty table stays empty.  Columns of ``docs`` that
    bear these names give way; others may have any names and types.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.packed(docs, text=text).withColumn("words", F.filter(F.split(whole, SPACE, -1), lambda w: w != ""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = cut.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, NOT_SYMBOL, "")).cast("long"),
            "lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
            "n_repeat_words": _repeated_words(F.col("words")).cast("long"),
            "capitals": F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")),
            "marks": F.length(F.regexp_replace(whole, r"[^!?]+", "")),
        }
    )
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    share = lambda n, of: F.floor(F.lit(1000) * n / of).cast("long")
    made = counted.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * F.col("n_words"))).alias("base_failed"),
        F.struct(
            share(F.col("n_symbols"), chars).alias("symbols"),
            share(F.col("capitals"), chars).alias("capitals"),
            share(F.col("marks"), chars).alias("marks"),
            share(F.col("lines.dup"), F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_lines"),
            share(F.col("n_repeat_words"), words).alias("repeats"),
            F.floor(F.lit(100) * F.col("word_chars") / words).cast("long").alias("word_length"),
        ).alias("metrics"),
    )
    return rows.unpacked(made, docs, *FEATURES)


def sketches(featured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The quantile sketches: rows (lang, source, metric, bin, n), a bin named by its least value.

    Bins of one sketch are few, whatever the number of documents, and are
    counted before the shuffle, so a source with most rows is no larger than others.
    Null languages and sources have sketches of their own; no rows give no sketch.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("metrics")[m].alias("value")) for m in METRICS])
    own = rows.chosen(featured, lang=lang, source=source, metrics="metrics")
    flat = own.select("lang", "source", F.explode(values).alias("x"))
    lost = F.greatest(F.lit(0), F.length(F.bin("x.value")) - 6)
    kept = F.expr("shiftleft(shiftright(x.value, lost), lost)")
    return flat.withColumn("lost", lost).groupBy("lang", "source", F.col("x.metric").alias("metric"), kept.alias("bin")).agg(F.count("*").alias("n"))


#: Outer and middle quantiles, and FENCE times the mean excess over the upper and below the lower one.
QUANTILES = ("low", "middle", "high", "under", "over")


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of merged sketches and metric: its document count and quantiles."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    seen = Window.partitionBy(*by, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(seen.orderBy("bin"))).withColumn("all", F.sum("n").over(seen))
    at = {q: F.min(F.when(F.lit(100) * F.col("upto") >= F.lit(p) * F.col("all"), F.col("bin"))).over(seen) for q, p in zip(QUANTILES, (100 - OUTER, 50, OUTER), strict=False)}
    placed = ranked.withColumns(at)
    excess = lambda x: F.call_function("div", F.sum(FENCE * F.col("n") * F.greatest(x, F.lit(0))), F.max("all"))
    own = [F.max(q).alias(q) for q in at]
    return placed.groupBy(*by, "metric").agg(F.max("all").alias("docs"), *own, excess(F.col("low") - F.col("bin")).alias("under"), excess(F.col("bin") - F.col("high")).alias("over"))


def _blended(narrow: DataFrame, wide: DataFrame, on: Column) -> DataFrame:
    """``narrow`` with its quantiles drawn towards those of ``wide``, less so the more documents it has."""
    wide = wide.select(F.col("metric").alias("_metric"), *[F.col(c).alias(f"_{c}") for c in wide.columns if c in ("lang", *QUANTILES)])
    both = narrow.join(wide, (F.col("metric") == F.col("_metric")) & on)
    prior = F.lit(PRIOR_DOCS).cast("long")
    mean = lambda q: F.call_function("div", F.col("docs") * F.col(q) + prior * F.col(f"_{q}"), F.col("docs") + prior)
    return both.select(*[mean(c).alias(c) if c in QUANTILES else F.col(c) for c in narrow.columns])


def thresholds(sketch: DataFrame) -> DataFrame:
    """Rows (lang, source, bounds) for each pair: bounds has a struct (low, high) per metric."""
    own, language, every = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"]), _quantiles(sketch, [])
    blended = _blended(own, _blended(language, every, F.lit(True)), F.col("lang").eqNullSafe(F.col("_lang")))
    slack = reduce(lambda c, m: F.when(F.col("metric") == m, METRICS[m][0]).otherwise(c), METRICS, F.lit(None).cast("int"))
    low = F.col("low") - F.greatest(F.lit(FENCE) * (F.col("middle") - F.col("low")) + F.col("under"), slack)
    high = F.col("high") + F.greatest(F.lit(FENCE) * (F.col("high") - F.col("middle")) + F.col("over"), slack)
    each = [F.max(F.when(F.col("metric") == m, F.struct(low.alias("low"), high.alias("high")))).alias(m) for m in METRICS]
    return blended.groupBy("lang", "source").agg(*each).select("lang", "source", F.struct(*METRICS).alias("bounds"))


def verdicts(featured: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``featured`` with failed (names of the metrics out of bounds) and kept; columns of these names give way.

    ``bounds`` has a row for each language and source that occurs, null ones
    included; a row without bounds fails by the base rule alone.  ``bounds`` is
    broadcast if it has few rows; else the join is a shuffle whose large
    partitions can be split.
    """
    bounds = cut_lineage(bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "bounds"))
    if bounds.count() <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    own = rows.packed(featured, lang=lang, source=source, metrics="metrics", base_failed="base_failed")
    joined = own.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = []
    for m, (_, both) in METRICS.items():
        bad = F.col("metrics")[m] > F.col("bounds")[m]["high"]
        if both:
            bad = bad | (F.col("metrics")[m] < F.col("bounds")[m]["low"])
        out.append(F.when(bad, m))
    judged = joined.withColumn("failed", F.filter(F.array(*out), lambda x: x.isNotNull()))
    return rows.unpacked(judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)), featured, "failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, as they are; columns may have any names and types.

    Texts are read twice, once for the sketches and once for the verdicts, so that
    no text is shuffled or written on the way.  Null languages and sources are
    groups of their own, null and empty texts are rejected, repeated rows get one
    verdict, texts may be of any length, and an empty table stays empty.
    """
    own = rows.packed(docs, text=text, lang=lang, source=source)
    bounds = thresholds(sketches(with_features(own.select("text", "lang", "source"))))
    judged = verdicts(with_features(own), bounds)
    # a generator, not a filter: a filter would be pushed down and repeat every expression it rests on
    return rows.unpacked(judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    featured = cut_lineage(with_features(docs).drop("text"))
    judged = verdicts(featured, thresholds(sketches(featured)))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, F.array_join("failed", ",").alias("failed"))


def _oracle() -> str:
    bins = "greatest(0, length(bin(value)) - 6)"
    slack = " ".join(f"WHEN '{m}' THEN {x[0]}" for m, x in METRICS.items())

    def level(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        part = f"PARTITION BY {keys}metric"
        quantiles = ", ".join(f"min(bin) FILTER (WHERE 100 * upto >= {p} * total) OVER ({part}) AS {q}" for q, p in zip(QUANTILES, (100 - OUTER, 50, OUTER), strict=False))
        return f"""{name}_m AS (SELECT {keys}metric, bin, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS total FROM {name}_m),
{name}_q AS (SELECT *, {quantiles} FROM {name}_r),
{name} AS (SELECT {keys}metric, max(total) AS docs, max(low) AS low, max(middle) AS middle, max(high) AS high,
  sum({FENCE} * n * greatest(low - bin, 0)) // max(total) AS under, sum({FENCE} * n * greatest(bin - high, 0)) // max(total) AS over FROM {name}_q GROUP BY ALL)"""

    def blend(narrow: str, wide: str) -> str:
        return ", ".join(f"({narrow}.docs * {narrow}.{q} + {PRIOR_DOCS} * {wide}.{q}) // ({narrow}.docs + {PRIOR_DOCS}) AS {q}" for q in QUANTILES)

    metrics = ", ".join(f"('{m}', {m})" for m in METRICS)
    failed = ", ".join(f"max(metric) FILTER (WHERE metric = '{m}' AND bad)" for m in METRICS)
    both = " OR ".join(f"(l.metric = '{m}' AND value < low - greatest({FENCE} * (middle - low) + under, slack))" for m, x in METRICS.items() if x[1])
    return rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM grams WHERE times > 1) GROUP BY doc_id),
base AS (SELECT cut.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS caps, length(regexp_replace(t, '[^!?]+', '', 'g')) AS mks
  FROM cut LEFT JOIN rep USING (doc_id)),
feat AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * caps // greatest(word_chars, 1) AS capitals, 1000 * mks // greatest(word_chars, 1) AS marks,
  1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_length FROM base),
long AS (SELECT doc_id, lang, source, metric, CAST(value AS BIGINT) AS value FROM feat, LATERAL (VALUES {metrics}) v(metric, value)),
sketch AS (SELECT lang, source, metric, (value >> {bins}) << {bins} AS bin, count(*) AS n FROM long GROUP BY ALL),
{level("own", "lang, source")},
{level("lng", "lang")},
{level("tot", "")},
lngb AS (SELECT lng.lang, lng.metric, {blend("lng", "tot")} FROM lng JOIN tot USING (metric)),
fenced AS (SELECT own.lang, own.source, own.metric, {blend("own", "lngb")}, CASE own.metric {slack} END AS slack
  FROM own JOIN lngb ON own.lang IS NOT DISTINCT FROM lngb.lang AND own.metric = lngb.metric),
judged AS (SELECT l.doc_id, l.metric, (value > high + greatest({FENCE} * (high - middle) + over, slack) OR {both}) AS bad FROM long l JOIN fenced f
  ON l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND l.metric = f.metric),
out AS (SELECT doc_id, concat_ws(',', {failed}) AS failed FROM judged GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed = '') AS kept, failed
FROM feat JOIN out USING (doc_id)
"""


ORACLE_SQL = _oracle()
