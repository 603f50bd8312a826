"""Technology detection: evidence against weighted signals, confidence and version per rule.

Signals are a bounded relation: each becomes an expression over the items of its
vector, whose pattern is compiled once.  Over pages it looks inside the arrays of
items and only first hits become rows; evidence that is rows already is tried row by
row.  A relation beyond that bound meets the evidence by a join on the vector.
Aggregations follow: the first page per signal, then the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import html as H
from pagewright.functions.columns import record
from pagewright.plans.session import cut_lineage

#: Fixed values.
DETECTED, PROBABLE = 0.75, 0.5
MOST_PAGES, MOST_SIGNALS, EVIDENCE_CHARS = 100, 20, 256
#: Signals up to which each is an expression of its own, and up to which the relation is broadcast (some 200 bytes each).
LITERAL_SIGNALS, BROADCAST_SIGNALS = 1_000, 50_000
VERSION = r"^\d+(?:\.\d+){0,3}(?:[-+][0-9A-Za-z.-]+)?$"


def _vectors(columns: list[str]) -> dict[str, Column]:
    """The items of each vector of a page with html, as arrays of strings."""
    none = F.array().cast("array<string>")
    snip = H.snippet(F.col("html"))
    joined = lambda m, sep: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(sep), e["value"]))
    return {
        "meta": joined(H.meta_tags(F.col("html")), "="),
        "scriptSrc": H.script_sources(F.col("html")),
        "htmlRegex": F.filter(F.array(snip), lambda s: s != ""),
        "cssClasses": H.css_classes(snip),
        "networkRequests": H.network_urls(snip),
        "headers": joined(F.col("headers"), ":") if "headers" in columns else none,
        "jsGlobals": F.map_keys(F.map_filter("js_globals", lambda _, v: v)) if "js_globals" in columns else none,
        "cookies": F.col("cookies") if "cookies" in columns else none,
        "domElements": F.col("markers") if "markers" in columns else none,
    }


def evidence(pages: DataFrame) -> DataFrame:
    """Rows (scan_id, page_seq, page_url, vector, pos, value) from pages with html and optional observed columns.

    ``headers`` and ``js_globals`` are maps, ``cookies`` and ``markers`` arrays;
    where the table has none of them these vectors are empty.
    """
    item = lambda name: lambda x, i: record(vector=F.lit(name), pos=i, value=x)
    items = F.flatten(F.array(*[F.transform(v, item(name)) for name, v in _vectors(pages.columns).items()]))
    rows = pages.select("scan_id", "page_seq", "page_url", items.alias("items"))
    return rows.select("scan_id", "page_seq", "page_url", F.explode("items").alias("i")).select("scan_id", "page_seq", "page_url", "i.*")


def matches(mode: Column, pattern: Column, value: Column) -> Column:
    """Whether an item of evidence matches a signal; names are compared, values never."""
    name = lambda sep: F.lower(F.trim(F.substring_index(value, sep, 1)))
    return (
        F.when(mode == "regex", F.regexp_like(value, F.concat(F.lit("(?i)"), pattern)))
        .when(mode == "header", name(":") == F.lower(pattern))
        .when(mode == "cookie", F.startswith(F.lower(value), F.lower(pattern)))
        .when(mode == "metaKey", F.contains(value, F.lit("=")) & (name("=") == F.lower(pattern)))
        .when(mode == "global", value == pattern)
        .when(mode == "marker", F.lower(value) == F.lower(pattern))
        .otherwise(False)
    )


def extract_version(value: Column, pattern: Column) -> Column:
    """The named group of ``pattern`` in ``value`` if it looks like a version."""
    found = F.when(F.contains(pattern, F.lit("(?<version>")), F.call_function("regexp_extract", value, F.concat(F.lit("(?i)"), pattern), F.lit(1)))
    return F.when(found.rlike(VERSION) & (F.length(found) <= 32), found)


def truncated(value: Column) -> Column:
    return F.when(F.length(value) > EVIDENCE_CHARS, F.concat(F.substring(value, 1, EVIDENCE_CHARS), F.lit("..."))).otherwise(value)


def confidence(weights: Column) -> Column:
    """One minus the product of what each weight leaves, to six places."""
    left = F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))))
    return F.round(1 - left, 6)


def status(score: Column) -> Column:
    return F.when(score >= DETECTED, "detected").when(score >= PROBABLE, "probable").otherwise("unknown")


def hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` of evidence with the columns of each signal that they match."""
    count = rules.count()
    if count > LITERAL_SIGNALS:
        signals = F.broadcast(rules) if count <= BROADCAST_SIGNALS else rules
        return rows.join(signals, "vector").where(matches(F.col("mode"), F.col("pattern"), F.col("value")))
    known, numbered = _numbered(rules)
    by_vector: dict[str, list[Column]] = {}
    for number, signal in enumerate(known):
        test = matches(F.lit(signal["mode"]), F.lit(signal["pattern"]), F.col("value"))
        by_vector.setdefault(signal["vector"], []).append(F.when(test, number))
    found = F.array().cast("array<int>")
    for vector, tests in by_vector.items():
        found = F.when(F.col("vector") == vector, F.array_compact(F.array(*tests))).otherwise(found)
    return rows.select("*", F.explode(found).alias("_signal")).join(F.broadcast(numbered.drop("vector")), "_signal").drop("_signal")


def _numbered(rules: DataFrame) -> tuple[list[dict], DataFrame]:
    """The signals, and their table with their numbers."""
    known = [x.asDict() for x in rules.collect()]
    kind = T.StructType([T.StructField("_signal", T.IntegerType()), *rules.schema.fields])
    return known, rules.sparkSession.createDataFrame([(i, *x.values()) for i, x in enumerate(known)], kind)


def page_hits(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The first item of each page that matches a signal, with the columns of the signal; vectors that no signal asks for are not read."""
    known, numbered = _numbered(rules)
    vectors = {name: v for name, v in _vectors(pages.columns).items() if any(s["vector"] == name for s in known)}
    rows = pages.select("scan_id", "page_seq", "page_url", *[v.alias(f"_{name}") for name, v in vectors.items()])

    def first(number: int, signal: dict) -> Column:
        test = lambda x: matches(F.lit(signal["mode"]), F.lit(signal["pattern"]), x)
        value = F.get(F.filter(f"_{signal['vector']}", test), F.lit(0))
        return F.when(value.isNotNull(), record(_signal=F.lit(number), value=value))

    found = F.array_compact(F.array(*[first(i, s) for i, s in enumerate(known) if s["vector"] in vectors]))
    hit = rows.select("scan_id", "page_seq", "page_url", F.explode(found).alias("h")).select("scan_id", "page_seq", "page_url", "h.*")
    return hit.join(F.broadcast(numbered), "_signal").drop("_signal")


def detect_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """What ``detect`` gives for the evidence of ``pages``; with few signals items of evidence never become rows."""
    if not 0 < rules.count() <= LITERAL_SIGNALS:
        return detect(evidence(pages), rules)
    return _reported(cut_lineage(page_hits(pages, rules)))  # hits are few, and two aggregations need them


def detect(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per scan and rule that is reported.

    Of a signal the first page, and on it the first item, gives evidence and
    version.  A rule keeps its first 20 signals and 100 pages in order.
    """
    hit = hits(rows, rules)
    return _reported(hit.groupBy("scan_id", "rule_id", "name", "category", "signal_seq", "vector", "weight", "version_regex", "version_kind", "page_seq", "page_url").agg(F.min_by("value", "pos").alias("value")))


def _reported(first: DataFrame) -> DataFrame:
    """The report from the first hit of each page and signal."""
    key = ["scan_id", "rule_id", "signal_seq"]
    own = F.struct("page_seq", "value")
    signal = first.groupBy(*key, "name", "category", "vector", "weight", "version_regex", "version_kind").agg(F.min(own).alias("f"))
    versioned = signal.select("*", extract_version(F.col("f.value"), F.col("version_regex")).alias("version"), truncated(F.col("f.value")).alias("evidence"))
    order = F.struct(F.col("f.page_seq").alias("page_seq"), "signal_seq")
    rank = F.when(F.col("version").isNull(), 0).when(F.col("version_kind") == "exact", 2).otherwise(1)
    packed = F.struct(order.alias("o"), "vector", "evidence", "weight")
    by_rule = versioned.groupBy("scan_id", "rule_id", "name", "category").agg(
        F.array_sort(F.collect_list(packed)).alias("signals"),  # as many as the rule has signals
        F.min(F.struct((-rank).alias("r"), order.alias("o"), "version")).alias("best"),
    )
    seen = first.groupBy("scan_id", "rule_id", "page_seq", "page_url").agg(F.count("*").alias("n")).groupBy("scan_id", "rule_id").agg(F.count("*").alias("n_pages"), F.min_by("page_url", "page_seq").alias("first_page"))
    out = by_rule.join(seen, ["scan_id", "rule_id"])
    scored = out.withColumn("confidence", confidence(F.transform("signals", lambda s: s["weight"])))
    named = scored.withColumn("confidence_status", status(F.col("confidence"))).where("confidence_status <> 'unknown'")
    version_status = F.when(F.col("best.r") == -2, "exact").when(F.col("best.r") == -1, "major_only").otherwise("unavailable")
    return named.select(
        "scan_id",
        F.col("rule_id").alias("technology_id"),
        "name",
        "category",
        "confidence",
        "confidence_status",
        F.col("best.version").alias("version"),
        version_status.alias("version_status"),
        F.slice(F.transform("signals", lambda s: s["vector"]), 1, MOST_SIGNALS).alias("vectors"),
        F.least("n_pages", F.lit(MOST_PAGES)).alias("n_pages"),
        "first_page",
        limitation(F.col("name"), F.col("confidence_status"), version_status).alias("limitation"),
    )


def limitation(name: Column, state: Column, version_status: Column) -> Column:
    """Notes on what is uncertain; null if nothing is."""
    notes = F.concat_ws(
        " ",
        F.when(state == "probable", F.concat(name, F.lit(" was identified with partial confidence from the available signals."))),
        F.when(version_status == "unavailable", "A reliable version could not be extracted from the captured evidence.").when(version_status == "major_only", "Only the major version could be determined."),
    )
    return F.nullif(notes, F.lit(""))
