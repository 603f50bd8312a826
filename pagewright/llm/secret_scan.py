"""Secret scanning with corpus-wide ownership frequency.

Patterns give spans in each text.  Beside the named kinds, any long mixed token
is a candidate.  Hashes of all values are counted over the whole corpus by
distinct repositories and owners: a value that several owners hold, or that two
hold in many repositories, is an example that people copy; a value of one owner
looks live, in however many repositories.  Live-looking candidates become spans of
their own; spans of the named kinds stay whatever their frequency.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.plans.session import cut_lineage, saved, table

NAME = "op9_secret_scan"

#: The patterns of each kind, the group that holds the secret, and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: What a candidate looks like: a long token with both cases and three digits, without a longer run of small letters, as words have.
CANDIDATE = ("owned", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
MIXED, WORDY = ("[a-z]", "[A-Z]", "[0-9].*[0-9].*[0-9]"), "[a-z]{7,}"
#: A value in this many distinct owners' texts or more is a copied example; so is one of fewer, but several, in this many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Rows of lists of copied values up to which they are broadcast (at some 100 bytes each).
BROADCAST_ROWS = 100_000

SPAN = "array<struct<kind:string,rank:int,begin:bigint,end:bigint,hash:bigint>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of leftmost non-overlapping matches whose secret has ``least`` characters.

    A match begins where the texts between matches, and the matches before it, end.
    """
    quick = _quick(pattern, group, least)
    pattern = pattern if group else quick
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.arrays_zip(whole.alias("w"), values.alias("v")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("value")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))

    def add(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        end = begin + m["size"]
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), begin.alias("begin"), end.alias("end"), F.xxhash64(m["value"]).alias("hash"))
        kept = F.when(F.length(m["value"]) >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    return F.when(F.regexp_like(text, F.lit(quick)), F.aggregate(parts, start, add, lambda s: s["found"])).otherwise(F.array().cast(SPAN))


def _quick(pattern: str, group: int, least: int) -> str:
    """What any text with a long enough match contains; the texts it lets through are searched in full.

    Without a group a kind is a run of characters, and to ask for its least
    length in the pattern gives the same matches as to drop the short ones.
    """
    if group:
        return r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    head, plus, _ = pattern.rpartition("+")
    return f"{head}{{{least - (4 if head.startswith('AKIA') else 0)},}}" if plus and "{" not in pattern else pattern


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans (the named kinds) and candidates, both ordered by begin, then kind.

    Null and empty texts have none; a text of any length is searched whole.  Offsets
    are code points, ends exclusive.  A row's spans come from its own text alone, so
    repeated rows agree and an empty table stays empty.  Columns of ``docs`` that
    bear these two names give way; others may have any names and types.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    base = [_spans(whole, i, *k) for i, k in enumerate(KINDS)]
    named, pattern, _, least = CANDIDATE
    found = rows.packed(docs, text=text).withColumn("base", F.concat(*base)).withColumn("tokens", _spans(whole, len(KINDS), named, pattern, 0, least))
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, _sortable)), lambda s: s["span"])
    span_text = lambda s: F.substring(whole, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))
    mixed = lambda s: reduce(lambda c, x: c & span_text(s).rlike(x), MIXED, ~span_text(s).rlike(WORDY))
    apart = lambda s: ~F.exists("base_spans", lambda b: (b["begin"] < s["end"]) & (s["begin"] < b["end"]))
    ordered = found.withColumn("base_spans", order("base")).withColumn("candidates", F.filter(F.col("tokens"), lambda s: mixed(s) & apart(s)))
    return rows.unpacked(ordered, docs, "base_spans", "candidates")


def _sortable(s: Column) -> Column:
    return F.struct(s["begin"].alias("begin"), s["rank"].alias("rank"), s.alias("span"))


def _values() -> Column:
    return F.array_distinct(F.transform(F.concat("base_spans", "candidates"), lambda s: s["hash"]))


def ownership(scanned: DataFrame, repository: str, owner: str) -> DataFrame:
    """Rows (hash, n_repositories, n_owners) over all spans and candidates of the corpus.

    A row with a null repository is a repository of its own; a null owner is one
    owner.  Counts are made per repository first, then per owner, so a value that
    everyone holds is not counted in one task.
    """
    own = rows.chosen(scanned, repository=repository, owner=owner, base_spans="base_spans", candidates="candidates")
    held = own.select("repository", "owner", F.explode(_values()).alias("hash")).groupBy("repository", "owner", "hash").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.sum(F.when(F.col("repository").isNull(), F.col("n")).otherwise(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def is_example(owners: Column, repositories: Column) -> Column:
    """Whether a value of so many owners and repositories is a widely copied example."""
    return (owners >= EXAMPLE_OWNERS) | ((owners > 1) & (repositories >= EXAMPLE_REPOSITORIES))


def with_verdicts(scanned: DataFrame, key: str, owner: str) -> DataFrame:
    """``scanned`` with spans (base spans and live-looking candidates) and n_examples (spans of copied values).

    ``key`` names the repository.  Which values are copied is told to the rows by
    the list of values that a row has, whatever its key: by broadcast if there are
    few lists with a copied value, else by a shuffle whose large partitions can be
    split.  Columns of ``scanned`` named spans or n_examples give way.
    """
    counted = ownership(scanned, key, owner)
    copied = counted.where(is_example(F.col("n_owners"), F.col("n_repositories"))).select("hash")
    own = rows.packed(scanned, base_spans="base_spans", candidates="candidates").withColumn("values", _values())
    lists = own.where(F.size("values") > 0).select("values").distinct()
    found = lists.select("values", F.explode("values").alias("hash")).join(copied, "hash")
    per_list = cut_lineage(found.groupBy("values").agg(F.collect_set("hash").alias("copied")))
    if per_list.count() <= BROADCAST_ROWS:
        per_list = F.broadcast(per_list)
    joined = own.join(per_list, "values", "left")
    is_copied = lambda s: F.coalesce(F.array_contains("copied", s["hash"]), F.lit(False))
    live = F.filter("candidates", lambda s: ~is_copied(s))
    every = F.transform(F.array_sort(F.transform(F.concat("base_spans", live), _sortable)), lambda s: s["span"])
    told = joined.withColumn("spans", every)
    return rows.unpacked(told.withColumn("n_examples", F.size(F.filter("spans", is_copied)).cast("long")), scanned, "spans", "n_examples")


def shown(spans: str | Column) -> Column:
    """``kind:begin:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text", mark: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """``docs`` with every span of ``with_verdicts`` in ``text`` replaced by ``mark``; other rows are left as they are.

    Overlapping spans are replaced as one.  Column ``length``, if named, becomes
    the number of characters of texts that have changed.  Texts are searched once:
    rows are written with their spans to the shared folder, ownership is counted on
    the spans there, and no text is shuffled while few lists of values are copied.
    Columns may have any names and types; null and empty texts have no spans,
    repeated rows stay, and an empty table stays empty.
    """
    spans = find_spans(rows.packed(docs, text=text, key=key, owner=owner))
    scanned = saved(spans.select("row", "key", "owner", "base_spans", "candidates"), "spans")
    found = with_verdicts(scanned, "key", "owner")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    whole = F.col(f"row.c{rows.place(docs, text)}")

    def cut(state: Column, s: Column) -> Column:
        gap = F.substring(whole, (state["at"] + 1).cast("int"), F.greatest(F.lit(0), (s["begin"] - state["at"]).cast("int")))
        joined = F.when(s["begin"] < state["at"], state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), joined.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(whole, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    changed = {text: F.when(F.size("spans") > 0, F.aggregate("spans", start, cut, rest)).otherwise(whole)}
    out = found.withColumn("clean", changed[text])
    changed[text] = F.col("clean")
    if length is not None:
        own = F.col(f"row.c{rows.place(docs, length)}")
        changed[length] = F.when(F.size("spans") > 0, F.length("clean").cast(rows.kind(docs, length))).otherwise(own)
    return rows.unpacked(out, docs, **changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scanned = cut_lineage(find_spans(docs).select("doc_id", "source", "base_spans", "candidates"))
    found = with_verdicts(scanned, "doc_id", "source")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k[0]).alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(shown("base_spans"), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
        "n_examples",
    )


def _oracle() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate((*KINDS, CANDIDATE)):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, unnest(regexp_extract_all(t, '{quoted}')) AS w, "
            f"unnest(regexp_extract_all(t, '{quoted}', {group})) AS v, unnest(string_split_regex(t, '{quoted}')[:-2]) AS gap, "
            f"generate_subscripts(regexp_extract_all(t, '{quoted}'), 1) AS n, {least} AS least FROM texts"
        )
    mixed = " AND ".join(f"regexp_matches(v, '{x}')" for x in MIXED)
    return f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS fin FROM raw),
spans AS (SELECT doc_id, source, kind, rank, v, CAST(fin - length(w) AS BIGINT) AS ini, CAST(fin AS BIGINT) AS fin FROM placed WHERE length(v) >= least),
base AS (SELECT * FROM spans WHERE kind <> 'owned'),
cand AS (SELECT * FROM spans c WHERE kind = 'owned' AND {mixed} AND NOT regexp_matches(v, '{WORDY}')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.ini < c.fin AND c.ini < b.fin)),
allspans AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
freq AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM allspans GROUP BY v),
told AS (SELECT v, owners >= {EXAMPLE_OWNERS} OR (owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES}) AS copied FROM freq),
every AS (SELECT allspans.*, copied FROM allspans JOIN told USING (v) WHERE kind <> 'owned' OR NOT copied),
agg AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE copied) AS n_examples,
  coalesce(string_agg(kind || ':' || ini || ':' || fin, ',' ORDER BY ini, rank) FILTER (WHERE kind <> 'owned'), '') AS b,
  string_agg(kind || ':' || ini || ':' || fin, ',' ORDER BY ini, rank) AS s FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_examples, 0) AS n_examples
FROM documents d LEFT JOIN agg USING (doc_id)
"""


ORACLE_SQL = _oracle()
