"""Queries on streams of events, crawls, trees of pages and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pagewright.operators import crawl as C
from pagewright.operators import dom, images
from pagewright.plans.registry import register
from pagewright.plans.session import scratch_path, table
from pagewright.sources import files as S
from pagewright.streaming import events as E
from pagewright.streaming import runs as R
from pagewright.streaming.once import OnceSink


@register(
    "frame_decoding",
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'bad_version' WHEN 3 THEN 'missing_type' END AS reason, CASE WHEN event_id % 5 IN (0, 4) THEN event_type END AS kind FROM events""",
)
def frame_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.to_json(F.struct(F.lit(1).alias("version"), F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("id"), F.col("props").alias("payload")))
    k = F.col("event_id") % 5
    line = F.when(k == 1, F.lit("{broken")).when(k == 2, F.lit('{"version":2,"type":"x"}')).when(k == 3, F.lit('{"version":1}')).otherwise(good)
    rows = E.decode_frames(table(spark, sf_dir, "events").select("event_id", line.alias("value")))
    return rows.select("event_id", "reason", F.when(F.col("reason").isNull(), F.col("frame.type")).alias("kind"))


@register("event_routing", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 10 = 0) AS rejected FROM events GROUP BY 1")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 10 == 0).alias("rejected"))


_FOLD = """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS scanned, count(*) FILTER (WHERE event_type = 'error') AS failed, max(event_id) AS last_event,
CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' ELSE 'in_progress' END AS status FROM events GROUP BY 1"""


@register("scan_states", _FOLD)
def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fold_scans_batch(table(spark, sf_dir, "events"))


def _streamed(spark: SparkSession, rows: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream has written when it has read all there is, each batch once."""
    sink = OnceSink(spark, scratch_path(spark, name))
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True)
    writer.foreachBatch(sink.writer()).start().awaitTermination()
    found = sink.read()
    return spark.createDataFrame([], StructType([*rows.schema.fields, StructField("batch", IntegerType())])) if found is None else found


@register("scan_states_streaming", _FOLD)
def scan_states_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful fold over a stream of event files; the last state of each key."""
    source = spark.readStream.schema(E.EVENT).parquet(f"{sf_dir}/events.parquet*")
    out = _streamed(spark, E.fold_scans(source), "update", "fold")
    return out.groupBy("user_id").agg(F.max_by(F.struct("scanned", "failed", "last_event", "status"), "batch").alias("s")).select("user_id", "s.*")


@register("hourly_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@register(
    "user_sessions",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"))


@register("answered_commands", "SELECT c.event_id AS id, c.ts AS asked, r.ts AS replied FROM events c JOIN events r ON r.event_id = c.event_id + 1 AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 5 MINUTE")
def answered_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event answered by the next, if that comes in time."""
    rows = table(spark, sf_dir, "events")
    return E.answered(rows.select(F.col("event_id").alias("id"), "ts"), rows.select((F.col("event_id") - 1).alias("id"), "ts"), "5 MINUTES")


@register("joined_deltas", "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def joined_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accumulate(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_CODE = (("const A = () => { return (<div/>); };", ""), ("eval(x); console.log(1)", "EVAL_USAGE,CONSOLE_CALL"), ("Here is it\n```", "CONVERSATIONAL_FILLER,MARKDOWN_FENCE"), ("f(a]", "UNBALANCED_DELIMITERS"), ("x: any; // TODO y\nonClick={() => {}}", "TODO_COMMENT,ANY_TYPE,EMPTY_HANDLER"))


@register("code_violations", "SELECT p_partkey, CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(_CODE)) + " END AS violations FROM part")
def code_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c, _ in _CODE]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(E.code_violations(code), ",").alias("violations"))


@register("dom_nodes")
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: nodes, roots, the deepest level, components by kind, repeated siblings; the tests know small trees."""
    rows = dom.nodes(table(spark, sf_dir, "pages")).withColumn("kind", dom.component_kind(F.col("tag"), F.col("role")))
    counts = rows.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("deepest"), F.count("kind").alias("n_components"), F.count_if(F.col("tag") == "a").alias("n_links"))
    groups = dom.sibling_groups(rows).groupBy("page_id").agg(F.count("*").alias("n_groups"))
    return counts.join(groups, "page_id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


@register(
    "pixel_diff",
    """WITH px AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings), p AS (SELECT vec_id AS k, i % 8 AS x, i // 8 AS y, CAST(floor(abs(embedding[i + 1]) * 400) AS INT) AS v FROM px),
d AS (SELECT a.k, a.x, a.y, abs(a.v - b.v) > 32 AS bad FROM p a JOIN p b ON b.k = a.k + 1 AND a.x = b.x AND a.y = b.y AND a.k % 2 = 0)
SELECT k, count(*) AS total, count(*) FILTER (WHERE bad) AS mismatched, round(count(*) FILTER (WHERE NOT bad) / count(*) * 100, 2) AS similarity, min(x) FILTER (WHERE bad) AS min_x, max(x) FILTER (WHERE bad) AS max_x, min(y) FILTER (WHERE bad) AS min_y, max(y) FILTER (WHERE bad) AS max_y FROM d GROUP BY k""",
)
def pixel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of 8 by 8 pixels, each pair compared."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    px = rows.select((F.col("vec_id") - F.col("vec_id") % 2).alias("k"), (F.col("vec_id") % 2).alias("side"), (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), F.floor(F.abs("e") * 400).cast("int").alias("v"))
    return images.pixel_diff(px.where("side = 0"), px.where("side = 1"), "k", ["v"])


def _part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: each links to pages named after its items."""
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_suppkey") % 40).alias("source"), (F.col("l_partkey") % 400).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 7 > 0).alias("in_scope"))


@register(
    "frontier_level",
    """WITH o AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey % 400 END AS key, CASE WHEN l_suppkey % 9 = 0 THEN 3 ELSE 1 END AS depth, l_partkey % 7 > 0 AS in_scope FROM lineitem),
ok AS (SELECT key, min(seq) AS s FROM o WHERE key IS NOT NULL AND depth <= 2 AND in_scope AND key >= 5 GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY s) AS place FROM ok),
f AS (SELECT max(s) AS filled, count(*) AS n FROM r WHERE place <= 25),
j AS (SELECT o.*, r.s, r.place, CASE WHEN n = 25 THEN filled END AS filled FROM o LEFT JOIN r ON r.key = o.key, f)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN key IS NULL THEN 'invalid_url' WHEN depth > 2 THEN 'depth_exceeded' WHEN key < 5 OR (place <= 25 AND seq > s) THEN 'duplicate'
 WHEN seq > filled THEN 'page_limit_reached' WHEN NOT in_scope THEN 'out_of_scope' WHEN place <= 25 AND seq = s THEN 'enqueued' ELSE 'page_limit_reached' END AS status FROM j) GROUP BY 1""",
)
def frontier_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of offers against five known pages and a limit of thirty."""
    items = table(spark, sf_dir, "lineitem")
    offers = items.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_partkey") % 50 > 0, F.col("l_partkey") % 400).alias("key"), F.when(F.col("l_suppkey") % 9 == 0, 3).otherwise(1).alias("depth"), (F.col("l_partkey") % 7 > 0).alias("in_scope")
    )
    offers = offers.groupBy("seq", "key", "depth", "in_scope").agg(F.count("*").alias("copies"))
    statuses = C.enqueue(offers, spark.range(5).select(F.col("id").alias("key")), 2, 30)
    return statuses.groupBy("status").agg(F.sum("copies").alias("n"))


def _crawl_sql(levels: int, most: int) -> str:
    """A breadth-first crawl of so many levels: each level lets in the first offers of new keys, as many as there is room."""
    parts = ["l AS (SELECT l_suppkey % 40 AS source, l_partkey % 400 AS target, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_partkey % 7 > 0)", "s0 AS (SELECT 0::BIGINT AS key, 0 AS depth)"]
    for d in range(1, levels + 1):
        parts.append(f"o{d} AS (SELECT target AS key, min({{'a': l.source, 'b': l.seq}}) AS first FROM l JOIN s{d - 1} ON depth = {d - 1} AND s{d - 1}.key = l.source WHERE target NOT IN (SELECT key FROM s{d - 1}) GROUP BY 1)")
        parts.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT key, {d} FROM (SELECT key, row_number() OVER (ORDER BY first) AS place FROM o{d}) WHERE place <= {most} - (SELECT count(*) FROM s{d - 1}))")
    return f"WITH {', '.join(parts)} SELECT * FROM s{levels}"


@register("crawl_pages", _crawl_sql(3, 60))
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of three levels; the tests also hold it against a sequential one."""
    return C.crawl(_part_links(spark, sf_dir), spark.range(1).select(F.col("id").alias("key")), 3, 60)


def _run_sql(levels: int, most: int, failures: int, retries: int) -> str:
    """The same run level by level: attempts, running failures, the page at which it stops, offers of loaded pages before it."""
    tried = f"""WITH l AS (SELECT l_suppkey % 40 AS source, l_partkey % 400 AS target, l_orderkey * 10 + l_linenumber AS seq, l_partkey % 7 > 0 AS in_scope FROM lineitem),
a AS (SELECT p_partkey % 400 AS key, i AS attempt, CASE WHEN i < p_size % 5 THEN 'retryable' ELSE ['loaded', 'failed', 'auth_required', 'loaded', 'loaded', 'loaded', 'blocked'][p_size % 7 + 1] END AS outcome FROM part, unnest(range(0, p_size % 5 + 1)) u(i) WHERE p_partkey < 400 AND i <= {retries}),
t AS (SELECT key, coalesce(arg_min(outcome, attempt) FILTER (WHERE outcome <> 'retryable'), CASE WHEN count(*) > {retries} THEN 'failed' ELSE 'loaded' END) AS status,
  CASE WHEN min(attempt) FILTER (WHERE outcome <> 'retryable') IS NOT NULL THEN min(attempt) FILTER (WHERE outcome <> 'retryable') + 1 WHEN count(*) > {retries} THEN {retries + 1} ELSE count(*) + 1 END AS attempts FROM a GROUP BY key),
w0 AS (SELECT key, 0 AS depth, row_number() OVER (ORDER BY key) AS place FROM (SELECT unnest(range(1, 4)) AS key))"""
    parts, before = [tried], "SELECT 0 AS failed, false AS stopped"
    for d in range(levels + 1):
        parts.append(f"v{d} AS (SELECT w.key, depth, place, coalesce(status, 'loaded') AS st, coalesce(attempts, 1) AS n, b.failed + count(*) FILTER (WHERE coalesce(status, 'loaded') = 'failed') OVER (ORDER BY place) AS failed, b.stopped FROM w{d} w LEFT JOIN t ON t.key = w.key, ({before}) b)")
        parts.append(f"e{d} AS (SELECT *, st = 'failed' AND failed >= {failures} AS ends, stopped OR coalesce(max(CASE WHEN st = 'failed' AND failed >= {failures} THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS behind FROM v{d})")
        known = f"SELECT key, depth, place, CASE WHEN behind THEN 'queued' ELSE st END AS status, CASE WHEN behind THEN 0 ELSE n END AS attempts FROM e{d}"
        parts.append(f"d{d} AS ({known})" if d == 0 else f"d{d} AS (SELECT * FROM d{d - 1} UNION ALL {known})")
        before = f"SELECT coalesce(max(failed) FILTER (WHERE NOT behind), max(f0)) AS failed, coalesce(bool_or((ends AND NOT behind) OR stopped), bool_or(s0)) AS stopped FROM ({before.replace(' AS failed', ' AS f0').replace(' AS stopped', ' AS s0')}) x LEFT JOIN e{d} ON true" if d == 0 else f"SELECT coalesce(max(failed) FILTER (WHERE NOT behind), 0) AS failed, coalesce(bool_or((ends AND NOT behind) OR stopped), false) AS stopped FROM (SELECT * FROM e{d} UNION ALL SELECT * FROM e{d - 1})"
        if d < levels:
            parts.append(f"o{d + 1} AS (SELECT target AS key, min({{'a': place, 'b': seq}}) AS first FROM l JOIN e{d} ON e{d}.key = l.source WHERE st = 'loaded' AND NOT behind AND in_scope AND target NOT IN (SELECT key FROM d{d}) GROUP BY 1)")
            parts.append(f"w{d + 1} AS (SELECT key, {d + 1} AS depth, (SELECT count(*) FROM d{d}) + row_number() OVER (ORDER BY first) AS place FROM o{d + 1} QUALIFY row_number() OVER (ORDER BY first) <= {most} - (SELECT count(*) FROM d{d}))")
    return f"{', '.join(parts)} SELECT key, depth, place, status, attempts FROM d{levels}"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages, some of which fail a few times before they load, fail for good, or ask for a login."""
    size = F.col("p_size")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("loaded", "failed", "auth_required", "loaded", "loaded", "loaded", "blocked")]), (size % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").where("p_partkey < 400").select((F.col("p_partkey") % 400).alias("key"), size, ends.alias("ends"), F.explode(F.sequence(F.lit(0), (size % 5).cast("int"))).alias("attempt"))
    return rows.select("key", "attempt", F.when(F.col("attempt") < size % 5, C.RETRYABLE).otherwise(F.col("ends")).alias("outcome"))


def _run(spark: SparkSession, sf_dir: str, failures: int) -> DataFrame:
    links = _part_links(spark, sf_dir)
    return C.crawl_run(links, spark.range(1, 4).select(F.col("id").alias("key")), _attempts(spark, sf_dir), 3, 90, failures, 3)


@register("crawl_run", _run_sql(3, 90, 12, 3))
def crawl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of three levels with retries that stops at its twelfth failure."""
    return _run(spark, sf_dir, 12)


@register("crawl_run_result", f"WITH p AS ({_run_sql(3, 90, 50, 3)}) SELECT CASE WHEN count(*) FILTER (WHERE status = 'failed') >= 50 THEN 'failed' ELSE 'completed' END AS status, count(*) AS discovered, count(*) FILTER (WHERE status <> 'queued') AS scanned, count(*) FILTER (WHERE status = 'loaded') AS loaded, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(coalesce(sum(greatest(attempts - 1, 0)), 0) AS BIGINT) AS retries FROM p")
def crawl_run_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_result(_run(spark, sf_dir, 50))


@register(
    "layout_shifts",
    """WITH px AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings), p AS (SELECT vec_id AS k, i % 8 AS x, i // 8 AS y, CAST(floor(abs(embedding[i + 1]) * 400) AS INT) AS v FROM px),
d AS (SELECT a.k, a.x, a.y, abs(a.v - b.v) > 60 AS bad FROM p a JOIN p b ON b.k = a.k + 1 AND a.x = b.x AND a.y = b.y AND a.k % 2 = 0),
s AS (SELECT k, count(*) AS total, count(*) FILTER (WHERE bad) AS mismatched, min(x) FILTER (WHERE bad) AS a, max(x) FILTER (WHERE bad) AS b, min(y) FILTER (WHERE bad) AS c, max(y) FILTER (WHERE bad) AS e FROM d GROUP BY k)
SELECT k, mismatched, coalesce(((b - a + 1) * 2 >= 8 OR (e - c + 1) * 2 >= 8) AND mismatched * 50 >= total, false) AS shifted FROM s""",
)
def layout_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors as images, and whether their differences look like a shift of the layout."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    px = rows.select((F.col("vec_id") - F.col("vec_id") % 2).alias("k"), (F.col("vec_id") % 2).alias("side"), (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), F.floor(F.abs("e") * 400).cast("int").alias("v"))
    pairs = px.where("side = 0").join(px.where("side = 1").select("k").distinct(), "k", "left_semi")
    found = images.pixel_diff(pairs, px.where("side = 1"), "k", ["v"], 60)
    shifted = images.is_layout_shift(F.lit(8), F.lit(8), F.col("total"), F.col("mismatched"), F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"))
    return found.select("k", "mismatched", F.coalesce(shifted, F.lit(False)).alias("shifted"))


@register(
    "replaced_table",
    "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey <> 3",
)
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, then replaced by what is read from it."""
    path = scratch_path(spark, "table")
    S.replace_table(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), path)
    S.replace_table(S.read_table(spark, path).where("c_nationkey <> 3").withColumn("c_acctbal", F.col("c_acctbal") + 1), path)
    return S.read_table(spark, path).select("c_custkey", "c_acctbal")


@register(
    "document_code_checks",
    r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?im)^(Here|Sure|Certainly|Of course)\b') THEN 'CONVERSATIONAL_FILLER' END, CASE WHEN contains(t, '```') THEN 'MARKDOWN_FENCE' END, CASE WHEN regexp_matches(t, ':\s*any\b') THEN 'ANY_TYPE' END, CASE WHEN regexp_matches(t, '[A-Za-z0-9_)\]]\s*!\s*[.,;)]') THEN 'NON_NULL_ASSERTION' END], lambda x: x IS NOT NULL), ',') AS found,
(SELECT coalesce(max(d), 0) FROM (SELECT sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (ORDER BY i) AS d FROM (SELECT unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i))) AS depth FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def document_code_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the checks of generated code over the texts of documents, and how deep their braces go."""
    text, kept = F.coalesce("text", F.lit("")), ("CONVERSATIONAL_FILLER", "MARKDOWN_FENCE", "ANY_TYPE", "NON_NULL_ASSERTION")
    found = F.filter(E.code_violations(text), lambda x: x.isin(*kept))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("found"), E.brace_depth(text).alias("depth"))


_MODULES = ("import { A as C, D } from \"a\";\r\nimport B from 'b';\n\n\nconst Card = () => { return C(D, {}); };  \n\n\n\n// end\n", "function Card() { return 1; }")


@register(
    "component_code",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'UNUSED_IMPORT' ELSE '' END AS problems, CASE WHEN p_partkey % 2 = 0 THEN 'import B from ''b'';' || chr(10) || 'import { A as C, D } from \"a\";' || chr(10) || chr(10) || 'const Card = () => { return C(D, {}); };' || chr(10) || chr(10) || '// end ' || p_brand || chr(10) ELSE 'function Card() { return 1; }' || p_brand || chr(10) END AS tidy FROM part",
)
def component_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of components with the brand of each part: what is wrong with it, and how it looks when it is tidied."""
    even = F.col("p_partkey") % 2 == 0
    code = F.when(even, F.concat(F.lit(_MODULES[0].rstrip()), F.lit(" "), "p_brand", F.lit("\n\n"))).otherwise(F.concat(F.lit(_MODULES[1]), "p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    named = ("UNUSED_IMPORT", "MISSING_COMPONENT_DECLARATION", "EXCESSIVE_NESTING", "UNBALANCED_DELIMITERS")
    problems = F.filter(E.code_violations(F.col("code"), F.lit("Card")), lambda x: x.isin(*named))
    return rows.select("p_partkey", F.array_join(problems, ",").alias("problems"), E.tidy_code(F.col("code")).alias("tidy"))


_PROFILES = ("view", "purchase", "signup", "print")
_RUN_MS = 10 * 86_400_000
_RUNS = f"""WITH e AS (SELECT user_id AS page, event_type AS profile, epoch_ms(ts) AS ms FROM events), r AS (SELECT page, ms - ms % {_RUN_MS} AS start_ms, list(DISTINCT profile) AS seen FROM e GROUP BY 1, 2), m AS (SELECT max(ms) - 600000 AS mark FROM e)
SELECT page, start_ms, p AS profile, CASE WHEN list_contains(seen, p) THEN 'captured' ELSE 'skipped' END AS status FROM r, m, unnest({list(_PROFILES)}) t(p) WHERE list_contains(seen, p) OR start_ms + {_RUN_MS} <= mark"""


def _captures(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("page"), F.col("event_type").alias("profile"), "ts")


@register("profile_runs", _RUNS)
def profile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as pages and events as captures of their profiles: which of four have come in each ten days."""
    return R.batch_runs(_captures(table(spark, sf_dir, "events")), _PROFILES, _RUN_MS)


@register("profile_runs_streaming", _RUNS)
def profile_runs_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream with list state and timers."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, R.PROVIDER)
    try:
        source = _captures(spark.readStream.schema(E.EVENT).parquet(f"{sf_dir}/events.parquet*"))
        return _streamed(spark, R.streamed_runs(source, _PROFILES, _RUN_MS), "append", "runs").select("page", "start_ms", "profile", "status")
    finally:
        spark.conf.set(setting, before)
