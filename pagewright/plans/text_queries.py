"""Queries on strings, paths, JSON and markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.urls import path_for_url
from pagewright.plans.registry import register
from pagewright.plans.session import table

SLUG = "left(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64)"
COLLAPSE = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"


@register(
    "text_slugs",
    f"""SELECT p_partkey, {SLUG.format("p_name || ' / ' || p_brand")} AS slug, 'part_' || {SLUG.format("p_name")} || '_' || p_partkey AS id,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || substr(w, 2)), '') AS pascal, {COLLAPSE.format("'  ' || p_name || chr(10) || p_type || '  '")} AS collapsed FROM part""",
)
def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.slugify(F.concat_ws(" / ", name, "p_brand")).alias("slug"),
        T.stable_id(F.lit("part"), name, F.col("p_partkey").cast("string")).alias("id"),
        T.pascal_case(name).alias("pascal"),
        T.collapse_whitespace(F.concat(F.lit("  "), name, F.lit("\n"), "p_type", F.lit("  "))).alias("collapsed"),
    )


@register(
    "json_coercion",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS n_items,
    CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props END AS found FROM events""",
)
def json_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed members of JSON text; arrays of strings, empty where malformed; JSON bare or in a fence."""
    listed = F.when(F.expr("event_id % 3 = 0"), F.lit('["a", "b"]')).when(F.expr("event_id % 3 = 1"), F.lit("[broken")).otherwise(F.lit('{"a": 1}'))
    said = F.when(F.expr("event_id % 3 = 0"), F.col("props")).when(F.expr("event_id % 3 = 1"), F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))).otherwise(F.lit("no json"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.size(T.string_array(listed)).alias("n_items"), T.extract_json(said).alias("found"))


@register(
    "token_budget",
    """WITH m(model, context, completion, safety) AS (SELECT * FROM (VALUES ('small', 8192, 1024, 256), ('medium', 32768, 4096, 512), ('large', 128000, 8192, 1024)) v(a, b, c, d)),
s AS (SELECT conv_id, sum(CAST(ceil(length(text) / 3.8) AS BIGINT)) AS tokens, ['small', 'medium', 'large', 'other'][conv_id % 4 + 1] AS name FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, context - completion - safety AS budget, tokens <= context - completion - safety AS fits FROM s JOIN m ON m.model = CASE WHEN name = 'other' THEN 'medium' ELSE name END""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens per conversation against the budget of its model; an unknown model has the default's."""
    name = F.element_at(F.array(*map(F.lit, ("small", "medium", "large", "other"))), (F.col("conv_id") % 4 + 1).cast("int"))
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens")).withColumn("name", name)
    models = spark.createDataFrame(T.MODELS, "model string, context bigint, completion bigint, safety bigint")
    default = next(m for m in T.MODELS if m[0] == T.DEFAULT_MODEL)
    budget = F.coalesce(F.expr("context - completion - safety"), F.lit(default[1] - default[2] - default[3]))
    joined = sums.join(F.broadcast(models), F.col("name") == F.col("model"), "left").withColumn("budget", budget)
    return joined.select("conv_id", "tokens", "budget", (F.col("tokens") <= F.col("budget")).alias("fits"))


@register(
    "narrative_notes",
    rf"""WITH n AS (SELECT doc_id, left({COLLAPSE.format("text")}, 1200) AS summary,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: left({COLLAPSE.format("x")}, 240)), lambda x: x <> '')[:8] AS notes FROM documents)
SELECT doc_id, summary, len(notes) AS n_notes, array_to_string(notes, '|') AS notes FROM n""",
)
def narrative_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.narrative(F.col("text"), F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("n")).select("doc_id", "n.summary", F.size("n.notes").cast("long").alias("n_notes"), F.array_join("n.notes", "|").alias("notes"))


@register("redaction", "SELECT event_id, 'event_type=' || event_type || ',session_token=[redacted],user=' || user_id || ',x-api-key=k' AS plain, 'event_type=' || event_type || ',session_token=[redacted],user=' || user_id || ',x-api-key=[redacted]' AS scrubbed FROM events")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("session_token"), F.col("props"), F.lit("user"), F.col("user_id").cast("string"), F.lit("x-api-key"), F.lit("k"))
    shown = lambda x: F.array_join(F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "events").select("event_id", shown(T.redact_map(m)).alias("plain"), shown(T.redact_map(m, api_keys=True)).alias("scrubbed"))


@register("sorted_records", "SELECT l_orderkey, l_linenumber, 'a=' || l_linestatus || ',m=' || l_returnflag || ',z=' || l_linenumber AS record, list_distinct([l_returnflag, l_linestatus, l_returnflag])[1] IS NOT NULL AS any_flag FROM lineitem")
def sorted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("z"), F.col("l_linenumber").cast("string"), F.lit("m"), F.col("l_returnflag"), F.lit("a"), F.col("l_linestatus"))
    shown = F.array_join(F.transform(F.map_entries(T.sort_record(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("record"), (F.size(F.array_distinct(F.array("l_returnflag", "l_linestatus", "l_returnflag"))) > 0).alias("any_flag"))


_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_SEG = "CASE WHEN regexp_replace(regexp_replace(lower(s), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') = '' THEN 'index' ELSE regexp_replace(regexp_replace(lower(s), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') END"


@register(
    "clone_paths",
    f"""WITH p AS (SELECT page_id, {_PATH} AS path, md5(html) AS h FROM pages), q AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p)
SELECT page_id, CASE WHEN len(segs) = 0 THEN 'index.html' ELSE 'pages/' || array_to_string(list_transform(segs, lambda s: {_SEG}), '_') || '.html' END AS file,
'assets/images/logo.v2_' || left(h, 8) || '.png' AS asset, CASE WHEN len(segs) = 0 THEN '' ELSE '../' END AS prefix, len(segs) AS depth, true AS safe FROM q""",
)
def clone_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = path_for_url(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.md5("html").alias("h")).withColumn("file", T.page_file(F.col("path")))
    return rows.select("page_id", "file", T.asset_file(F.lit("/img/Logo.v2.PNG"), F.lit("image"), F.col("h")).alias("asset"), T.relative_prefix(F.col("file")).alias("prefix"), T.path_depth(F.col("path")).cast("long").alias("depth"), T.is_safe_relative(F.col("file")).alias("safe"))


_REQUESTS = (("/a/b.css?x=1#y", "a/b.css", None), ("", None, "empty_path"), ("/a%2F..%2Fb", None, "traversal"), ("a/b", None, "not_absolute_path"), ("/%zz", None, "malformed_encoding"), ("/", "index.html", None), ("/a\\b", None, "backslash"), ("/c%20d/e+f.js", "c d/e+f.js", None))


@register(
    "serve_paths",
    "SELECT o_orderkey, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {repr(r) if r else 'NULL'}" for i, (_, r, _) in enumerate(_REQUESTS)) + " END AS relative, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {repr(w) if w else 'NULL'}" for i, (_, _, w) in enumerate(_REQUESTS)) + " END AS reason, CASE o_orderkey % 2 WHEN 0 THEN 'x/z' END AS within FROM orders",
)
def serve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to an offline copy: those that leave it are refused, each with a reason."""
    raw = F.element_at(F.array(*[F.lit(r) for r, _, _ in _REQUESTS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    inside = F.when(F.col("o_orderkey") % 2 == 0, "x/./y/../z").otherwise("x/../../z")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.serve_path(raw).alias("r"), T.resolve_within(inside).alias("within")).select("o_orderkey", "r.relative", "r.reason", "within")


_MIMES = (("stylesheet", "text/css", "stylesheet"), ("", "application/javascript", "script"), ("", "font/woff2", "font"), ("image", "application/octet-stream", "image"), ("", "video/mp4", "video"), ("", "audio/mpeg", "audio"), ("", "application/json", "document"), ("", "text/plain", "other"))


@register("asset_types", "SELECT l_orderkey, l_linenumber, CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, _, k) in enumerate(_MIMES)) + " END AS kind, CASE l_partkey % 2 WHEN 0 THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM lineitem")
def asset_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("l_partkey") % 8 + 1).cast("int")
    hint, mime = (F.element_at(F.array(*[F.lit(m[i]) for m in _MIMES]), at) for i in (0, 1))
    file = F.when(F.col("l_partkey") % 2 == 0, "a/B.PNG").otherwise("a/b.unknown")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.asset_type(hint, mime).alias("kind"), T.content_type(file).alias("mime"))


@register(
    "markdown_cells",
    rf"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '``` a``' || p_name || ' ```' ELSE '`' || p_name || '`' END AS code,
    replace(p_name || ' | ' || p_type, '|', '\|') AS cell, p_partkey % 3 = 0 AS markdown FROM part""",
)
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a``"), "p_name")).otherwise(F.col("p_name"))
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x\n# "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.code_span(text).alias("code"), T.table_cell(F.concat_ws(" | ", "p_name", "p_type")).alias("cell"), T.is_markdown_like(said).alias("markdown"))


@register("css_values", "SELECT p_partkey, CAST(p_size AS VARCHAR) || 'px,4px' AS box, 'Inter,Arial' AS fonts, 2 AS n_fonts, least(50, greatest(1, CAST(p_size AS BIGINT))) AS size FROM part")
def css_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = T.box_values(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("px   4px ")))
    fonts = T.font_stack(F.lit("\"Inter\", Arial , 'Inter',"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(box, ",").alias("box"), F.array_join(fonts, ",").alias("fonts"), F.size(fonts).alias("n_fonts"), T.clamp(F.col("p_size"), 1, 50, 2).alias("size"))


_CHECKSUMS = """WITH RECURSIVE bits(n, k, c) AS (SELECT n, 0, n FROM range(256) r(n) UNION ALL SELECT n, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8),
x AS (SELECT p_partkey, list_transform(list_filter(string_split(trim(p_name), ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT) AS cs, list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT) AS bs FROM part)
SELECT p_partkey, lpad(lower(to_hex(list_reduce(cs, lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))), 8, '0') AS fnv,
xor(list_reduce(bs, lambda h, c: xor(h >> 8, crc[(xor(h, c) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM x, t"""


@register("checksums", _CHECKSUMS)
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a and CRC-32 of short texts."""
    return table(spark, sf_dir, "part").select("p_partkey", T.fnv1a(F.col("p_name")).alias("fnv"), F.crc32(F.col("p_name").cast("binary")).alias("crc"))


@register("sealed_states", "SELECT conv_id, turn, text FROM conversations")
def sealed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed with a derived key and opened again."""
    key = T.session_key("test password", b"fixed salt value")
    sealed = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sealed(F.col("text"), key).alias("data"))
    return sealed.select("conv_id", "turn", T.unsealed(F.col("data"), key).alias("text"))
