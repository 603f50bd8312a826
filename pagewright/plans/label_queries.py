"""Queries on names, labels, headers and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import json_text as J
from pagewright.functions import labels as L
from pagewright.plans.registry import register
from pagewright.plans.session import table


def _pick(key: str, values: tuple) -> Column:
    """One of ``values`` by a row's key."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int"))


def _sql(key: str, values: tuple) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


_TITLES = (("Home | Site", "%s | Site"), ("About - Us – Co", "%s | Us – Co"), ("Plain", "%s | Name"), ("", ""), (None, ""), ("A |  ", "%s | Name"))


@register("title_templates", f"SELECT p_partkey, {_sql('p_partkey', tuple(t for _, t in _TITLES))} AS template, CASE WHEN p_partkey * 700 < 1024 THEN (p_partkey * 700)::VARCHAR || ' B' WHEN p_partkey * 700 < 1048576 THEN printf('%.1f KB', round(p_partkey * 700 / 1024.0, 1)) ELSE printf('%.1f MB', round(p_partkey * 700 / 1048576.0, 1)) END AS size FROM part")
def title_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.title_template(_pick("p_partkey", tuple(t for t, _ in _TITLES)), F.lit("Name")).alias("template"), L.shown_bytes(F.col("p_partkey") * 700).alias("size"))


_COLORS = (("--primary-500", "primary", "500"), ("--Brand_Blue", "brand-blue", None), ("--muted", "muted", None), ("--x-10", "x", "10"), ("color", None, None), ("--a b--c", "a-b-c", None), ("--primary-dark", "primary", None), ("--", "color", None))


@register("color_names", f"SELECT p_partkey, {_sql('p_partkey', tuple(b for _, b, _ in _COLORS))} AS base, {_sql('p_partkey', tuple(s for _, _, s in _COLORS))} AS scale FROM part")
def color_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.color_variable(_pick("p_partkey", tuple(n for n, _, _ in _COLORS)))
    return table(spark, sf_dir, "part").select("p_partkey", found["base"].alias("base"), found["scale"].alias("scale"))


@register(
    "code_names",
    """WITH w AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || substr(w, 2)), '') AS pascal FROM part)
SELECT p_partkey, pascal AS component, 'Page' || p_partkey || pascal AS page, pascal || '.tsx' AS file, upper(replace(p_name, ' ', '-')) || '.md' AS doc, replace(p_name, ' ', '-') || '.ts' AS hook,
replace(p_name, ' ', '-') AS project, 'public/assets/' || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '.svg' END AS asset FROM w""",
)
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    component = L.component_identifier(name, key)
    hint = F.concat(F.lit("a/b\\"), name, F.when(F.col("p_partkey") % 2 == 0, ".PNG").otherwise(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        component.alias("component"),
        L.page_identifier(F.concat_ws(" ", key, name)).alias("page"),
        L.component_file(F.lit("../x.css"), component).alias("file"),
        L.doc_file(F.concat(F.lit("docs/"), name, F.lit(".md"))).alias("doc"),
        L.hook_file(F.lit("use"), name).alias("hook"),
        L.project_name(F.concat(F.lit("--"), name, F.lit("!"))).alias("project"),
        L.public_asset(hint, F.lit("image/svg+xml")).alias("asset"),
    )


_HEADERS = (("sid=abc; Path=/", "sid", "text/html; charset=utf-8", True, "get", "GET"), (" a = b", "a", "TEXT/HTML", True, "post", "POST"), ("=x", None, "image/png", False, "patch", "GET"), ("", None, None, True, "Delete", "DELETE"))
_BASES = (("https://a.example/v1//", None), ("  ", "required"), ("https://a b", "whitespace"), ("a.example", "not_absolute"), ("ftp://a.example", "scheme"), ("https://u:p@a.example", "credentials"))


@register(
    "header_labels",
    "SELECT event_id, " + ", ".join(f"{_sql('event_id', tuple(h[i] for h in _HEADERS))} AS {n}" for i, n in ((1, "cookie"), (3, "taken"), (5, "method"))) + f", {_sql('event_id', tuple(r for _, r in _BASES))} AS base_error FROM events",
)
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda i: _pick("event_id", tuple(h[i] for h in _HEADERS))
    return table(spark, sf_dir, "events").select("event_id", L.cookie_name(of(0)).alias("cookie"), L.type_allowed(of(2), ("text/html", "application/xhtml+xml")).alias("taken"), L.http_method(of(4)).alias("method"), L.base_url_error(_pick("event_id", tuple(b for b, _ in _BASES))).alias("base_error"))


@register("crawl_limits", "SELECT c_custkey, CAST(greatest(1, least(200, floor(CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE c_acctbal END))) AS BIGINT) AS max_pages, CAST(greatest(0, least(6, floor(c_acctbal / 100))) AS BIGINT) AS max_depth FROM customer")
def crawl_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.crawl_limit("max_pages", pages).alias("max_pages"), L.crawl_limit("max_depth", F.col("c_acctbal") / 100).alias("max_depth"))


@register(
    "form_labels",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'form_' || replace(p_name, ' ', '-') WHEN 1 THEN 'form_f-' || p_partkey ELSE 'form_form-' || p_partkey END AS id,
'max_length=' || p_size || '.0,pattern=none' AS rules FROM part""",
)
def form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, empty = F.col("p_partkey") % 3, F.lit("")
    identity = L.form_identity(F.when(k == 0, F.col("p_name")).otherwise(empty), F.when(k == 1, F.concat(F.lit("f "), F.col("p_partkey").cast("string"))).otherwise(empty), F.col("p_partkey"))
    rules = L.validations(F.create_map(F.lit("pattern"), F.lit("[a-z]+"), F.lit("maxlength"), F.col("p_size").cast("string")))
    shown = F.array_join(F.transform(rules, lambda r: F.concat(r["rule"], F.lit("="), F.coalesce(r["value"].cast("string"), F.lit("none")))), ",")
    return table(spark, sf_dir, "part").select("p_partkey", identity["id"].alias("id"), shown.alias("rules"))


@register(
    "nested_redaction",
    """SELECT event_id, '{"a":[{"auth_token":"[redacted]","n":' || event_id || '}],"key":"k"}' AS redacted, '{"a":[{"auth_token":"[redacted]","n":' || event_id || '}],"key":"[redacted]"}' AS scrubbed,
'{"a":[{"auth_token":"t","n":' || event_id || '}],"key":"k"}' AS sorted, CASE WHEN event_id % 2 = 0 THEN '["[DATA_URI_TRUNCATED]","x"]' ELSE '["data:,short","x"]' END AS short FROM events""",
)
def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('{"key": "k", "a": [{"n": '), F.col("event_id").cast("string"), F.lit(', "auth_token": "t"}]}'))
    data = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["data:,'), F.repeat(F.lit("x"), F.lit(600)), F.lit('", "x"]'))).otherwise(F.lit('["data:,short", "x"]'))
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("m"), data.alias("d"))
    return rows.select("event_id", J.sorted_json(J.redact_json("m")).alias("redacted"), J.sorted_json(J.scrub_json("m")).alias("scrubbed"), J.sorted_json("m").alias("sorted"), J.without_data_urls("d").alias("short"))


@register("parsed_times", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", L.parsed_time(text).cast("timestamp_ntz").alias("at"))
