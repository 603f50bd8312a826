"""Style sheets whose text varies by row, with comments, strings and nested rules, and those of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import styles as Y
from pagewright.plans.registry import register
from pagewright.plans.session import saved, table


def part_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each part: what is in comments and strings looks like rules and references, too."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    css = F.concat(
        F.lit('@charset "utf-8"; @import "lib/'), k, F.lit(".css\" screen;\n/* url(img/"), k, F.lit(".png) } .no { color: red; } */ :root { --c-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(": "), size,
        F.lit('px; --s: "a;b}c /* no */"; } @MEDIA (min-width: '), (F.col("p_size") * 10).cast("string"), F.lit("px) { @supports (display: grid) { .p"), size, F.lit(" { Background: url(img/"), k,
        F.lit('.png) ; content: "url(img/'), k, F.lit(".png)\" } } } @font-face { font-family: \""), "p_brand", F.lit('"; font-weight: '), (F.col("p_size") * 10).cast("string"), F.lit("; src: url('f/"), k, F.lit(".woff') }"),
    )
    # a small file of parts makes many sheets: parts are spread before, not sheets after
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", "p_type", css.alias("css"))


_BRAND, _K = "lower(replace(p_brand, '#', ''))", "p_partkey"


@register(
    "sheet_declarations",
    rf"""WITH d AS (SELECT p_partkey, unnest([
  {{'seq': 0, 'rule': '', 'selector': '', 'media': '', 'property': '@charset', 'value': '"utf-8"', 'urls': ''}},
  {{'seq': 1, 'rule': '', 'selector': '', 'media': '', 'property': '@import', 'value': '"lib/' || {_K} || '.css" screen', 'urls': 'lib/' || {_K} || '.css'}},
  {{'seq': 2, 'rule': '', 'selector': ':root', 'media': '', 'property': '--c-' || {_BRAND}, 'value': p_size || 'px', 'urls': ''}},
  {{'seq': 3, 'rule': '', 'selector': ':root', 'media': '', 'property': '--s', 'value': '"a;b}}c /* no */"', 'urls': ''}},
  {{'seq': 4, 'rule': '', 'selector': '.p' || p_size, 'media': '(min-width: ' || p_size * 10 || 'px)', 'property': 'background', 'value': 'url(img/' || {_K} || '.png)', 'urls': 'img/' || {_K} || '.png'}},
  {{'seq': 5, 'rule': '', 'selector': '.p' || p_size, 'media': '(min-width: ' || p_size * 10 || 'px)', 'property': 'content', 'value': '"url(img/' || {_K} || '.png)"', 'urls': ''}},
  {{'seq': 6, 'rule': 'font-face', 'selector': '', 'media': '', 'property': 'font-family', 'value': '"' || p_brand || '"', 'urls': ''}},
  {{'seq': 7, 'rule': 'font-face', 'selector': '', 'media': '', 'property': 'font-weight', 'value': CAST(p_size * 10 AS VARCHAR), 'urls': ''}},
  {{'seq': 8, 'rule': 'font-face', 'selector': '', 'media': '', 'property': 'src', 'value': 'url(''f/' || {_K} || '.woff'')', 'urls': 'f/' || {_K} || '.woff'}}]) AS x FROM part)
SELECT p_partkey, CAST(x.seq AS INTEGER) AS seq, x.rule AS rule, x.selector AS selector, x.media AS media, x.property AS property, x.value AS value, x.urls AS urls FROM d""",
)
def sheet_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Y.sheet_declarations(part_sheets(spark, sf_dir), "p_partkey")
    return rows.select("p_partkey", "seq", "rule", "selector", "media", "property", "value", F.array_join("urls", ",").alias("urls"))


@register(
    "sheet_tokens",
    f"""SELECT p_type AS site, count(DISTINCT {_BRAND}) + 1 AS n_variables, count(DISTINCT (p_brand, p_size)) AS n_faces, list_sort(list(DISTINCT CAST(p_size * 10 AS INTEGER))) AS widths FROM part GROUP BY p_type""",
)
def sheet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All custom properties, font faces and widths of the sheets of each kind of part."""
    sheets = part_sheets(spark, sf_dir).select(F.struct("p_partkey", F.col("p_type").alias("site")).alias("k"), "css")
    rows = Y.sheet_declarations(sheets, "k").where("startswith(property, '--') OR rule = 'font-face' OR media <> ''")
    numbers = {"site": F.col("k.site"), "seq": F.col("k.p_partkey") * 100 + F.col("seq"), "block": F.col("k.p_partkey") * 100 + F.col("block")}
    placed = saved(rows.withColumns(numbers).drop("k", "urls", "selector"), "sheet-tokens")  # read three times, tokenized once
    counts = [made.groupBy("site").agg(F.count("*").alias(name)) for name, made in (("n_variables", Y.custom_properties(placed, "site")), ("n_faces", Y.font_faces(placed, "site")))]
    return counts[0].join(counts[1], "site").join(Y.media_widths(placed, "site"), "site")


@register(
    "sheet_rewrites",
    rf"""SELECT p_partkey, '@charset "utf-8"; @import ' || CASE WHEN p_size % 2 = 0 THEN 'url("../css/' || {_K} || '.css")' ELSE '"lib/' || {_K} || '.css"' END || ' screen;' || chr(10) || '/* url(img/' || {_K} || '.png) }} .no {{ color: red; }} */ :root {{ --c-' || {_BRAND} || ': ' || p_size
|| 'px; --s: "a;b}}c /* no */"; }} @MEDIA (min-width: ' || p_size * 10 || 'px) {{ @supports (display: grid) {{ .p' || p_size || ' {{ Background: url("../assets/' || {_K} || '.png") ; content: "url(img/' || {_K} || '.png)" }} }} }} @font-face {{ font-family: "' || p_brand || '"; font-weight: ' || p_size * 10
|| '; src: url(''' || CASE WHEN p_size % 2 = 0 THEN '../fonts/' || {_K} ELSE 'f/' || {_K} || '.woff' END || ''') }}' AS css FROM part""",
)
def sheet_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets as an offline copy has them: references that the copy holds are its own, those in comments and strings stay."""
    k = F.col("p_partkey").cast("string")
    sizes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("whole"))
    image = (F.concat(F.lit("img/"), k, F.lit(".png")), F.concat(F.lit("assets/"), k, F.lit(".png")))
    rest = (F.concat(F.lit("lib/"), k, F.lit(".css")), F.concat(F.lit("css/"), k, F.lit(".css")), F.concat(F.lit("f/"), k, F.lit(".woff")), F.concat(F.lit("fonts/"), k))
    sheets = part_sheets(spark, sf_dir).join(sizes, "p_partkey").withColumn("local", F.when(F.col("whole"), F.create_map(*image, *rest)).otherwise(F.create_map(*image)))
    return Y.rewritten_sheets(sheets.withColumn("prefix", F.lit("../")), "p_partkey")


@register("page_styles", r"""SELECT page_id, 'p' AS selector, 'margin' AS property, '0' AS value, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<style>p\{margin:0\}</style>')) FROM pages) GROUP BY page_id""")
def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the style elements of every page as they are."""
    rows = Y.sheet_declarations(table(spark, sf_dir, "pages").select("page_id", Y.style_elements(F.col("html")).alias("css")), "page_id")
    return rows.groupBy("page_id", "selector", "property", "value").agg(F.count("*").alias("n"))
