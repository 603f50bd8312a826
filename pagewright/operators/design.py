"""Design tokens of a site: colours by variable and role, type scales, font stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.labels import color_variable
from pagewright.functions.text import font_stack

#: Colours that say nothing; tokens of one kind that a site keeps.
IGNORED_COLORS = ("", "transparent", "rgba(0, 0, 0, 0)", "none")
MOST_TOKENS = 100


def variable_tokens(variables: DataFrame, by: str = "site") -> DataFrame:
    """Tokens of custom properties (by, name, value): (by, token, value), of equal tokens the first by name."""
    made = variables.where(F.coalesce("value", F.lit("")) != "").withColumn("v", color_variable(F.col("name"))).where("v IS NOT NULL")
    token = F.concat_ws(".", "v.base", "v.scale")
    return made.groupBy(by, token.alias("token")).agg(F.min_by("value", "name").alias("value"))


def role_tokens(styles: DataFrame, known: DataFrame, roles: Sequence[str] = ("background", "foreground", "border"), by: str = "site") -> DataFrame:
    """The most frequent value of each role (by, role, value), where neither its name nor its value is a known token."""
    counts = styles.where(F.col("role").isin(*roles) & ~F.col("value").isin(*IGNORED_COLORS)).groupBy(by, "role", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy(by, "role").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")).withColumnRenamed("role", "token")
    return best.join(known.select(by, "token"), [by, "token"], "left_anti").join(known.select(by, "value"), [by, "value"], "left_anti").select(by, "token", "value")


def numbered_tokens(styles: DataFrame, known: DataFrame, by: str = "site") -> DataFrame:
    """Other background colours as color_1, color_2 and so on, most frequent first."""
    counts = styles.where((F.col("role") == "background") & ~F.col("value").isin(*IGNORED_COLORS)).groupBy(by, "value").agg(F.count("*").alias("n"))
    rest = counts.join(known.select(by, "value").distinct(), [by, "value"], "left_anti")
    number = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value"))
    numbered = rest.withColumn("k", number).where(F.col("k") <= MOST_TOKENS)
    return numbered.select(by, F.concat(F.lit("color_"), F.col("k").cast("string")).alias("token"), "value")


def color_tokens(variables: DataFrame, styles: DataFrame, by: str = "site") -> DataFrame:
    """All colour tokens of a site: its variables, then roles, then numbered ones."""
    named = variable_tokens(variables, by)
    roles = role_tokens(styles, named, by=by)
    known = named.unionByName(roles)
    return known.unionByName(numbered_tokens(styles, known, by))


def is_monospace(stack: Column) -> Column:
    return F.lower(stack).rlike("mono|code|courier")


def font_families(stacks: DataFrame, by: str = "site") -> DataFrame:
    """Per site and kind (sans, mono) its families: those of the most frequent stacks first, each once."""
    counts = stacks.where("stack <> ''").groupBy(by, "stack").agg(F.count("*").alias("n"))
    flat = counts.select(by, F.when(is_monospace(F.col("stack")), "mono").otherwise("sans").alias("kind"), F.struct((-F.col("n")).alias("m"), "stack").alias("order"), F.posexplode(font_stack(F.col("stack"))).alias("place", "family"))
    first = flat.groupBy(by, "kind", "family").agg(F.min(F.struct("order", "place")).alias("o"))
    lists = first.groupBy(by, "kind").agg(F.array_sort(F.collect_list(F.struct("o", "family"))).alias("f"))
    return lists.select(by, "kind", F.slice(F.transform("f", lambda x: x["family"]), 1, MOST_TOKENS).alias("families"))
