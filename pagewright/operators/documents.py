"""Checks and outcomes of what is generated: component graphs, exports, generations, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import extract_json, is_safe_project_path
from pagewright.plans.session import cut_lineage

#: Fixed values.
MOST_COMPONENT_DEPTH = 12
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def graph_problems(components: DataFrame, by: str = "site", most_depth: int = MOST_COMPONENT_DEPTH) -> DataFrame:
    """What is wrong with components (by, id, children): rows (by, problem, id).

    Problems are duplicate (an id that occurs twice), unknown_child (the id of the
    parent), cycle (an id on or below a ring is reached over and over) and
    too_deep.  Depths are found level by level from components without a parent;
    what no level reaches hangs below a cycle only.
    """
    ids = components.groupBy(by, "id").agg(F.count("*").alias("n"))
    edges = components.select(by, "id", F.explode("children").alias("child")).distinct()
    known = ids.select(by, F.col("id").alias("child"))
    dangling = edges.join(known, [by, "child"], "left_anti").select(by, F.lit("unknown_child").alias("problem"), "id").distinct()
    double = ids.where("n > 1").select(by, F.lit("duplicate").alias("problem"), "id")
    inner = cut_lineage(edges.join(known, [by, "child"], "left_semi"))
    left = inner
    while True:  # leaves fall off level by level; what is left when none does are rings and what leads to them
        parents = left.select(by, F.col("id").alias("child"))
        rest = cut_lineage(left.join(parents, [by, "child"], "left_semi"))
        if rest.count() == left.count():
            break
        left = rest
    rings = left.select(by, F.lit("cycle").alias("problem"), "id").distinct()
    reached = ids.join(inner.select(by, F.col("child").alias("id")).distinct(), [by, "id"], "left_anti").select(by, "id")
    for _ in range(most_depth):
        reached = cut_lineage(reached.join(inner, [by, "id"]).select(by, F.col("child").alias("id")).distinct())
    deep = reached.select(by, F.lit("too_deep").alias("problem"), "id").join(rings.select(by, "id"), [by, "id"], "left_anti")
    return double.unionByName(dangling).unionByName(rings).unionByName(deep)


def page_cap(pages: DataFrame, by: str, order: list[str], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` pages of each site, and per site the number of dropped ones."""
    ranked = pages.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_n") <= most).drop("_n"), pages.groupBy(by).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_dropped"))


def export_plan(files: DataFrame, listed: DataFrame, key: str = "project", most_files: int = 2000, most_bytes: int = 64 << 20) -> DataFrame:
    """Per project what an export would do: (key, n_files, n_bytes, n_missing, reason).

    ``files`` has key, path and size; ``listed`` the paths that must be there.  The
    first limit that is broken is the reason: unsafe_path, collision (paths that
    differ in case only), missing_file, too_many_files, too_large.
    """
    sums = files.groupBy(key).agg(
        F.count("*").alias("n_files"),
        F.sum("size").alias("n_bytes"),
        F.bool_and(is_safe_project_path(F.col("path"))).alias("safe"),
        (F.count_distinct(F.lower("path")) < F.count("*")).alias("collides"),
    )
    absent = listed.select(key, "path").distinct().join(files.select(key, "path"), [key, "path"], "left_anti").groupBy(key).agg(F.count("*").alias("n_missing"))
    joined = sums.join(absent, key, "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    reason = F.when(~F.col("safe"), "unsafe_path").when(F.col("collides"), "collision").when(F.col("n_missing") > 0, "missing_file").when(F.col("n_files") > most_files, "too_many_files").when(F.col("n_bytes") > most_bytes, "too_large")
    return joined.select(key, "n_files", "n_bytes", "n_missing", reason.alias("reason"))


OUTPUT = "componentId string, name string, fileName string, code string"


def generation_outcomes(responses: DataFrame, violations, key: str = "component_id", text: str = "response") -> DataFrame:
    """What became of each generated component: (key, outcome, name, problems).

    A response without the wanted JSON, or for another component, is
    MALFORMED_OUTPUT; one whose code ``violations`` (a column function) finds fault
    with is SLOPPY_OUTPUT; others are ok.
    """
    parsed = responses.select(key, F.from_json(extract_json(F.col(text)), OUTPUT).alias("o"))
    whole = F.col("o").isNotNull() & F.col("o.componentId").isNotNull() & F.col("o.code").isNotNull() & F.col("o.name").isNotNull()
    judged = parsed.withColumn("problems", F.when(whole, violations(F.col("o.code"))).otherwise(F.array().cast("array<string>")))
    outcome = F.when(~whole | (F.col("o.componentId") != F.col(key).cast("string")), "MALFORMED_OUTPUT").when(F.size("problems") > 0, "SLOPPY_OUTPUT").otherwise("ok")
    return judged.select(key, outcome.alias("outcome"), F.col("o.name").alias("name"), "problems")


def generation_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """Per site (requested, succeeded, failed, partial)."""
    sums = outcomes.groupBy(by).agg(F.count("*").alias("requested"), F.count_if(F.col("outcome") == "ok").alias("succeeded"))
    return sums.withColumn("failed", F.col("requested") - F.col("succeeded")).withColumn("partial", F.col("failed") > 0)


def at_level(level: Column, least: str) -> Column:
    """Whether a log entry's level is ``least`` or above; unknown levels are not."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    return rank(level) >= LEVELS.index(least) + 1


def structured_error(code: Column, category: Column, message: Column, severity: Column, retryable: Column) -> Column:
    """An error as a struct, with the defaults of what is not given."""
    return F.named_struct(
        F.lit("code"), F.coalesce(code, F.lit("UNKNOWN_ERROR")),
        F.lit("category"), F.coalesce(category, F.lit("process")),
        F.lit("message"), F.coalesce(message, F.lit("An unexpected error occurred.")),
        F.lit("severity"), F.coalesce(severity, F.lit("error")),
        F.lit("recoverable"), F.lit(True),
        F.lit("retryable"), F.coalesce(retryable, F.lit(False)),
    )
