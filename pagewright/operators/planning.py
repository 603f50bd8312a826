"""Plans and summaries of a site's work: what is taken, in which order, what is left out and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Components that are synthesised in one run.
MOST_TARGETS = 50
#: Reasons of captures that cannot be compared.
NO_ORIGINAL, NO_GENERATED = "original_unavailable", "generated_unavailable"
COMPLETED = "completed"


def eligible_pages(pages: DataFrame, status: str = "status") -> DataFrame:
    """The pages that a site may be put together from: those that are completed."""
    return pages.where(F.col(status) == COMPLETED)


def source_urls(pages: DataFrame, by: str, url: str = "url", depth: str = "depth", path: str = "path", key: str = "page_id") -> DataFrame:
    """The URL that each ``by`` started from: that of its first page by depth, path and key; minima are met before the shuffle."""
    return pages.groupBy(by).agg(F.min_by(url, F.struct(depth, path, key)).alias("source_url"))


def targets(components: DataFrame, by: str, order: str, wanted: DataFrame | None = None, key: str = "id", most: int = MOST_TARGETS) -> DataFrame:
    """The first ``most`` components of each ``by``, of those in ``wanted`` (by, key) if it is given.

    The rest of a group is dropped before the shuffle, by Spark's limit on window groups.
    """
    chosen = components if wanted is None else components.join(wanted.select(by, key).distinct(), [by, key], "left_semi")
    return chosen.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("_n") <= most).drop("_n")


def resolved_profiles(profiles: DataFrame, wanted: DataFrame | None, by: str, owners: DataFrame, name: str = "name") -> DataFrame:
    """For each owner (by) the built-in ``profiles`` that ``wanted`` (by, name) names, or all of them where it names none.

    Profiles are a handful, so they are broadcast.
    """
    every = owners.select(by).distinct().join(F.broadcast(profiles))
    if wanted is None:
        return every
    asked = wanted.select(by, name).distinct()
    some = asked.select(by).distinct().withColumn("_some", F.lit(True))
    marked = every.join(some, by, "left").join(asked.withColumn("_hit", F.lit(True)), [by, name], "left")
    return marked.where(F.col("_some").isNull() | F.col("_hit")).drop("_some", "_hit")


def comparisons(wanted: DataFrame, originals: DataFrame, generated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` (keys) with the paths of both captures, and why they cannot be compared; null if they can.

    ``originals`` and ``generated`` have keys and path; of repeated ones the first path counts.
    """
    sides = [side.groupBy(*keys).agg(F.min("path").alias(name)) for side, name in ((originals, "original"), (generated, "generated"))]
    both = wanted.join(sides[0], keys, "left").join(sides[1], keys, "left")
    return both.withColumn("skipped_reason", F.when(F.col("original").isNull(), NO_ORIGINAL).when(F.col("generated").isNull(), NO_GENERATED))


def diff_totals(compared: DataFrame, by: str) -> DataFrame:
    """Per ``by`` of rows (compared, similarity, mismatched, total, resized): numbers, mean similarity to two places, pixels, and whether something is partial.

    A mean of nothing is 0; a side that was resized makes a result partial.
    """
    done = F.col("compared")
    of = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    mean = F.floor(F.coalesce(F.avg(F.when(done, F.col("similarity"))), F.lit(0.0)) * 100 + 0.5) / 100
    return compared.groupBy(by).agg(
        F.count("*").alias("viewports"), F.count_if(done).alias("compared"), F.count_if(~done).alias("skipped"), mean.alias("similarity"), of("mismatched").alias("mismatched"), of("total").alias("total"),
        (F.coalesce(F.bool_or(~done), F.lit(False)) | F.coalesce(F.bool_or(done & F.col("resized")), F.lit(False))).alias("partial"),
    )


def documents_not_in(documents: DataFrame, sources: DataFrame, by: str, name: str = "name") -> DataFrame:
    """``documents`` whose name no source of the same ``by`` has, in whatever case."""
    known = sources.select(by, F.lower(name).alias("_name")).distinct()
    return documents.withColumn("_name", F.lower(name)).join(known, [by, "_name"], "left_anti").select(*documents.columns)


def planned_documents(catalogue: DataFrame, choices: DataFrame, by: str) -> DataFrame:
    """Rows (by, name, required, reason) for every document of the catalogue: why it is planned, or null if it is left out.

    ``catalogue`` has (name, required, place), a few rows; ``choices`` a row (by,
    name, include, exclude, relevant) for what is known of a document.  Required
    ones are planned unless their include is false.  Of the others an exclusion
    comes before an inclusion, and that before relevance.
    """
    owners = choices.select(by).distinct()
    met = choices.groupBy(by, "name").agg(F.bool_and("include").alias("include"), F.bool_or("exclude").alias("exclude"), F.bool_or("relevant").alias("relevant"))
    rows = owners.join(F.broadcast(catalogue)).join(met, [by, "name"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    refused = F.coalesce(~F.col("include"), F.lit(False))
    reason = F.when(F.col("required"), F.when(~refused, "required")).when(yes("exclude") | refused, None).when(yes("include"), "opted_in").when(yes("relevant"), "relevant")
    return rows.select(by, "name", "required", reason.alias("reason"))


def top_level_groups(files: DataFrame, by: str, path: str = "path") -> DataFrame:
    """Numbers of files per first segment of their path, files of the root as ``(root)``: (by, name, n)."""
    first = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")
    return files.groupBy(by, first.alias("name")).agg(F.count("*").alias("n"))


def session_expiry(cookies: DataFrame, by: str, expires: str = "expires") -> DataFrame:
    """When a session ends: with its first cookie that ends at all (a positive, finite time); null if none does."""
    at = F.col(expires).cast("double")
    real = (at > 0) & ~F.isnan(at) & (at < float("inf"))
    return cookies.groupBy(by).agg(F.min(F.when(real, at)).alias("expires"))


#: What counts as scanned, and the states that have counters of their own.
PAGE_STATES = ("loaded", "failed", "auth_required", "blocked")


def crawl_totals(pages: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Per run: pages discovered and scanned, and how many are in each state; a page that is queued is not scanned."""
    return pages.groupBy(by).agg(F.count("*").alias("discovered"), F.count_if(F.col(status) != "queued").alias("scanned"), *[F.count_if(F.col(status) == s).alias(s) for s in PAGE_STATES])


def first_of_case(paths: DataFrame, by: str, order: str, path: str = "path") -> DataFrame:
    """Per ``by`` the first path, in order, that an earlier one differs from in case only, or not at all: (by, path); no row without one."""
    same: Column = F.row_number().over(Window.partitionBy(by, F.lower(path)).orderBy(order))
    again = paths.withColumn("_n", same).where("_n = 2")
    return again.groupBy(by).agg(F.min_by(path, order).alias("path"))
