"""Synthesis of a site from observations: counts, names, routes, tokens, trees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.session import cut_lineage


def value_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts per value with their place: most frequent first, then by value."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value)))


def most_frequent(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per group; the smallest wins a tie."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def first_wins(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per group by ``order``."""
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*by, *[F.col("r")[c].alias(c) for c in others])


def suffixed(rows: DataFrame, within: Sequence[str], name: str, order: Sequence[str], sep: str = "") -> DataFrame:
    """``rows`` with ``unique_name``: the second and later of a name get 2, 3 and so on."""
    n = F.row_number().over(Window.partitionBy(*within, name).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(sep), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def single_position_patterns(paths: DataFrame, site: str, path: str) -> DataFrame:
    """For each site: groups of paths that differ in one position only (site, depth, position, pattern, n_paths).

    The two or more values of that position become a parameter: ``id`` where all
    are digits and the position is the last, ``slug`` else, ``paramN`` before it.
    """
    distinct = paths.select(site, path).distinct().withColumn("s", segments(F.col(path)))
    each = distinct.select(site, path, "s", F.size("s").alias("depth"), F.posexplode("s").alias("position", "value"))
    rest = F.array_join(F.concat(F.slice("s", 1, F.col("position")), F.array(F.lit("*")), F.slice("s", F.col("position") + 2, F.col("depth"))), "/")
    keyed = each.withColumn("rest", rest)
    grouped = keyed.groupBy(site, "depth", "position", "rest").agg(F.count("*").alias("n_paths"), F.count_distinct("value").alias("n_values"), F.bool_and(F.col("value").rlike("^[0-9]+$")).alias("digits")).where("n_values >= 2")
    last = F.col("position") == F.col("depth") - 1
    name = F.when(last & F.col("digits"), "id").when(last, "slug").otherwise(F.concat(F.lit("param"), (F.col("position") + 1).cast("string")))
    pattern = F.concat(F.lit("/"), F.replace(F.concat(F.lit("/"), "rest", F.lit("/")), F.lit("/*/"), F.concat(F.lit("/:"), name, F.lit("/"))))
    return grouped.select(site, "depth", "position", "rest", F.rtrim(F.regexp_replace(pattern, "^//", "/"), F.lit("/")).alias("pattern"), "n_paths")


def greedy_patterns(paths: DataFrame, site: str, path: str) -> DataFrame:
    """The patterns of a site taken greedily: by depth, position and key; a group that touches a used path is left out.

    The choice is made in rounds for all sites at once.  A group is taken when no
    smaller group that is still open touches any of its paths; groups that share a
    path with it are out.  Each round is written to the shared folder, and no site
    or group is gathered in one task.
    """
    groups = single_position_patterns(paths, site, path)
    distinct = paths.select(site, path).distinct().withColumn("s", segments(F.col(path)))
    each = distinct.select(site, path, "s", F.size("s").alias("depth"), F.posexplode("s").alias("position", "value"))
    rest = F.array_join(F.concat(F.slice("s", 1, F.col("position")), F.array(F.lit("*")), F.slice("s", F.col("position") + 2, F.col("depth"))), "/")
    keys = [site, "depth", "position", "rest"]
    known = each.withColumn("rest", rest).join(groups.select(*keys), keys)
    open_ = cut_lineage(known.select(site, path, F.struct("depth", "position", "rest").alias("group")))
    taken = []
    while not open_.isEmpty():
        least = open_.groupBy(site, path).agg(F.min("group").alias("least"))
        judged = open_.join(least, [site, path]).groupBy(site, "group").agg(F.bool_and(F.col("group") == F.col("least")).alias("first"))
        taken.append(cut_lineage(judged.where("first").select(site, "group")))
        used = open_.join(taken[-1], [site, "group"], "left_semi").select(site, path).distinct()
        out = open_.join(used, [site, path], "left_semi").select(site, "group").distinct()
        open_ = cut_lineage(open_.join(out, [site, "group"], "left_anti"))
    if not taken:
        return groups.select(site, "pattern", "n_paths").limit(0)
    every = reduce(DataFrame.unionByName, taken).select(site, "group.*")
    return groups.join(every, keys, "left_semi").select(site, "pattern", "n_paths")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a running number per group, from 1, however many rows a group has.

    Rows are cut into ranges; each range is numbered on its own and starts where
    those before it end, so a group with most of the rows is many tasks' work.
    """
    ranged = cut_lineage(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *by).agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *by, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    placed = own.withColumnsRenamed({c: f"_b{i}" for i, c in enumerate(by)})
    on = placed["_range"] == offsets["_range"]
    for i, c in enumerate(by):
        on = on & F.col(f"_b{i}").eqNullSafe(offsets[c])
    joined = placed.join(offsets, on)
    names = {c: f"_b{i}" for i, c in enumerate(by)}
    return joined.select(*[F.col(names[c]).alias(c) if c in names else F.col(c) for c in rows.columns], (F.col("_own") + F.col("_before")).alias(name))


def parents_by_depth(rows: DataFrame, by: Sequence[str], seq: str, depth: str, most_depth: int = 10) -> DataFrame:
    """``rows`` with ``parent_seq``: the last row before with a smaller depth; one running value per depth, no self-join.

    A row of a depth beyond ``most_depth`` is an error, as its parent would be unknown.
    """
    before = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.max(F.when(F.col(depth) == d, F.col(seq))).over(before) for d in range(most_depth)]
    none = F.lit(None).cast(rows.schema[seq].dataType)
    best = F.greatest(none, none, *[F.when(F.col(depth) > d, x) for d, x in enumerate(lasts)])
    deep = F.raise_error(F.concat(F.lit(f"rows are deeper than {most_depth}: "), F.col(depth).cast("string"))).cast(rows.schema[seq].dataType)
    return rows.withColumn("parent_seq", F.when(F.col(depth) > most_depth, deep).otherwise(best))


def depth_from_roots(edges: DataFrame, parent: str, child: str, roots: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (node, depth) reachable from ``roots`` in ``most`` steps at most; the smallest depth of each node.

    Each step's state is written to the shared folder, so plans stay short and a
    lost executor costs one step; cycles end when nothing new is found.
    """
    seen = cut_lineage(roots.select(F.col(key).alias("node")).distinct().withColumn("depth", F.lit(0)))
    for step in range(1, most + 1):
        level = seen.where(F.col("depth") == step - 1)
        following = level.join(edges, level["node"] == edges[parent]).select(F.col(child).alias("node")).distinct()
        new = following.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        longer = cut_lineage(seen.unionByName(new))
        if longer.where(F.col("depth") == step).isEmpty():
            return seen
        seen = longer
    return seen


def variants(rows: DataFrame, by: str, classes: str) -> DataFrame:
    """Per group the classes that all instances share, and the number of instances with others."""
    n = rows.groupBy(by).agg(F.count("*").alias("n_instances"))
    spread = rows.select(by, F.explode(F.array_distinct(classes)).alias("c")).groupBy(by, "c").agg(F.count("*").alias("n"))
    shared = spread.join(n, by).where("n = n_instances").groupBy(by).agg(F.array_sort(F.collect_list("c")).alias("shared"))
    return n.join(shared, by, "left").select(by, "n_instances", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))
