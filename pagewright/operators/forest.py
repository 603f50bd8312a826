"""Forests as rows: orders of nodes by sorted path keys, nested values folded from the leaves up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_nodes(rows: DataFrame, by: str, path: str, separator: str = "/") -> DataFrame:
    """Every path and every beginning of one, once for each ``by``: (by, segments, name, depth, is_file, n_children).

    Beginnings are counted before the shuffle, so a folder with most of the files is
    one row for each task.
    """
    parts = rows.select(by, F.split(path, separator).alias("p"))
    every = parts.select(by, F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.slice("p", F.lit(1), i).alias("segments"), (i == F.size("p")).alias("is_file")))).alias("n"))
    nodes = every.groupBy(by, "n.segments").agg(F.bool_or("n.is_file").alias("is_file"))
    above = F.slice("segments", F.lit(1), F.size("segments") - 1)
    children = nodes.where(F.size("segments") > 1).groupBy(F.col(by).alias("_by"), above.alias("_above")).agg(F.count("*").alias("n_children"))
    joined = nodes.join(children, nodes[by].eqNullSafe(F.col("_by")) & (F.col("segments") == F.col("_above")), "left")
    return joined.select(by, "segments", F.element_at("segments", -1).alias("name"), (F.size("segments") - 1).alias("depth"), "is_file", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def numbered_nodes(nodes: DataFrame, by: str) -> DataFrame:
    """``nodes`` with n_below, pre and post: places, from 0, before and after all that lies below.

    Sorted path keys are in pre-order; the post-order follows from it, the depth
    and the number of nodes below.  Node b lies below a if its pre is between a's
    pre and a's pre + n_below.
    """
    pre = F.row_number().over(Window.partitionBy(by).orderBy("segments")) - 1
    ups = nodes.select(F.col(by).alias("_by"), F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda i: F.slice("segments", F.lit(1), i))).alias("_up"))
    below = ups.groupBy("_by", "_up").agg((F.count("*") - 1).alias("n_below"))
    sized = nodes.join(below, nodes[by].eqNullSafe(F.col("_by")) & (F.col("segments") == F.col("_up"))).drop("_by", "_up")
    return sized.withColumn("pre", pre).withColumn("post", F.col("pre") + F.col("n_below") - F.col("depth"))


def tree_text(nodes: DataFrame, by: str, indent: str = "  ") -> DataFrame:
    """The tree of each ``by`` as indented lines, folders with a stroke: (by, text).  A tree is one value."""
    folder = (F.col("n_children") > 0) & ~F.col("is_file")
    line = F.concat(F.repeat(F.lit(indent), F.col("depth")), "name", F.when(folder, "/").otherwise(""))
    lines = nodes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("segments", line.alias("line")))).alias("l"))
    return lines.select(by, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def nested(rows: DataFrame, by: list[str], ident: str, parent: str, order: str, depth: str, fields: Column, most_depth: int, children: str = "children") -> DataFrame:
    """Rows (by..., tree): the rows of each ``by`` as one nested JSON array, folded level by level from the deepest.

    ``parent`` names the ``ident`` of a row of smaller ``depth``, or is null; rows of
    one parent come in ``order``.  ``fields`` is the struct of a row's own fields.
    Each level's rows meet their parents by one join of what is left of them; a
    depth beyond ``most_depth`` is an error.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    plain = F.to_json(fields)
    deep = F.when(F.col(depth) > most_depth, F.raise_error(F.lit(f"rows are deeper than {most_depth}")).cast("int")).otherwise(F.col(depth))
    kid = "array<struct<o:bigint,j:string>>"
    left = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(ident).alias("_id"), F.col(parent).alias("_up"), F.col(order).cast("bigint").alias("_o"), deep.alias("_d"), plain.alias("_own"), F.array().cast(kid).alias("_kids"))

    def text(own: Column, kids: Column) -> Column:
        inside = F.substring(own, F.lit(1), F.length(own) - 1)
        listed = F.array_join(F.transform(F.array_sort(kids), lambda k: k["j"]), ",")
        comma = F.when(own == "{}", "").otherwise(",")
        return F.when(F.size(kids) == 0, own).otherwise(F.concat(inside, comma, F.lit(f'"{children}":['), listed, F.lit("]}")))

    for d in range(most_depth, 0, -1):
        here = left.where((F.col("_d") == d) & F.col("_up").isNotNull())
        done = here.groupBy(*[F.col(k).alias(f"{k}p") for k in keys], F.col("_up").alias("_idp")).agg(F.collect_list(F.struct(F.col("_o").alias("o"), text(F.col("_own"), F.col("_kids")).alias("j"))).alias("_more"))
        rest = left.where((F.col("_d") < d) | F.col("_up").isNull())
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}p")) for k in keys], F.col("_id") == F.col("_idp"))
        merged = F.concat("_kids", F.coalesce("_more", F.array().cast(kid)))
        left = rest.join(done, same, "left").select(*keys, "_id", "_up", "_o", "_d", "_own", merged.alias("_kids"))
    whole = left.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), text(F.col("_own"), F.col("_kids")).alias("j")))).alias("l"))
    return whole.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("tree"))
