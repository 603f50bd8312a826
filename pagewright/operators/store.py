"""Keyed tables: upserts, deletes, constraints, state machines and migrations over DataFrames.

Tables are immutable; each operation gives the next state of a table, to be
written beside the old one.  The order in which rows came is a column, ``seq``:
later rows win, and ties go to the larger row, so a result never depends on how
rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Legal changes of a scan's state.
TRANSITIONS = (("pending", "in_progress"), ("pending", "cancelled"), ("pending", "failed"), ("in_progress", "completed"), ("in_progress", "failed"), ("in_progress", "cancelled"))
TERMINAL = ("completed", "failed", "cancelled")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], keep_old_when_null: Sequence[str] = (), keep_first: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """``current`` after ``changes`` in the order of ``seq``: one row per key.

    Of columns in ``keep_old_when_null`` the last value that is not null counts,
    of those in ``keep_first`` the first that is not null, of others the last
    row's.  Rows with a null in the key never meet and all stay.  Values are
    aggregated, so a key with many changes is combined before the shuffle.
    """
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    others = [c for c in current.columns if c not in keys]
    order = F.struct("_new", seq)
    last = F.max(F.struct(order.alias("o"), F.struct(*others).alias("r")))
    picks = [F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(f"_last_{c}") for c in keep_old_when_null]
    picks += [F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(f"_first_{c}") for c in keep_first]
    merged = rows.where(whole).groupBy(*keys).agg(last.alias("_row"), *picks)

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in keep_old_when_null:
            return F.col(f"_last_{c}")["v"].alias(c)
        if c in keep_first:
            return F.col(f"_first_{c}")["v"].alias(c)
        return F.col("_row")["r"][c].alias(c)

    return merged.select(*[value(c) for c in current.columns]).unionByName(rows.where(~whole).select(*current.columns))


def patch(current: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``current`` with the values of ``patches`` that are not null; keys without a row change nothing."""
    fields = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = current.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns])


def delete_cascade(parents: DataFrame, children: Sequence[tuple[DataFrame, str]], key: str, doomed: Column) -> tuple[DataFrame, list[DataFrame]]:
    """``parents`` without the rows where ``doomed`` holds, and each of ``children`` without theirs."""
    gone = parents.where(doomed).select(F.col(key).alias("_gone")).distinct()
    left = [c.join(gone, c[fk] == gone["_gone"], "left_anti") for c, fk in children]
    return parents.where(~F.coalesce(doomed, F.lit(False))), left


def newest(rows: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per group, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max(F.struct(order.alias("o"), F.struct(*others).alias("r"))).alias("b"))
    return best.select(*by, *[F.col("b.r")[c].alias(c) for c in others])


def violations_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number; nulls never conflict."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations_reference(rows: DataFrame, parents: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose reference is not null and has no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")


def can_transition(before: Column, after: Column) -> Column:
    legal = before == after
    for a, b in TRANSITIONS:
        legal = legal | ((before == a) & (after == b))
    return legal


def transition_errors(changes: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """``changes`` whose state does not follow from the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(seq))
    return changes.withColumn("before", before).where(F.col("before").isNotNull() & ~can_transition(F.col("before"), F.col(state)))


def pending_migrations(known: DataFrame, applied: DataFrame) -> DataFrame:
    """Known versions (version, checksum) with state pending, applied or mismatch."""
    done = applied.select(F.col("version").alias("_v"), F.col("checksum").alias("_c"))
    state = F.when(F.col("_v").isNull(), "pending").when(F.col("_c") != F.col("checksum"), "mismatch").otherwise("applied")
    return known.join(done, F.col("version") == F.col("_v"), "left").select("version", "checksum", state.alias("state"))
