"""Rows of any columns, taken by place: names with dots, repeated names and types without an order do no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def place(df: DataFrame, name: str) -> int:
    """Where column ``name`` stands; a name in other case will do if there is no exact one."""
    names = df.columns
    if name in names:
        return names.index(name)
    return [c.lower() for c in names].index(name.lower())


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> T.DataType:
    """The type of column ``name``."""
    return df.schema.fields[place(df, name)].dataType


def chosen(df: DataFrame, **named: str) -> DataFrame:
    """The columns of ``df`` that ``named`` gives (new name = old name)."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return inner.select(*[F.col(f"c{place(df, old)}").alias(new) for new, old in named.items()])


def packed(df: DataFrame, **named: str) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, and those that ``named`` gives (new name = old name)."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    # a column that is null throughout has a type that no file can hold
    own = [F.col(f"c{i}").cast("string").alias(f"c{i}") if isinstance(f.dataType, T.NullType) else F.col(f"c{i}") for i, f in enumerate(df.schema.fields)]
    return inner.select(F.struct(*own).alias("row"), *[F.col(f"c{place(df, old)}").alias(new) for new, old in named.items()])


def unpacked(found: DataFrame, df: DataFrame, *made: str, **changed: Column) -> DataFrame:
    """The columns of ``df`` out of ``row``, then columns ``made`` of ``found``.

    Columns of ``df`` that are named like one of ``made`` give way to it;
    ``changed`` has columns over ``found`` that stand for a column of ``df``.
    """
    new = {m.lower() for m in made}
    own = [(i, c) for i, c in enumerate(df.columns) if c.lower() not in new]
    at = {place(df, c): value for c, value in changed.items()}
    return found.select(*[at.get(i, F.col(f"row.c{i}")).alias(f"c{i}") for i, _ in own], *map(_named, made)).toDF(*[c for _, c in own], *made)


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    """A schema of (name, type) pairs, types as such or as in DDL."""
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t) if isinstance(t, str) else t) for n, t in fields])
