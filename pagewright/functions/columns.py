"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]




def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def record(**fields: Column) -> Column:
    """A struct with these fields; names hold wherever the expression is put."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])
