"""Orders as a reader expects them: accents and capitals beside their letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.site import numbered

#: The collation of the root locale.
LOCALE = "UNICODE"


def localed(c: Column | str, collation: str = LOCALE) -> Column:
    """A text that sorts and compares by a collation; equal texts are still told apart by their code points."""
    return F.collate(c, collation)


def placed(rows: DataFrame, by: Sequence[str], keys: Sequence[str], name: str, collation: str | None = LOCALE) -> DataFrame:
    """``rows`` with their place, from 1, among those of ``by``: by ``keys`` in a collation, then by code points; None: by code points alone.

    Rows are cut into ranges of these keys, so a group with most of the rows is
    many tasks' work.
    """
    if collation is None:
        return numbered(rows, by, keys, name)
    made = {f"_l{i}": localed(F.col(k), collation) for i, k in enumerate(keys)}
    return numbered(rows.withColumns(made), by, [*made, *keys], name).drop(*made)
