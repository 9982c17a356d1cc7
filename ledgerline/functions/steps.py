"""Columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns added or replaced, as a step of its own.

    A chain of projections is merged by the optimizer, and where each step uses the last one's result several times, the merged
    expression grows without bound. A generator over a single struct is not merged, so each step is evaluated once a row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
