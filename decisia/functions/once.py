"""Columns that are evaluated once a row.

The optimizer pushes a filter below a projection by writing the column's expression into the filter, and again for each level
of columns it stands on; with parsed JSON on three levels the same text is then parsed dozens of times. A generator of one row
is a line that filters and inlining don't cross, and it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with these columns added or replaced, each evaluated once."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
