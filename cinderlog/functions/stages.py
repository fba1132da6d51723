"""Column computation in stages.

Catalyst pushes a filter through a projection by substituting the column's expression, so a
later ``filter(status = 'event')`` would parse every line twice, and a chain of columns that
each use the one before more than once would grow exponentially.  ``pinned`` ends such a chain:
its columns come out of an ``inline`` generator, through which predicates on them are not pushed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns, each of them computed exactly once per row."""
    kept = [F.col(f"`{name}`") for name in frame.columns if name not in columns]
    fields = [column.alias(name) for name, column in columns.items()]
    return frame.select(*kept, F.inline(F.array(F.struct(*fields))))
