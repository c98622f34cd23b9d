"""Computing a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_values(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns whose expressions are evaluated exactly once per row.

    A plain projection is merged into the filters and projections above it, which then repeat its expressions: fine for
    arithmetic, costly for regular expressions over long texts. The one-row generator keeps them apart and stays
    inside the same stage.
    """
    kept = [c for c in df.columns if c not in columns]
    values = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*kept, F.inline(values))
