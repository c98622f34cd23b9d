"""Counts of a flow that arrive with its own write: no extra pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Accounting:
    """Counts taken where rows pass by. ``at`` marks a point of a flow; after the flow has been written once, ``rows`` has every number.

    The counts are collected by the tasks that do the work and sent with their results, so a flow with any number of points scans its source once. They
    belong to the first action on the marked frame. A task that runs again because its executor was lost is counted once, a whole stage that
    runs again may be counted twice: read ``rows`` as exact only for runs without lost stages.
    """

    def __init__(self):
        self.points: list[tuple[str, Observation]] = []

    def at(self, df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        """``df``, its rows counted as (stage, ``rows``), and under the given names the rows for which a condition holds."""
        point = Observation()
        self.points.append((stage, point))
        return df.observe(point, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])

    def rows(self) -> list[tuple[str, str, int]]:
        """(stage, name, n) in the order of the points; waits for the action that fills them."""
        return [(stage, name, int(n)) for stage, point in self.points for name, n in point.get.items()]
