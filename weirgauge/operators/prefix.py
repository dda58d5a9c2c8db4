"""Running totals and row numbers over a whole ordered table, in parallel.

A window without partition columns would sort everything in one task. Here the
table is cut into blocks of its ordering column, blocks are summed up (one row
each), and every block then starts from the total of its predecessors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    rows: DataFrame, block: Column, order: Sequence[Column], amounts: dict[str, Column], per: Sequence[str] = ()
) -> DataFrame:
    """Add one running total per entry of ``amounts``, separately for each value
    of ``per``. ``block`` must not decrease along ``order``."""
    names = list(amounts)
    blocked = rows.withColumn("_block", block)
    for name in names:
        blocked = blocked.withColumn(f"_v_{name}", amounts[name])
    sums = blocked.groupBy(*per, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    # One row per block: bounded by the length of the timeline, not by the data.
    before = Window.partitionBy(*per).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*per, "_block", *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    within = (
        Window.partitionBy(*per, "_block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return blocked.join(starts, [*per, "_block"]).select(
        *rows.columns,
        *[(F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(within)).cast("bigint").alias(n) for n in names])
