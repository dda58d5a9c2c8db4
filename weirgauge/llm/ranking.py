"""Row numbers over a whole ordered table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.storage import settle

_PLACE_BITS = 33  # of monotonically_increasing_id within a partition


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Add ``name``, 0 for the first row by ``order``.

    Rows are sorted by range and numbered within their partitions; each partition then
    starts after those before it. What is gathered is one row per partition. Rows that
    ``order`` does not part are numbered in any order. The result is a settled table.
    """
    marked = settle(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # A row per write task, some bytes each, whatever the size of the table.
    return marked.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        *rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).alias(name))
