"""Sliding-window state per key as spans of ticks instead of repeated rows.

A partial result at one instant enters every window of W seconds at its first
tick and leaves after its last one. In tick order these enter and leave amounts
add up to the key's running level, which is constant between change points. A
busy key thus yields one span per tick instead of W/tick copies of each of its
partials. Counting keys needs even less: each partial only adds the ticks that
the key's previous partial does not reach.

Timelines are cut into segments; a partial near a border goes to both sides.
That bounds the rows of one (key, segment) by the ticks of a segment, so a key
present in all of the data is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.config import TICK_SECS
from weirgauge.functions.clock import MICROS
from weirgauge.functions.numbers import ceil_to, floor_to

SEGMENT_TICKS = 360

# Sorting compares a binary prefix of the first column before anything else. So
# windows are partitioned by the columns with the most values first.


def _segment_us(reaches: dict[int, int], tick_us: int, segment_ticks: int) -> int:
    return max(segment_ticks, -(-max(reaches.values()) // tick_us)) * tick_us


def place_partials(
    partials: DataFrame, keys: Sequence[str], reaches: dict[int, int], tick_secs: int = TICK_SECS,
    segment_ticks: int = SEGMENT_TICKS,
) -> DataFrame:
    """Bring all partials of a key and segment together.

    ``partials`` has the keys, ``moment_us`` and optionally an ``amount``;
    ``reaches`` maps a window label to the microseconds a partial stays visible.
    The exchange here is the only one: all that follows is grouped by a superset
    of these columns and stays where it is.
    """
    tick_us = tick_secs * MICROS
    segment_us = _segment_us(reaches, tick_us, segment_ticks)
    first = ceil_to(F.col("moment_us"), tick_us)
    final = floor_to(F.col("moment_us") + max(reaches.values()), tick_us)
    segments = F.sequence(
        F.call_function("div", first, F.lit(segment_us)), F.call_function("div", final, F.lit(segment_us)))
    return (
        partials.where(first <= final)
        .select(*partials.columns, F.explode(segments).alias("segment"))
        .repartition(*[F.col(c) for c in (*keys, "segment")])
    )


def _lives(moment: Column, reaches: dict[int, int], tick_us: int, segment_us: int,
           after: Column | None = None) -> Column:
    """Per window: ticks [enter, leave) of a partial inside its segment. With
    ``after``, the moment of an earlier partial, only ticks which that misses."""
    opens, closes = F.col("segment") * segment_us, (F.col("segment") + 1) * segment_us

    def gone(instant: Column, reach: int) -> Column:
        return floor_to(instant + reach, tick_us) + tick_us

    def enter(reach: int) -> Column:
        # greatest() skips the NULL of a missing predecessor.
        bounds = [ceil_to(moment, tick_us), opens, *([] if after is None else [gone(after, reach)])]
        return F.greatest(*bounds)

    return F.array(*[
        F.struct(F.lit(label).cast("bigint").alias("window_secs"), enter(reach).alias("from_us"),
                 F.least(gone(moment, reach), closes).alias("to_us"))
        for label, reach in reaches.items()
    ])


def presence_spans(
    placed: DataFrame, keys: Sequence[str], reaches: dict[int, int], tick_secs: int = TICK_SECS,
    segment_ticks: int = SEGMENT_TICKS,
) -> DataFrame:
    """Disjoint spans ``[from_us, to_us)`` of ticks at which a key is in the window."""
    tick_us = tick_secs * MICROS
    owned = [*keys, "segment"]
    before = F.lag("moment_us").over(Window.partitionBy(*owned).orderBy("moment_us"))
    rows = placed.withColumn("before_us", before)
    if "amount" in placed.columns:
        # Amounts are never negative. Asking for them keeps the column, and so
        # keeps this branch equal to the one that sums amounts up to and
        # including the exchange, which Spark then runs once for both.
        rows = rows.where("amount >= 0")
    lives = _lives(F.col("moment_us"), reaches, tick_us, _segment_us(reaches, tick_us, segment_ticks), F.col("before_us"))
    return (
        rows.select(*owned, F.explode(lives).alias("life")).where("life.from_us < life.to_us")
        .select(*owned, "life.*")
    )


def _running(changes: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Change points → spans with the running amounts.

    The window sizes of a key share one sorted group, as many keys have only a
    few changes. That is sound because all that enters a window also leaves it:
    the running amounts are back at zero when the next window size begins.
    Changes at one instant leave empty spans behind; the last has the full amount.
    """
    order = Window.partitionBy(*keys, "segment").orderBy("window_secs", "at_us")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.select(
        *keys, "window_secs", "segment",
        F.col("at_us").alias("from_us"),
        F.lead("at_us").over(order).alias("to_us"),
        *[F.sum(a).over(so_far).alias(a) for a in amounts],
    ).where("from_us < to_us")


def amount_spans(
    placed: DataFrame, keys: Sequence[str], reaches: dict[int, int], tick_secs: int = TICK_SECS,
    segment_ticks: int = SEGMENT_TICKS,
) -> DataFrame:
    """Spans of constant window sum (``amount``) per key."""
    tick_us = tick_secs * MICROS
    group = [*keys, "window_secs", "segment"]
    lives = _lives(F.col("moment_us"), reaches, tick_us, _segment_us(reaches, tick_us, segment_ticks))
    ends = F.array(
        F.struct(F.col("life.from_us").alias("at_us"), F.lit(1).alias("members"), F.col("amount").alias("amount")),
        F.struct(F.col("life.to_us").alias("at_us"), F.lit(-1).alias("members"), (-F.col("amount")).alias("amount")),
    )
    changes = (
        placed.select("segment", *keys, "amount", F.explode(lives).alias("life"))
        .where("life.from_us < life.to_us")
        .select("segment", *keys, "life.window_secs", F.explode(ends).alias("end"))
        .select(*group, "end.*")
    )
    return _running(changes, keys, ["members", "amount"]).where("members > 0").drop("members")


def count_spans(spans: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many spans are open per ``keys`` over time, again as spans.

    Only the change points are shuffled, and they are pre-added per task.
    """
    group = [*keys, "window_secs", "segment"]
    ends = F.array(
        F.struct(F.col("from_us").alias("at_us"), F.lit(1).alias("step")),
        F.struct(F.col("to_us").alias("at_us"), F.lit(-1).alias("step")),
    )
    changes = (
        spans.select(*group, F.explode(ends).alias("end"))
        .groupBy(*group, F.col("end.at_us").alias("at_us"))
        .agg(F.sum(F.col("end.step").cast("bigint")).alias(name))
    )
    return _running(changes, keys, [name]).where(F.col(name) > 0)


def at_ticks(spans: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    """Spans → one row per tick they cover."""
    tick_us = tick_secs * MICROS
    kept = [c for c in spans.columns if c not in ("from_us", "to_us", "segment")]
    ticks = F.sequence(F.col("from_us"), F.col("to_us") - tick_us, F.lit(tick_us))
    return spans.select(*kept, F.explode(ticks).alias("tick_us"))
