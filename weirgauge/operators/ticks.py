"""Epoch-aligned ticks and the assignment of events to sliding windows.

All spans are integer microseconds since the epoch. A window of W seconds read
at tick T holds every event with T-W <= t <= T: both edges belong to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.config import TICK_SECS, WINDOW_SECS
from weirgauge.functions.clock import MICROS, timestamp_of_us
from weirgauge.functions.numbers import ceil_to, floor_to


def event_us(flows: DataFrame) -> Column:
    return F.unix_micros(flows["received_at"])


def first_tick(moment_us: Column, tick_secs: int) -> Column:
    return ceil_to(moment_us, tick_secs * MICROS)


def last_tick(moment_us: Column, window_secs: int, tick_secs: int) -> Column:
    return floor_to(moment_us + window_secs * MICROS, tick_secs * MICROS)


def pane_secs(windows: Sequence[int], tick_secs: int) -> int:
    """Widest pane whose borders include every window edge."""
    return gcd(tick_secs, *windows)


def pane_moment(moment_us: Column, width_secs: int) -> Column:
    """One instant standing for all events that fall into the same windows.

    Window edges lie on pane borders, so only the borders themselves need to
    stay apart from the pane interior: the interior maps to its midpoint.
    """
    start = floor_to(moment_us, width_secs * MICROS)
    return F.when(moment_us == start, start).otherwise(start + width_secs * MICROS // 2)


def expand_windows(
    rows: DataFrame, moment: str, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS
) -> DataFrame:
    """One output row per (input row, window size, tick that sees it); adds
    ``window_secs`` and ``tick_us``, drops ``moment``."""
    spans = F.array(*[
        F.struct(
            F.lit(w).cast("bigint").alias("window_secs"),
            first_tick(F.col(moment), tick_secs).alias("first"),
            last_tick(F.col(moment), w, tick_secs).alias("last"),
        ) for w in windows
    ])
    kept = [c for c in rows.columns if c != moment]
    return (
        rows.select(*kept, F.explode(spans).alias("span"))
        # A tick spacing above the window leaves gaps that no window covers.
        .where("span.first <= span.last")
        .select(*kept, "span.window_secs",
                F.explode(F.sequence("span.first", "span.last", F.lit(tick_secs * MICROS))).alias("tick_us"))
    )


def assign_windows(
    flows: DataFrame, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS
) -> DataFrame:
    """Flows repeated once per window they belong to. The aggregates go through
    panes instead, which repeat partial sums rather than flows."""
    timed = flows.withColumn("moment_us", event_us(flows))
    expanded = expand_windows(timed, "moment_us", windows, tick_secs)
    return expanded.withColumn("tick", timestamp_of_us(F.col("tick_us"))).drop("tick_us")


def unrolled_ticks(bounds: DataFrame, windows: Sequence[int], tick_secs: int) -> DataFrame:
    """Every (window size, tick) from ``low`` to ``high``, two ticks in microseconds in
    a single row. The timeline is cut into stretches that tasks unroll side by side."""
    step = tick_secs * MICROS
    stretch = 1024 * step
    sizes = F.array(*[F.lit(w).cast("bigint") for w in windows])
    stretches = bounds.where(F.col("low").isNotNull()).select(
        "high", F.explode(F.sequence("low", "high", F.lit(stretch))).alias("begin")).repartition("begin")
    ticks = F.sequence(F.col("begin"), F.least(F.col("high"), F.col("begin") + stretch - step), F.lit(step))
    return stretches.select(F.explode(ticks).alias("tick_us")).select(F.explode(sizes).alias("window_secs"), "tick_us")


def tick_spine(
    flows: DataFrame, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS
) -> DataFrame:
    """Every (window size, tick) from the first to the last tick of the data."""
    moment = event_us(flows)
    return unrolled_ticks(flows.agg(
        first_tick(F.min(moment), tick_secs).alias("low"), first_tick(F.max(moment), tick_secs).alias("high")),
        windows, tick_secs)
