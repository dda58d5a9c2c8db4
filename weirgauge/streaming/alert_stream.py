"""Candidates of the touched ticks → cooldown → outbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.config import TICK_SECS, WINDOW_SECS
from weirgauge.functions.clock import MICROS, date_of_ms
from weirgauge.operators.alerts import alert_outbox, number_alerts
from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.schema import FIRED_COLUMNS
from weirgauge.streaming.metrics_stream import (
    DAY, FIRED_SCHEMA, Span, current_candidates, days_of, in_spans, joined_spans, last_tick_us, newest_moment,
)
from weirgauge.streaming.tables import BATCH, read_parts, read_table, write_batch

OPEN = "open"  # 1: sent at the end of the input, for the tick that was still open
SENT_SCHEMA = T.StructType([
    *FIRED_SCHEMA.fields, T.StructField("payload", T.StringType()), T.StructField(DAY, T.DateType()),
    T.StructField(OPEN, T.IntegerType())])
ALERT = ["rule", "target_ip", "triggered_at"]


def _at() -> Column:
    return F.unix_micros("triggered_at")


def deliver(spark: SparkSession, root: str, batch_id: int, spans: Sequence[Span], cooldown_secs: int = 60,
            still_open: bool = False) -> None:
    """Put alerts of the ticks in ``spans`` into the outbox, those that were not sent
    before. What was sent in the cooldown before a span still suppresses; an alert that
    late flows call into question stays sent."""
    quiet = cooldown_secs * MICROS
    spans = joined_spans(spans, quiet)  # else what one span fires would suppress in the next
    wide = [(low - quiet, high) for low, high in spans]
    path = f"{root}/outbox"
    sent = read_parts(spark, path, SENT_SCHEMA, DAY, days_of(wide)).where(
        (F.col(BATCH) < batch_id) | ((F.col(BATCH) == batch_id) & (F.col(OPEN) < int(still_open)))
    ).where(in_spans(_at(), wide)).select(*FIRED_COLUMNS)
    before = sent.where(~in_spans(_at(), spans))
    due = current_candidates(spark, root, batch_id, wide).where(in_spans(_at(), spans))
    fired = apply_cooldown(before.unionByName(due), cooldown_secs).where(in_spans(_at(), spans))
    mine, known = fired.alias("f"), sent.select(*ALERT).alias("s")
    same = F.lit(True)
    for column in ALERT:
        same = same & F.col(f"f.{column}").eqNullSafe(F.col(f"s.{column}"))
    new = mine.join(known, same, "left_anti")
    payload = alert_outbox(new, "severity", "target_ip", "window_secs", "indicators")
    day = date_of_ms(F.unix_millis("triggered_at"))
    write_batch(payload.withColumn(DAY, day).withColumn(OPEN, F.lit(int(still_open))).select(*SENT_SCHEMA.fieldNames()),
                path, batch_id, [DAY, OPEN])


def deliver_batch(spark: SparkSession, root: str, batch_id: int, spans: Sequence[Span], cooldown_secs: int = 60,
                  tick_secs: int = TICK_SECS, windows: Sequence[int] = WINDOW_SECS) -> None:
    """Alerts of the ticks that a batch with flows in ``spans`` has touched or closed. A
    tick is closed when a flow at or after it has come in; of the ticks closed now only
    those whose windows reach back to a flow can have alerts."""
    newest, former = newest_moment(spark, root, batch_id), newest_moment(spark, root, batch_id - 1)
    step, reach = tick_secs * MICROS, max(windows) * MICROS
    closed = newest // step * step
    touched = [(last_tick_us(low, tick_secs), high + reach) for low, high in spans]
    if former is not None:
        touched.append((former // step * step + step, former + reach))
    due = [(low, min(high, closed)) for low, high in touched if low <= closed]
    if due:
        deliver(spark, root, batch_id, due, cooldown_secs)


def deliver_rest(spark: SparkSession, root: str, batch_id: int, cooldown_secs: int = 60, tick_secs: int = TICK_SECS) -> None:
    """At the end of the input: alerts of the tick that is still open."""
    newest = newest_moment(spark, root, batch_id)
    if newest is not None and newest % (tick_secs * MICROS):
        last = last_tick_us(newest, tick_secs)
        deliver(spark, root, batch_id, [(last, last)], cooldown_secs, still_open=True)


def stored_alerts(spark: SparkSession, root: str, cooldown_secs: int = 60, tick_secs: int = TICK_SECS) -> DataFrame:
    """Numbered alerts of all flows received so far, up to the tick of the newest: what
    the batch engine finds in them, whenever they came in."""
    newest = newest_moment(spark, root) or 0
    due = current_candidates(spark, root).where(_at() <= last_tick_us(newest, tick_secs))
    return number_alerts(apply_cooldown(due, cooldown_secs))


def sent_alerts(spark: SparkSession, root: str) -> DataFrame:
    """The outbox: payloads in the order of their ticks, each alert once."""
    return read_table(spark, f"{root}/outbox", SENT_SCHEMA).select(*FIRED_COLUMNS, "payload")
