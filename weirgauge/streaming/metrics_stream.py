"""Flows of a micro-batch → pane sums → metrics and candidates of the ticks they touch.

Pane sums of every batch are kept as partial rows that add up, by hour. A batch computes
anew the windows that its flows fall into, from its own and all earlier partial rows of
the hours around its flows, with the operators of the batch engine. Hours between, as
between a stray old flow and today's, are not looked at, and the partial rows of many
batches are merged tier by tier. Whatever order flows arrive in, from however many
sources, and however late, every window is complete after the batch that brings its
last flow, nothing is dropped, and nothing waits for later traffic.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.config import TICK_SECS, WINDOW_SECS, DetectionConfig
from weirgauge.functions.clock import MICROS, date_of_ms, timestamp_of_us
from weirgauge.operators.flow_queries import exporter_last_seen, flow_totals
from weirgauge.operators.panes import PANE_SCHEMA, merge_panes, pane_contacts, pane_metrics, pane_rows
from weirgauge.operators.rules import route_rules, scan_windows, scanners_in, with_scanners
from weirgauge.operators.ticks import expand_windows
from weirgauge.operators.views import ARRIVED, exporter_moments, tick_arrivals
from weirgauge.schema import ALERT_SCHEMA, FIRED_COLUMNS, METRIC_COLUMNS, WINDOW_METRICS_SCHEMA
from weirgauge.streaming.tables import (
    BATCH, read_batch, read_own, read_parts, read_table, read_tiered, write_batch, write_tiered,
)

DAY = "day"  # of a tick
HOUR = "hour"  # of a pane moment, since the epoch
HOUR_US = 3600 * MICROS
_PANES = T.StructType([*PANE_SCHEMA.fields, T.StructField(HOUR, T.LongType())])
_METRICS = T.StructType([*WINDOW_METRICS_SCHEMA.fields, T.StructField(DAY, T.DateType())])
FIRED_SCHEMA = T.StructType([f for f in ALERT_SCHEMA.fields if f.name in FIRED_COLUMNS])
_CANDIDATES = T.StructType([*FIRED_SCHEMA.fields, T.StructField(DAY, T.DateType())])
PROGRESS_SCHEMA = T.StructType([T.StructField("newest_us", T.LongType())])
EXPORTERS_SCHEMA = T.StructType([T.StructField("exporter_ip", T.StringType()), T.StructField("last_seen", T.TimestampType())])
DATE = "date_number"  # days since the epoch
ARRIVALS_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("tick_us", *ARRIVED, DATE)])
PRESENCE_SCHEMA = T.StructType([
    T.StructField("moment_us", T.LongType()), T.StructField("exporter_ip", T.StringType()), T.StructField(DATE, T.LongType())])
TOTALS_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("flows", "packets", "bytes")])


def _day(micros: Column) -> Column:
    return date_of_ms(F.call_function("div", micros, F.lit(1000)))


Span = tuple[int, int]  # first and last microsecond


def _units(spans: Sequence[Span], unit_us: int) -> list[int]:
    return sorted({n for low, high in spans for n in range(low // unit_us, high // unit_us + 1)})


def days_of(spans: Sequence[Span]) -> list[dt.date]:
    """The days that spans lie in."""
    return [dt.date(1970, 1, 1) + dt.timedelta(days=n) for n in _units(spans, 24 * HOUR_US)]


def joined_spans(spans: Sequence[Span], gap_us: int) -> list[Span]:
    """Spans in order, those that are ``gap_us`` or less apart as one."""
    out: list[Span] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + gap_us:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def in_spans(micros: Column, spans: Sequence[Span]) -> Column:
    """Whether a moment lies in one of a batch's spans, of which there are few."""
    listed = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in spans])
    return F.exists(listed, lambda span: micros.between(span["low"], span["high"]))


def touched_spans(moments: DataFrame, cell_us: int) -> list[Span]:
    """The moments of a batch as spans. What reaches the driver is a row per ``cell_us``
    of time that has flows."""
    cell = F.floor(F.col("moment_us") / cell_us)
    found = moments.groupBy(cell.alias("cell")).agg(F.min("moment_us").alias("low"), F.max("moment_us").alias("high"))
    return joined_spans([(r["low"], r["high"]) for r in found.collect()], 2 * cell_us)


def panes_around(spark: SparkSession, path: str, batch_id: int, spans: Sequence[Span], reach_us: int) -> DataFrame:
    """Pane rows of all batches up to this one that lie within ``reach_us`` of a span.
    Only the folders of their hours are read."""
    wide = [(low - reach_us, high + reach_us) for low, high in spans]
    rows = read_tiered(spark, path, _PANES, batch_id, HOUR, _units(wide, HOUR_US))
    return rows.where(in_spans(F.col("moment_us"), wide)).drop(HOUR)


def absorb_flows(flows: DataFrame, batch_id: int, root: str, config: DetectionConfig = DetectionConfig(),
                 windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS) -> list[Span]:
    """Add the flows of one batch to the tables under ``root``. Returns the spans of time
    that its flows lie in."""
    spark, scanned = flows.sparkSession, scan_windows(config)
    # A touched window reaches back to W before its tick, which is at most W after.
    reach = (max(windows) + tick_secs) * MICROS
    panes = pane_rows(flows, windows, tick_secs, contacts=bool(scanned))
    hour = F.floor(F.col("moment_us") / HOUR_US).cast("bigint")
    write_tiered(panes.withColumn(HOUR, hour), f"{root}/panes", batch_id, HOUR, _merge)
    own = read_own(spark, f"{root}/panes", _PANES, batch_id, HOUR)
    spans = touched_spans(own, reach)
    newest = [m for m in (newest_moment(spark, root, batch_id - 1), spans[-1][1] if spans else None) if m is not None]
    if newest:
        write_batch(spark.createDataFrame([(max(newest),)], PROGRESS_SCHEMA), f"{root}/progress", batch_id)
    if not spans:
        return []

    touched = expand_windows(own.select("moment_us").distinct(), "moment_us", windows, tick_secs).distinct().select(
        "window_secs", timestamp_of_us(F.col("tick_us")).alias("tick"))
    around = panes_around(spark, f"{root}/panes", batch_id, spans, reach)
    metrics = pane_metrics(around, windows, tick_secs, keep_empty=False).join(touched, ["window_secs", "tick"], "left_semi")
    by_day = _day(F.unix_micros("tick"))
    write_batch(metrics.select(*METRIC_COLUMNS).withColumn(DAY, by_day), f"{root}/metrics", batch_id, [DAY])
    watched = read_batch(spark, f"{root}/metrics", _METRICS, batch_id, [DAY]).drop(DAY)
    if scanned:
        watched = with_scanners(watched, scanners_in(pane_contacts(around, scanned, tick_secs), config, tick_secs))
    found = route_rules(watched, config).withColumn(DAY, _day(F.unix_micros("triggered_at")))
    write_batch(found, f"{root}/candidates", batch_id, [DAY])
    return spans


def _merge(rows: DataFrame) -> DataFrame:
    return merge_panes(rows).withColumn(HOUR, F.floor(F.col("moment_us") / HOUR_US).cast("bigint")).select(*_PANES.fieldNames())


def add_totals(flows: DataFrame, batch_id: int, root: str, tick_secs: int = TICK_SECS) -> None:
    """What one batch adds to the totals, as a whole and per tick, and when exporters were
    heard from."""
    write_batch(flow_totals(flows), f"{root}/totals", batch_id)
    write_batch(exporter_last_seen(flows), f"{root}/exporters", batch_id)
    write_tiered(_dated(tick_arrivals(flows, tick_secs), "tick_us"), f"{root}/arrivals", batch_id, DATE, _merged_arrivals)
    write_tiered(_dated(exporter_moments(flows, tick_secs), "moment_us"), f"{root}/presence", batch_id, DATE, DataFrame.distinct)


def _dated(rows: DataFrame, moment: str) -> DataFrame:
    return rows.withColumn(DATE, F.floor(F.col(moment) / (24 * HOUR_US)).cast("bigint"))


def _merged_arrivals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tick_us", DATE).agg(*[F.sum(c).alias(c) for c in ARRIVED]).select(*rows.columns)


# -- views ----------------------------------------------------------------------

def _between(spark: SparkSession, path: str, schema: T.StructType, spans: Sequence[Span] | None) -> DataFrame:
    if spans is None:
        return read_table(spark, path, schema)
    return read_parts(spark, path, schema, DAY, days_of(spans))


def newest_batches(spark: SparkSession, root: str, upto: int | None = None, spans: Sequence[Span] | None = None) -> DataFrame:
    """The batch that computed each (window, tick) last, of all days or those of ``spans``."""
    rows = _between(spark, f"{root}/metrics", _METRICS, spans)
    if upto is not None:
        rows = rows.where(F.col(BATCH) <= upto)
    return rows.groupBy("window_secs", "tick").agg(F.max(BATCH).alias(BATCH))


def current_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One metrics row per (window, tick) that holds flows."""
    rows = read_table(spark, f"{root}/metrics", _METRICS)
    return rows.join(newest_batches(spark, root), ["window_secs", "tick", BATCH], "left_semi").select(*METRIC_COLUMNS)


def newest_moment(spark: SparkSession, root: str, batch_id: int | None = None) -> int | None:
    """Pane moment of the newest flow so far, or as of a batch, in microseconds."""
    path = f"{root}/progress"
    rows = read_table(spark, path, PROGRESS_SCHEMA) if batch_id is None else read_batch(spark, path, PROGRESS_SCHEMA, batch_id)
    return rows.agg(F.max("newest_us")).first()[0]


def current_candidates(spark: SparkSession, root: str, upto: int | None = None, spans: Sequence[Span] | None = None) -> DataFrame:
    """Candidates as the latest computation of their tick has them."""
    rows = _between(spark, f"{root}/candidates", _CANDIDATES, spans)
    latest = newest_batches(spark, root, upto, spans).withColumnRenamed("tick", "triggered_at")
    return rows.join(latest, ["window_secs", "triggered_at", BATCH], "left_semi").select(*FIRED_COLUMNS)


def last_tick_us(moment_us: int, tick_secs: int = TICK_SECS) -> int:
    """The tick that sees a moment first."""
    step = tick_secs * MICROS
    return -(-moment_us // step) * step


def stored_totals(spark: SparkSession, root: str) -> DataFrame:
    """Cumulative flows, packets and bytes of all batches."""
    zero = F.lit(0).cast("bigint")
    return read_table(spark, f"{root}/totals", TOTALS_SCHEMA).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in TOTALS_SCHEMA.fieldNames()])


def last_batch(spark: SparkSession, root: str) -> int | None:
    """The newest batch that is complete up to its metrics; None before the first."""
    return read_table(spark, f"{root}/progress", PROGRESS_SCHEMA).agg(F.max(BATCH)).first()[0]


def stored_arrivals(spark: SparkSession, root: str) -> DataFrame:
    """Partial rows of ``tick_arrivals`` of all flows so far."""
    last = last_batch(spark, root)
    return read_tiered(spark, f"{root}/arrivals", ARRIVALS_SCHEMA, -1 if last is None else last, DATE).drop(DATE)


def stored_presence(spark: SparkSession, root: str) -> DataFrame:
    """``exporter_moments`` of all flows so far."""
    last = last_batch(spark, root)
    return read_tiered(spark, f"{root}/presence", PRESENCE_SCHEMA, -1 if last is None else last, DATE).drop(DATE)


def stored_exporters(spark: SparkSession, root: str) -> DataFrame:
    """Last receive time of every exporter."""
    return read_table(spark, f"{root}/exporters", EXPORTERS_SCHEMA).groupBy("exporter_ip").agg(
        F.max("last_seen").alias("last_seen"))
