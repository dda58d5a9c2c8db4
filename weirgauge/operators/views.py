"""Serving tables and dashboard series over metrics, alerts and event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.config import EXPORTER_ACTIVE_SECS, TICK_SECS
from weirgauge.functions.clock import MICROS, timestamp_of_us
from weirgauge.functions.net import ip_text
from weirgauge.functions.numbers import ceil_to, floor_to
from weirgauge.operators.coverage import at_ticks, count_spans, place_partials, presence_spans
from weirgauge.operators.metrics import latest_snapshot, window_metrics, with_tick
from weirgauge.operators.prefix import running_totals
from weirgauge.operators.rules import RULES
from weirgauge.operators.ticks import event_us, first_tick, pane_moment, pane_secs

# Gauge names and the counters they are published with.
GAUGES = ["flows_per_sec", "packets_per_sec", "bytes_per_sec", "unique_src_ips", "unique_dst_ips"]
COUNTERS = ["flows_total", "packets_total", "bytes_total"]
TALKER_WINDOW = 60
SUMMARY_WINDOW = 10


def exporter_moments(flows: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    """The pane moments at which each exporter was heard from."""
    return flows.select(pane_moment(event_us(flows), tick_secs).alias("moment_us"), "exporter_ip").distinct()


def exporters_per_tick(flows: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    """Active exporters at every tick that has any; the age bound is strict."""
    return exporters_at_ticks(exporter_moments(flows, tick_secs), tick_secs)


def exporters_at_ticks(panes: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    """The same from moments; repeated ones add nothing."""
    reach = {EXPORTER_ACTIVE_SECS: EXPORTER_ACTIVE_SECS * MICROS - 1}
    key = ["exporter_ip"]
    spans = presence_spans(place_partials(panes, key, reach, tick_secs), key, reach, tick_secs)
    counted = count_spans(spans, [], "active_exporters")
    return with_tick(at_ticks(counted, tick_secs)).select("tick", "active_exporters")


def newest_flows(flows: DataFrame, reach_secs: int = EXPORTER_ACTIVE_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    """Flows that the windows of the newest tick reach back to. Views of the newest row
    need no others; the bound is a plain filter, so old files are skipped."""
    newest = flows.agg(F.unix_micros(F.max("received_at"))).first()[0]
    if newest is None:
        return flows
    step = tick_secs * MICROS
    return flows.where(F.col("received_at") >= timestamp_of_us(F.lit(-(-newest // step) * step - reach_secs * MICROS)))


def newest_gauges(flows: DataFrame, window_secs: int = SUMMARY_WINDOW, tick_secs: int = TICK_SECS) -> DataFrame:
    """Gauge and exporter samples of the newest tick, from the flows it reaches."""
    recent = newest_flows(flows, max(window_secs, EXPORTER_ACTIVE_SECS), tick_secs)
    newest = latest_snapshot(window_metrics(recent, (window_secs,), tick_secs))
    exporters = exporters_per_tick(recent, tick_secs).join(newest.select("tick"), "tick").select(
        "tick", F.lit("active_exporters").alias("metric"), _labels().alias("labels"),
        F.col("active_exporters").cast("double").alias("value"))
    return gauge_samples(newest).unionByName(exporters)


def summary(metrics: DataFrame, flows: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    """Headline numbers of the newest short window; no row when there is no data."""
    newest = latest_snapshot(metrics.where(F.col("window_secs") == SUMMARY_WINDOW))
    return newest.join(exporters_per_tick(flows, tick_secs), "tick", "left").select(
        "window_secs", *GAUGES,
        F.coalesce("active_exporters", F.lit(0).cast("bigint")).alias("active_exporters"))


def top_talkers_view(metrics: DataFrame) -> DataFrame:
    """Ranked talkers of the newest 60 s window with their byte rates."""
    newest = latest_snapshot(metrics.where(F.col("window_secs") == TALKER_WINDOW))
    lists = F.array(
        F.struct(F.lit("source").alias("side"), F.col("top_src_ips").alias("talkers")),
        F.struct(F.lit("destination").alias("side"), F.col("top_dst_ips").alias("talkers")))
    return (
        newest.select("window_secs", F.explode(lists).alias("list"))
        .select("window_secs", "list.side", F.posexplode("list.talkers").alias("place", "talker"))
        .select(
            "window_secs", "side", (F.col("place") + 1).alias("rank"),
            ip_text(F.col("talker.ip")).alias("ip"), F.col("talker.bytes").alias("bytes"),
            (F.col("talker.bytes").cast("double") / F.col("window_secs").cast("double")).alias("bytes_per_sec"))
    )


def _labels(**pairs: Column) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[part for name, value in pairs.items() for part in (F.lit(name), value)])


def gauge_samples(metrics: DataFrame) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(g).alias("metric"), F.col(g).cast("double").alias("value")) for g in GAUGES])
    window = F.concat(F.col("window_secs").cast("string"), F.lit("s"))
    return metrics.select("tick", window.alias("window"), F.explode(pairs).alias("pair")).select(
        "tick", "pair.metric", _labels(window=F.col("window")).alias("labels"), "pair.value")


def _tick_day() -> Column:
    return F.call_function("div", F.col("tick_us"), F.lit(86_400 * MICROS))


ARRIVED = ["flows", "packets", "bytes"]


def tick_arrivals(flows: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    """Flows, packets and bytes by the tick that sees them first: what the counters grow by."""
    return flows.groupBy(first_tick(event_us(flows), tick_secs).alias("tick_us")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def counter_samples(arrived: DataFrame, spine: DataFrame) -> DataFrame:
    """Flow, packet and byte totals as of every tick, from ``tick_arrivals``; partial
    rows of a tick add up."""
    zero = F.lit(0).cast("bigint")
    quiet = spine.select("tick_us", zero.alias("flows"), zero.alias("packets"), zero.alias("bytes")).distinct()
    grown = arrived.unionByName(quiet).groupBy("tick_us").agg(*[F.sum(c).alias(c) for c in ARRIVED])
    totals = running_totals(grown, _tick_day(), [F.asc("tick_us")], {
        "flows_total": F.col("flows"), "packets_total": F.col("packets"), "bytes_total": F.col("bytes")})
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in COUNTERS])
    return with_tick(totals.select("tick_us", F.explode(pairs).alias("pair"))).select(
        "tick", "pair.metric", _labels().alias("labels"), "pair.value")


def alert_samples(fired: DataFrame, spine: DataFrame) -> DataFrame:
    """Fired alerts per rule as of every tick; a rule shows up once it has fired."""
    zero = F.lit(0).cast("bigint")
    ticks = spine.select("tick_us").distinct()
    quiet = ticks.select(F.explode(F.array(*[F.lit(r) for r in RULES])).alias("rule"), "tick_us", zero.alias("fired"))
    steps = (
        fired.select("rule", F.unix_micros("triggered_at").alias("tick_us"), F.lit(1).cast("bigint").alias("fired"))
        .unionByName(quiet).groupBy("rule", "tick_us").agg(F.sum("fired").alias("fired"))
    )
    counted = running_totals(steps, _tick_day(), [F.asc("tick_us")], {"so_far": F.col("fired")}, per=["rule"])
    return with_tick(counted.where("so_far > 0")).select(
        "tick", F.lit("alerts_total").alias("metric"), _labels(rule=F.col("rule")).alias("labels"),
        F.col("so_far").cast("double").alias("value"))


def exporter_samples(moments: DataFrame, spine: DataFrame, tick_secs: int = TICK_SECS) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    wanted = spine.select(timestamp_of_us(F.col("tick_us")).alias("tick")).distinct()
    known = exporters_at_ticks(moments, tick_secs).withColumn("on_spine", F.lit(False))
    merged = known.unionByName(wanted.select("tick", zero.alias("active_exporters"), F.lit(True).alias("on_spine")))
    per_tick = merged.groupBy("tick").agg(
        F.max("active_exporters").cast("double").alias("value"), F.max("on_spine").alias("on_spine"))
    return per_tick.where("on_spine").select(
        "tick", F.lit("active_exporters").alias("metric"), _labels().alias("labels"), "value")


def metric_samples(
    flows: DataFrame, metrics: DataFrame, fired: DataFrame, spine: DataFrame, tick_secs: int = TICK_SECS,
    prefix: str = "",
) -> DataFrame:
    """All ten metric families in long form, one sample per tick and label set."""
    return samples_of(tick_arrivals(flows, tick_secs), exporter_moments(flows, tick_secs), metrics, fired, spine, tick_secs, prefix)


def samples_of(
    arrived: DataFrame, moments: DataFrame, metrics: DataFrame, fired: DataFrame, spine: DataFrame,
    tick_secs: int = TICK_SECS, prefix: str = "",
) -> DataFrame:
    """The same from ``tick_arrivals`` and ``exporter_moments``, without the flows."""
    samples = (
        counter_samples(arrived, spine)
        .unionByName(alert_samples(fired, spine))
        .unionByName(exporter_samples(moments, spine, tick_secs))
        .unionByName(gauge_samples(metrics))
    )
    return samples.withColumn("metric", F.concat(F.lit(prefix), F.col("metric"))) if prefix else samples


# -- dashboards -----------------------------------------------------------------

def latest_samples(samples: DataFrame, wanted: Sequence[str], window: str | None = None) -> DataFrame:
    """Newest value of each wanted metric; gauges are restricted to one window label."""
    chosen = samples.where(F.col("metric").isin(*wanted))
    if window is not None:
        label = F.try_element_at("labels", F.lit("window"))
        chosen = chosen.where(label.isNull() | (label == window))
    return chosen.groupBy("metric").agg(F.max_by("value", "tick").alias("value"))


def total_alerts(fired: DataFrame) -> DataFrame:
    """Number of fired alerts, 0 when there are none."""
    return fired.agg(F.count(F.lit(1)).alias("alerts"))


def rate_series(rates: DataFrame, measure: str) -> DataFrame:
    """Time series of one per-second rate for all window sizes."""
    return rates.select("tick", "window_secs", F.col(measure).alias("value"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """JSON log lines with their ``level`` and ``message`` taken out."""
    body = F.from_json("line", "struct<level:string,message:string>")
    return lines.select("ts", "line", body["level"].alias("level"), body["message"].alias("message"))


def log_filter(lines: DataFrame, level: str | None = None, message: str | None = None) -> DataFrame:
    """Log lines whose level and message match whole-value patterns; no pattern, all lines."""
    parsed = parse_log_lines(lines)
    for name, pattern in (("level", level), ("message", message)):
        if pattern is not None:
            parsed = parsed.where(F.coalesce(F.col(name), F.lit("")).rlike(f"^(?:{pattern})$"))
    return parsed


def log_rate(lines: DataFrame, range_secs: int = 60, step_secs: int = 15) -> DataFrame:
    """Lines per second by level over the trailing ``(t - range, t]``, every step."""
    parsed = parse_log_lines(lines)
    panes = parsed.groupBy(
        pane_moment(F.unix_micros("ts"), pane_secs((range_secs,), step_secs)).alias("moment_us"), "level",
    ).agg(F.count(F.lit(1)).alias("lines"))
    # An event on a border has left the half-open window one microsecond earlier.
    reach = range_secs * MICROS - 1
    step_us = step_secs * MICROS
    ticks = F.sequence(
        ceil_to(F.col("moment_us"), step_us), floor_to(F.col("moment_us") + reach, step_us), F.lit(step_us))
    seen = panes.where(ceil_to(F.col("moment_us"), step_us) <= floor_to(F.col("moment_us") + reach, step_us))
    return with_tick(
        seen.select("level", "lines", F.explode(ticks).alias("tick_us"))
        .groupBy("tick_us", "level").agg((F.sum("lines").cast("double") / float(range_secs)).alias("rate"))
    ).select("tick", "level", "rate")
