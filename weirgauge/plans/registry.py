"""Every operator as a named query over the given tables.

Queries return flat columns: ticks as epoch milliseconds, lists and maps as
text, so that results can be compared across engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.config import (
    DestinationHotspotConfig, DetectionConfig, PortScanConfig, SynFloodConfig, UdpFloodConfig,
)
from weirgauge.functions import clock, net, numbers
from weirgauge.operators import alerts as A
from weirgauge.operators import flow_queries as Q
from weirgauge.operators import metrics as M
from weirgauge.operators import rules as R
from weirgauge.operators import ticks
from weirgauge.operators import views as V
from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.operators.decode import decode_flows, decode_templated, decode_v5
from weirgauge.operators.sets import split_sets
from weirgauge.operators.templates import (
    ELEMENTS, layout_cover, parse_templates, template_history, template_layouts,
)
from weirgauge.plans.pipelines import fired_alerts, run_available
from weirgauge.schema import FLOW_COLUMNS, FLOW_SCHEMA, WINDOW_METRICS_SCHEMA
from weirgauge.sources import datagrams as D
from weirgauge.sources.event_flows import event_flows, flows_from_events, read_events
from weirgauge.sources.flow_table import read_flows, write_flows
from weirgauge.storage import settle, shared_path
from weirgauge.streaming.alert_stream import stored_alerts
from weirgauge.streaming.cooldown_tree import alerts_between
from weirgauge.streaming.engine import start_flow_engine
from weirgauge.streaming.metrics_stream import current_metrics, stored_totals
from weirgauge.testing.datagram_fixture import datagrams_from_events, multi_set_datagrams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Arguments of the parameterised queries.
RANGE_START_MS = 1_704_067_800_000
RANGE_END_MS = 1_704_068_100_000
RANGE_LIMIT = 500
HISTORY_END = "2024-01-01T00:30:00Z"
HISTORY_NOW = dt.datetime(2024, 1, 1, 0, 43, tzinfo=dt.timezone.utc)
HISTORY_LIMIT = 250
AS_OF = "2024-01-01T00:20:00Z"
ALERT_ID = 7
HOT_TARGET = "1.1.1.1"
NORMALIZE_NOW = "2024-02-02T00:00:00Z"
LONG_STEP = 999_983
DAY_MS = 86_400_000
YEAR_LIMIT = 700


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return add


# -- helpers ---------------------------------------------------------------------

def _flat_tick(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "tick"]
    return rows.select(F.unix_millis("tick").alias("tick_ms"), *others)


def _flat_flows(flows: DataFrame) -> DataFrame:
    return flows.select(*[c for c in FLOW_COLUMNS if c != "received_at"])


def _flat_alerts(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("triggered_at", "indicators")]
    return rows.select(
        *others, F.array_join("indicators", " | ").alias("indicators"),
        F.unix_millis("triggered_at").alias("triggered_ms"))


def _captured(spark: SparkSession, folder: str) -> DataFrame:
    return datagrams_from_events(read_events(spark, folder))


def _capture(spark: SparkSession, folder: str) -> DataFrame:
    """Datagrams that are there already, as a capture is: for operators that pass over
    them several times, each of which would pack all flows anew."""
    return settle(_captured(spark, folder), "capture")


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return D.classify_datagrams(_captured(spark, folder))


def _fired(spark: SparkSession, folder: str) -> DataFrame:
    return fired_alerts(event_flows(spark, folder))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return A.number_alerts(_fired(spark, folder))


def _moment(text: str) -> Column:
    return clock.timestamp_of_ms(F.lit(clock.rfc3339_argument_ms(text)))


def _log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON log lines: the type is the level, error messages are alerts."""
    events = read_events(spark, folder)
    message = (
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "ALERT")
        .when(F.col("event_type") == "error", "Alert").otherwise(F.col("event_type")))
    seconds = clock.micros_of_ntz(F.col("ts").cast("timestamp_ntz"))
    # Compressed a thousandfold like the flows, so that minutes hold many lines.
    moment = F.lit(1_704_067_200_000) + F.call_function("div", seconds - 1_704_067_200_000_000, F.lit(1_000_000))
    return events.select(
        clock.timestamp_of_ms(moment).alias("ts"),
        F.to_json(F.struct(
            F.col("event_type").alias("level"), message.alias("message"), F.col("event_id"))).alias("line"))


# -- datagrams ---------------------------------------------------------------------

@query("read_datagrams")
def _(spark, folder):
    captured = _capture(spark, folder)
    first, second = shared_path(spark, "capture"), shared_path(spark, "capture")
    captured.where("exporter_ip = '127.0.0.1'").write.parquet(first)
    captured.where("exporter_ip <> '127.0.0.1'").write.parquet(second)
    merged = D.read_datagrams(spark, first, second)
    return merged.groupBy("exporter_ip").agg(
        F.count(F.lit(1)).alias("datagrams"), F.sum(F.length("payload")).alias("payload_bytes"))


@query("read_datagrams_rows")
def _(spark, folder):
    captured = _capture(spark, folder)
    first, second = shared_path(spark, "capture"), shared_path(spark, "capture")
    captured.where("exporter_ip = '127.0.0.1'").write.parquet(first)
    captured.where("exporter_ip <> '127.0.0.1'").write.parquet(second)
    return D.read_datagrams(spark, first, second).select(
        "exporter_ip", "seq", F.length("payload").alias("payload_bytes"))


@query("version_gate_rows")
def _(spark, folder):
    return D.version_gate(_captured(spark, folder), [5, 9]).select(
        "exporter_ip", "seq", D.version_of(F.col("payload")).alias("version"), F.length("payload").alias("payload_bytes"))


@query("version_gate")
def _(spark, folder):
    kept = D.version_gate(_captured(spark, folder), [5, 9])
    return kept.groupBy("exporter_ip", D.version_of(F.col("payload")).alias("version")).agg(
        F.count(F.lit(1)).alias("datagrams"))


@query("classify_datagrams")
def _(spark, folder):
    return _classified(spark, folder).select("exporter_ip", "seq", "kind", "error")


@query("decode_errors")
def _(spark, folder):
    bad = D.decode_errors(_classified(spark, folder))
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("datagrams"), F.sum("size").alias("payload_bytes"))


@query("decode_v5_flows")
def _(spark, folder):
    return _flat_flows(decode_v5(_classified(spark, folder)))


@query("split_sets")
def _(spark, folder):
    return split_sets(_classified(spark, folder)).select(
        "exporter_ip", "domain", "seq", "set_idx", "set_id", F.length("body").alias("body_bytes"))


@query("split_sets_several")
def _(spark, folder):
    packets = D.classify_datagrams(multi_set_datagrams(read_events(spark, folder)))
    return split_sets(packets).select(
        "exporter_ip", "seq", "set_idx", "set_id", F.length("body").alias("body_bytes"))


@query("parse_templates")
def _(spark, folder):
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws(
        ":", f["type"].cast("string"), f["len"].cast("string"), f["enterprise"].cast("string"))), ",")
    return parse_templates(split_sets(_classified(spark, folder))).select(
        "exporter_ip", "domain", "template_id", "seq", "tmpl_idx", "total_length", fields.alias("fields"))


@query("template_history")
def _(spark, folder):
    history = template_history(parse_templates(split_sets(_classified(spark, folder))))
    return template_layouts(history).select(
        "exporter_ip", "domain", "template_id", "from_pos", "to_pos", "total_length", "usable",
        F.concat_ws(",", *[F.coalesce(F.col(f"at_{n}").cast("string"), F.lit("-")) for n, *_ in ELEMENTS]).alias("offsets"))


@query("decode_templated_flows")
def _(spark, folder):
    return _flat_flows(decode_templated(D.classify_datagrams(_capture(spark, folder))))


@query("decode_templated_flows_without_broadcast")
def _(spark, folder):
    return _flat_flows(decode_templated(D.classify_datagrams(_capture(spark, folder)), broadcast_layouts=0))


@query("decode_flows")
def _(spark, folder):
    return _flat_flows(decode_flows(_capture(spark, folder)))


@query("decode_flows_long_validity")
def _(spark, folder):
    """Arrival numbers that lie far apart: versions are valid over 10^12 positions."""
    captured = _capture(spark, folder)
    return _flat_flows(decode_flows(captured.withColumn("seq", F.col("seq") * LONG_STEP)))


@query("layout_cover")
def _(spark, folder):
    """The packets that each version's blocks make up, and how few blocks these are."""
    captured = _captured(spark, folder).withColumn("seq", F.col("seq") * LONG_STEP)
    history = template_history(parse_templates(split_sets(D.classify_datagrams(captured))))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    past = layout_cover(template_layouts(history)).where(F.col("to_pos").isNotNull())
    return past.groupBy("exporter_ip", "from_pos", "to_pos").agg(
        F.min(F.col("block") * size).alias("first_packet"), F.max((F.col("block") + 1) * size - 1).alias("last_packet"),
        F.sum(size).alias("packets"), (F.count(F.lit(1)) < 64).alias("few"))


@query("decode_flows_several_sets")
def _(spark, folder):
    return _flat_flows(decode_flows(settle(multi_set_datagrams(read_events(spark, folder)), "capture")))


# -- flows ---------------------------------------------------------------------------

@query("flow_totals")
def _(spark, folder):
    return Q.flow_totals(event_flows(spark, folder))


@query("exporter_last_seen")
def _(spark, folder):
    return Q.exporter_last_seen(event_flows(spark, folder)).select(
        "exporter_ip", F.unix_millis("last_seen").alias("last_seen_ms"))


@query("active_exporters")
def _(spark, folder):
    return Q.active_exporters(event_flows(spark, folder), _moment(AS_OF))


@query("active_exporters_per_tick")
def _(spark, folder):
    return _flat_tick(V.exporters_per_tick(event_flows(spark, folder)))


@query("flow_events")
def _(spark, folder):
    return Q.flow_events(event_flows(spark, folder))


@query("write_flows")
def _(spark, folder):
    path = shared_path(spark, "flows")
    write_flows(event_flows(spark, folder), path)
    return read_flows(spark, path).groupBy(F.col("flow_date").cast("string").alias("flow_date")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"), F.max("received_at_ms").alias("newest_ms"))


@query("write_flows_rows")
def _(spark, folder):
    path = shared_path(spark, "flows")
    write_flows(event_flows(spark, folder), path)
    kept = [c for c in FLOW_COLUMNS if c != "received_at"]
    return read_flows(spark, path).select(*kept, F.col("flow_date").cast("string").alias("flow_date"))


@query("flow_history_of_a_year")
def _(spark, folder):
    """The newest flows of a table over a year: flows are dealt to days by their bytes."""
    path = shared_path(spark, "flows")
    flows = event_flows(spark, folder)
    ms = F.col("received_at_ms") + (F.col("bytes") * 7 + F.col("src_port")) % 365 * DAY_MS
    write_flows(flows.withColumn("received_at_ms", ms).withColumn("received_at", F.timestamp_millis("received_at_ms")), path)
    return Q.flow_history(
        read_flows(spark, path), "2024-01-01T00:00:00Z", "2025-06-01T00:00:00Z", YEAR_LIMIT, HISTORY_NOW)


@query("flows_in_range")
def _(spark, folder):
    return _flat_flows(Q.flows_in_range(event_flows(spark, folder), RANGE_START_MS, RANGE_END_MS, RANGE_LIMIT))


@query("flow_history")
def _(spark, folder):
    return Q.flow_history(event_flows(spark, folder), "not a time", HISTORY_END, HISTORY_LIMIT, HISTORY_NOW)


@query("flow_history_defaults")
def _(spark, folder):
    return Q.flow_history(event_flows(spark, folder), now=HISTORY_NOW)


@query("scalar_functions")
def _(spark, folder):
    flows = flows_from_events(read_events(spark, folder))
    text = net.ip_text(F.col("dst_ip"))
    us = F.col("received_at_ms") * 1000
    return flows.select(
        "flow_id", text.alias("dst_text"), net.ip_number(text).alias("dst_again"),
        clock.whole_second_text(F.col("received_at_ms")).alias("second_text"),
        clock.rfc3339_text(us).alias("rfc_text"),
        F.unix_millis(clock.parse_rfc3339(clock.rfc3339_text(us))).alias("rfc_again"),
        numbers.whole_quotient(F.col("bytes"), F.col("packets")).alias("mean_size"),
        numbers.text_0(F.col("flow_id") / F.lit(8.0)).alias("rounded"),
        numbers.text_1(F.col("flow_id") / F.lit(80.0)).alias("rounded_1"),
        numbers.saturating_minus(F.col("packets"), F.col("flow_id") % 700).alias("rest"),
        net.has_bits(F.col("tcp_flags"), 0x10).alias("acked"),
    )


# -- windows ----------------------------------------------------------------------------

@query("tick_spine")
def _(spark, folder):
    spine = ticks.tick_spine(event_flows(spark, folder))
    return spine.select("window_secs", F.call_function("div", F.col("tick_us"), F.lit(1000)).alias("tick_ms"))


@query("assign_windows")
def _(spark, folder):
    assigned = ticks.assign_windows(event_flows(spark, folder))
    return _flat_tick(assigned.groupBy("window_secs", "tick").agg(
        F.count(F.lit(1)).alias("flows"), F.min("received_at_ms").alias("oldest_ms"),
        F.max("received_at_ms").alias("newest_ms")))


@query("assign_windows_odd_ticks")
def _(spark, folder):
    assigned = ticks.assign_windows(event_flows(spark, folder), (10, 60), 7)
    return _flat_tick(assigned.groupBy("window_secs", "tick").agg(F.count(F.lit(1)).alias("flows")))


@query("window_counts")
def _(spark, folder):
    return _flat_tick(M.window_counts(event_flows(spark, folder)))


@query("window_counts_sparse_ticks")
def _(spark, folder):
    return _flat_tick(M.window_counts(event_flows(spark, folder), (10,), 25))


@query("window_rates")
def _(spark, folder):
    return _flat_tick(M.with_rates(M.window_counts(event_flows(spark, folder))))


@query("unique_endpoints")
def _(spark, folder):
    return _flat_tick(M.unique_endpoints(event_flows(spark, folder)))


@query("bytes_by_endpoint")
def _(spark, folder):
    return _flat_tick(M.bytes_by_endpoint(event_flows(spark, folder)))


@query("top_talkers")
def _(spark, folder):
    return _flat_tick(M.top_talkers(event_flows(spark, folder)))


@query("protocol_distribution")
def _(spark, folder):
    return _flat_tick(M.protocol_distribution(event_flows(spark, folder)))


@query("tcp_counters")
def _(spark, folder):
    return _flat_tick(M.tcp_counters(event_flows(spark, folder)))


@query("source_port_fanout")
def _(spark, folder):
    return _flat_tick(M.source_port_fanout(event_flows(spark, folder)))


def _flat_metrics(metrics: DataFrame) -> DataFrame:
    return _flat_tick(M.snapshot_event(metrics))


def _full_metrics(metrics: DataFrame) -> DataFrame:
    return _flat_tick(metrics.select(
        "tick", "window_secs", "flows", "packets", "bytes", "flows_per_sec", "packets_per_sec", "bytes_per_sec",
        "unique_src_ips", "unique_dst_ips",
        M.talkers_text(F.col("top_src_ips")).alias("top_src_ips"),
        M.talkers_text(F.col("top_dst_ips")).alias("top_dst_ips"),
        M.protocols_text(F.col("protocol_dist")).alias("protocol_dist"),
        "tcp_flows", "syn_only_flows", "avg_flow_duration_ms"))


@query("window_metrics_10s")
def _(spark, folder):
    return _full_metrics(M.window_metrics(event_flows(spark, folder), (10,)))


@query("window_metrics")
def _(spark, folder):
    return _full_metrics(M.window_metrics(event_flows(spark, folder)))


@query("window_metrics_busy_ticks")
def _(spark, folder):
    return _full_metrics(M.window_metrics(event_flows(spark, folder), keep_empty=False))


@query("latest_snapshot")
def _(spark, folder):
    return _full_metrics(M.latest_snapshot(M.window_metrics(V.newest_flows(event_flows(spark, folder)))))


@query("snapshot_event")
def _(spark, folder):
    return _flat_metrics(M.window_metrics(event_flows(spark, folder)))


# -- detection -----------------------------------------------------------------------------

def _rule_query(rule: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _flat_alerts(R.candidate_alerts(event_flows(spark, folder)).where(F.col("rule") == rule))
    return run


for _rule in R.RULES:
    QUERIES[f"rule_{_rule}"] = _rule_query(_rule)


@query("port_scan_all_sources")
def _(spark, folder):
    config = DetectionConfig(port_scan=PortScanConfig(min_unique_dst_ports=4, max_bytes_per_flow=1e9, all_sources=True))
    found = R.candidate_alerts(event_flows(spark, folder), config).where(F.col("rule") == "port_scan")
    return _flat_alerts(found).drop("indicators")


@query("route_rules")
def _(spark, folder):
    return _flat_alerts(R.candidate_alerts(event_flows(spark, folder)))


@query("apply_cooldown")
def _(spark, folder):
    return _flat_alerts(apply_cooldown(R.candidate_alerts(event_flows(spark, folder))))


@query("apply_cooldown_short_blocks")
def _(spark, folder):
    fired = apply_cooldown(R.candidate_alerts(event_flows(spark, folder)), 45, block_secs=50)
    return _flat_alerts(fired).drop("indicators")


@query("alerts_by_rule_counts")
def _(spark, folder):
    return A.count_by_rule(_fired(spark, folder))


@query("recent_alerts")
def _(spark, folder):
    return _flat_alerts(A.recent_alerts(_stored(spark, folder)))


# -- alert store -------------------------------------------------------------------------------

@query("append_alerts")
def _(spark, folder):
    fired = settle(_fired(spark, folder), "fired")
    path = shared_path(spark, "alerts")
    high = F.col("severity") == "High"
    A.append_alerts(fired.where(high), path)
    A.append_alerts(fired.where(~high), path)
    return _flat_alerts(A.read_alerts(spark, path))


@query("alerts_recent")
def _(spark, folder):
    return _flat_alerts(A.alerts_recent(_stored(spark, folder), 10))


@query("alert_by_id")
def _(spark, folder):
    return _flat_alerts(A.alert_by_id(_stored(spark, folder), ALERT_ID))


@query("alerts_by_ip")
def _(spark, folder):
    return _flat_alerts(A.alerts_by_ip(_stored(spark, folder), HOT_TARGET, 5))


@query("alerts_by_rule")
def _(spark, folder):
    return _flat_alerts(A.alerts_by_rule(_stored(spark, folder), "udp_flood", 5))


@query("query_alerts")
def _(spark, folder):
    """A rule and an address together: the rule decides."""
    found = A.query_alerts(_stored(spark, folder), rule="syn_flood", ip=HOT_TARGET)
    return _flat_alerts(found)


@query("query_alerts_defaults")
def _(spark, folder):
    return _flat_alerts(A.query_alerts(_stored(spark, folder)))


@query("alert_json")
def _(spark, folder):
    return A.alert_json(_stored(spark, folder))


@query("normalize_alert_rows")
def _(spark, folder):
    n = F.col("event_id")

    def cycle(*values):
        chain = None
        for place, value in enumerate(values):
            value = value if isinstance(value, Column) else F.lit(value)
            hit = n % len(values) == place
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        return chain

    number = (n % 100).cast("string")
    raw = read_events(spark, folder).select(
        n.alias("id"), F.col("event_type").alias("rule"),
        cycle("Low", "Medium", "High", "odd").alias("severity"),
        cycle(F.concat(F.lit("10.0.0."), number), "300.1.1.1", None, "1.2.3", "01.2.3.4", "1.2.3.4\n").alias("target_ip"),
        F.lit(60).cast("bigint").alias("window_secs"),
        cycle(F.concat(F.lit('["a '), number, F.lit('","b"]')), "not json", "[]", "[1,2]", '["a"] x', "[true]", '[{"a":1}]',
              ' [ "q" ]\n', '["a", null]').alias("indicators"),
        cycle(F.concat(F.lit("2024-01-01T00:00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit("+00:00")),
              "yesterday", "2024-01-01 00:00:05.250Z", "2024-01-01T00:00:00", "2024-01-01t00:00:05z", "2024-01-01T00:00:60Z",
              "2024-01-01T00:00:05Z\n").alias("triggered_at"))
    return _flat_alerts(A.normalize_alert_rows(raw, _moment(NORMALIZE_NOW)))


# -- serving views ---------------------------------------------------------------------------------

@query("summary")
def _(spark, folder):
    flows = V.newest_flows(event_flows(spark, folder))
    return V.summary(M.window_metrics(flows, (10,)), flows)


@query("top_talkers_view")
def _(spark, folder):
    return V.top_talkers_view(M.window_metrics(V.newest_flows(event_flows(spark, folder)), (60,)))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    flows = event_flows(spark, folder)
    metrics = settle(M.window_metrics(flows), "metrics")
    return V.metric_samples(
        flows, metrics, fired_alerts(flows, metrics=metrics), ticks.tick_spine(flows, (10,)))


@query("metric_samples")
def _(spark, folder):
    labels = F.array_join(F.transform(
        F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _flat_tick(_samples(spark, folder).withColumn("labels", labels))


@query("alert_outbox")
def _(spark, folder):
    return A.alert_outbox(_fired(spark, folder)).select(
        "rule", F.unix_millis("triggered_at").alias("triggered_ms"), "payload")


@query("dashboard_stats")
def _(spark, folder):
    wanted = ["flows_per_sec", "bytes_per_sec", "unique_src_ips", "unique_dst_ips", "active_exporters"]
    return V.latest_samples(V.newest_gauges(event_flows(spark, folder)), wanted, "10s")


@query("dashboard_total_alerts")
def _(spark, folder):
    return V.total_alerts(_fired(spark, folder))


@query("dashboard_total_alerts_when_none")
def _(spark, folder):
    calm = DetectionConfig(destination_hotspot=DestinationHotspotConfig(min_traffic_ratio=2.0),
                             udp_flood=UdpFloodConfig(enabled=False), syn_flood=SynFloodConfig(enabled=False),
                             port_scan=PortScanConfig(enabled=False))
    return V.total_alerts(R.candidate_alerts(event_flows(spark, folder), calm))


def _series_query(measure: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _flat_tick(V.rate_series(M.all_rates(event_flows(spark, folder)), measure))
    return run


for _measure in ("flows_per_sec", "bytes_per_sec", "packets_per_sec"):
    QUERIES[f"dashboard_series_{_measure}"] = _series_query(_measure)


@query("dashboard_detections_by_rule")
def _(spark, folder):
    return A.count_by_rule(_fired(spark, folder))


@query("log_lines_all")
def _(spark, folder):
    return V.log_filter(_log_lines(spark, folder)).select(F.unix_millis("ts").alias("ts_ms"), "level", "message", "line")


@query("log_filter_level")
def _(spark, folder):
    return V.log_filter(_log_lines(spark, folder), level="error|warn").select(
        F.unix_millis("ts").alias("ts_ms"), "level", "message")


@query("log_filter_alerts")
def _(spark, folder):
    return V.log_filter(_log_lines(spark, folder), message="(?i)alert").select(
        F.unix_millis("ts").alias("ts_ms"), "level", "message")


@query("log_rate")
def _(spark, folder):
    return _flat_tick(V.log_rate(_log_lines(spark, folder)))


# -- streams -------------------------------------------------------------------------------------------

def _flow_source(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """A stream over written flows, one file per micro-batch."""
    path = shared_path(spark, "flow-source")
    shards.write.parquet(path)
    return spark.readStream.schema(FLOW_SCHEMA).option("maxFilesPerTrigger", 2).parquet(path)


@query("stream_window_metrics")
def _(spark, folder):
    root = shared_path(spark, "stream")
    source = _flow_source(spark, folder, event_flows(spark, folder).repartitionByRange(4, "received_at_ms"))
    start_flow_engine(source, root, availableNow=True).awaitTermination()
    return _full_metrics(current_metrics(spark, root))


@query("stream_window_metrics_out_of_order")
def _(spark, folder):
    """Each batch has flows of all times: most of them are late."""
    root = shared_path(spark, "stream")
    source = _flow_source(spark, folder, event_flows(spark, folder).repartition(4, "src_port"))
    start_flow_engine(source, root, availableNow=True).awaitTermination()
    return _full_metrics(current_metrics(spark, root))


@query("stream_alerts_from_datagrams")
def _(spark, folder):
    capture, root = shared_path(spark, "capture"), shared_path(spark, "stream")
    packets = _capture(spark, folder)
    middle = (packets.agg(F.max("seq")).first()[0] or 0) // 2
    # In the order of arrival, since templates hold for what comes after them: a half is a
    # micro-batch, of as many files as there are tasks that write it.
    for part in (packets.where(F.col("seq") <= middle), packets.where(F.col("seq") > middle)):
        part.write.mode("append").parquet(capture)
        run_available(spark, capture, root)
    return _flat_alerts(stored_alerts(spark, root))


@query("stream_alerts_between")
def _(spark, folder):
    """The middle of the day from a stream whose batches have flows of all times."""
    root, flows = shared_path(spark, "stream"), event_flows(spark, folder)
    start_flow_engine(_flow_source(spark, folder, flows.repartition(4, "src_port")), root, availableNow=True).awaitTermination()
    low, high = flows.agg(F.min("received_at_ms"), F.max("received_at_ms")).first()
    third = ((high or 0) - (low or 0)) // 3
    return _flat_alerts(alerts_between(spark, root, ((low or 0) + third) * 1000, ((low or 0) + 2 * third) * 1000))


@query("stream_totals")
def _(spark, folder):
    root = shared_path(spark, "stream")
    start_flow_engine(_flow_source(spark, folder, event_flows(spark, folder)), root, availableNow=True).awaitTermination()
    return stored_totals(spark, root)
