"""Threshold detectors over metrics rows.

A rule turns one metrics row into an alert struct or NULL, so all rules of a
window size are evaluated in a single pass over the metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.config import TICK_SECS, DetectionConfig
from weirgauge.functions.net import ip_text
from weirgauge.functions.numbers import ratio, text_0, text_1
from weirgauge.operators.coverage import at_ticks
from weirgauge.operators.metrics import UDP, fanout_spans, with_tick
from weirgauge.operators.panes import pane_contacts, pane_metrics, pane_rows
from weirgauge.schema import FIRED_COLUMNS
from weirgauge.storage import settle

HIGH = "High"
MEDIUM = "Medium"
NO_TARGET = "cast(null as bigint)"


def _whole(threshold: float) -> str:
    return f"{threshold:.0f}"


def _words(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def _alert(condition: Column, rule: str, severity: str, target: Column, indicators: list[Column]) -> Column:
    return F.when(condition, F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), target.alias("target_ip"),
        F.col("window_secs"), F.array(*indicators).alias("indicators"), F.col("tick").alias("triggered_at"),
    ))


def _top_destinations() -> Column:
    shown = F.transform("top_dst_ips", lambda t: _words(ip_text(t["ip"]), "(", t["bytes"], "B)"))
    return _words("top destination IPs: ", F.array_join(shown, ", "))


def _packet_rate(limit: float) -> Column:
    return _words("packets/sec: ", text_0(F.col("packets_per_sec")), f" (threshold: {_whole(limit)})")


def udp_flood(config: DetectionConfig) -> Column:
    c = config.udp_flood
    share = ratio(F.coalesce(F.try_element_at("protocol_dist", F.lit(UDP)), F.lit(0)), F.col("flows"))
    fires = (
        (F.col("flows") > 0) & (F.col("packets_per_sec") >= float(c.min_packets_per_sec))
        & (share >= float(c.min_udp_ratio)) & (F.col("unique_src_ips") >= c.min_unique_sources)
    )
    return _alert(fires, "udp_flood", HIGH, F.expr(NO_TARGET), [
        _packet_rate(c.min_packets_per_sec),
        _words("UDP ratio: ", text_0(share * 100.0), f"% of flows (threshold: {_whole(c.min_udp_ratio * 100.0)}%)"),
        _words("unique source IPs: ", F.col("unique_src_ips"), f" (threshold: {c.min_unique_sources})"),
        _words("unique destination IPs: ", F.col("unique_dst_ips")),
        _top_destinations(),
    ])


def syn_flood(config: DetectionConfig) -> Column:
    c = config.syn_flood
    share = ratio(F.col("syn_only_flows"), F.col("tcp_flows"))
    fires = (
        (F.col("tcp_flows") > 0) & (F.col("packets_per_sec") >= float(c.min_packets_per_sec))
        & (share >= float(c.min_syn_ratio)) & (F.col("avg_flow_duration_ms") <= c.max_avg_flow_duration_ms)
    )
    return _alert(fires, "syn_flood", HIGH, F.expr(NO_TARGET), [
        _packet_rate(c.min_packets_per_sec),
        _words("SYN-only ratio: ", text_0(share * 100.0),
               f"% of TCP flows (threshold: {_whole(c.min_syn_ratio * 100.0)}%)"),
        _words("average flow duration: ", F.col("avg_flow_duration_ms"),
               f"ms (threshold: {c.max_avg_flow_duration_ms}ms)"),
        _words("unique destination IPs: ", F.col("unique_dst_ips")),
        _top_destinations(),
    ])


def destination_hotspot(config: DetectionConfig) -> Column:
    c = config.destination_hotspot
    top = F.try_element_at("top_dst_ips", F.lit(1))
    share = ratio(top["bytes"], F.col("bytes"))
    fires = (
        (F.col("bytes") > 0) & (F.col("bytes_per_sec") >= float(c.min_bytes_per_sec))
        & (share >= float(c.min_traffic_ratio))
    )
    return _alert(fires, "destination_hotspot", MEDIUM, top["ip"], [
        _words("destination ", ip_text(top["ip"]), " received ", text_0(share * 100.0),
               "% of total traffic in ", F.col("window_secs"),
               f"s window (threshold: {_whole(c.min_traffic_ratio * 100.0)}%)"),
        _words("traffic rate: ", text_1(F.col("bytes_per_sec") / 1_000_000.0), " MB/sec"),
    ])


def port_scan(config: DetectionConfig) -> Column:
    """Reads ``scan_ip`` and ``scan_ports``, joined on by ``with_scanners``."""
    c = config.port_scan
    per_flow = ratio(F.col("bytes"), F.col("flows"))
    fires = (
        (F.col("window_secs") == c.window_secs) & (F.col("flows") > 0)
        & (per_flow <= float(c.max_bytes_per_flow)) & (F.col("scan_ports") >= c.min_unique_dst_ports)
    )
    return _alert(fires, "port_scan", MEDIUM, F.col("scan_ip"), [
        _words("source ", ip_text(F.col("scan_ip")), " contacted ", F.col("scan_ports"),
               " unique destination ports in ", F.col("window_secs"),
               f"s (threshold: {c.min_unique_dst_ports})"),
        _words("average bytes per flow: ", text_0(per_flow),
               f" bytes (threshold: {_whole(c.max_bytes_per_flow)})"),
    ])


# Names, severities and indicator texts above; which window size feeds
# which rule. A new detector is one more entry.
RULES: dict[str, tuple[int, Callable[[DetectionConfig], Column]]] = {
    "udp_flood": (10, udp_flood),
    "syn_flood": (10, syn_flood),
    "destination_hotspot": (10, destination_hotspot),
    "port_scan": (60, port_scan),
}


def enabled_rules(config: DetectionConfig) -> list[str]:
    return [name for name in RULES if config.enabled and getattr(config, name).enabled]


def route_rules(metrics: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Candidate alerts of all enabled rules, before the cooldown."""
    names = enabled_rules(config)
    if "scan_ip" not in metrics.columns:
        metrics = metrics.withColumn("scan_ip", F.expr(NO_TARGET)).withColumn("scan_ports", F.expr(NO_TARGET))
    found = [F.when(F.col("window_secs") == RULES[n][0], RULES[n][1](config)) for n in names]
    if not found:
        found = [_alert(F.lit(False), "", "", F.expr(NO_TARGET), [F.lit("")])]
    return (
        metrics.select(F.explode(F.array_compact(F.array(*found))).alias("alert"))
        .select("alert.*").select(*FIRED_COLUMNS)
    )


def scanners_in(spans: DataFrame, config: DetectionConfig = DetectionConfig(), tick_secs: int = TICK_SECS) -> DataFrame:
    """Sources with enough distinct destination ports, per tick, from the spans of
    their port counts.

    The threshold is applied to spans, before they are expanded to ticks.
    """
    c = config.port_scan
    wide = spans.where(F.col("n_ports") >= c.min_unique_dst_ports)
    per_tick = with_tick(at_ticks(wide, tick_secs)).select(
        "window_secs", "tick", F.col("src_ip").alias("scan_ip"), F.col("n_ports").alias("scan_ports"))
    return per_tick if c.all_sources else widest_scanner(per_tick)


def scanners(flows: DataFrame, config: DetectionConfig = DetectionConfig(), tick_secs: int = TICK_SECS) -> DataFrame:
    """Sources with enough distinct destination ports, per tick."""
    return scanners_in(fanout_spans(flows, (RULES["port_scan"][0],), tick_secs), config, tick_secs)


def widest_scanner(per_tick: DataFrame) -> DataFrame:
    order = Window.partitionBy("window_secs", "tick").orderBy(F.desc("scan_ports"), F.asc("scan_ip"))
    return per_tick.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def with_scanners(metrics: DataFrame, per_tick: DataFrame) -> DataFrame:
    return metrics.join(per_tick, ["window_secs", "tick"], "left")


def scan_windows(config: DetectionConfig) -> tuple[int, ...]:
    """The window whose port contacts are read, if any is."""
    return (RULES["port_scan"][0],) if "port_scan" in enabled_rules(config) else ()


def candidate_alerts(
    flows: DataFrame, config: DetectionConfig = DetectionConfig(), tick_secs: int = TICK_SECS,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """Flows → candidates. Takes the metrics rows if they exist already, else
    computes only the windows that enabled rules read. The flows are read once: their
    pane sums are written and everything follows from these."""
    windows = tuple(sorted({RULES[n][0] for n in enabled_rules(config)})) or (10,)
    scanned = scan_windows(config)
    if metrics is None or scanned:
        panes = settle(pane_rows(flows, windows, tick_secs, contacts=bool(scanned)), "panes")
        metrics = pane_metrics(panes, windows, tick_secs) if metrics is None else metrics
    if scanned:
        metrics = with_scanners(metrics, scanners_in(pane_contacts(panes, scanned, tick_secs), config, tick_secs))
    return route_rules(metrics, config)
