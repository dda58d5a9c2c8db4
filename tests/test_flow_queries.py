import datetime as dt
import json

import pytest
from moments import T0, moment
from pyspark.sql import functions as F

from weirgauge.config import DetectionConfig, EngineConfig, PortScanConfig, UdpFloodConfig, validate_config
from weirgauge.operators import flow_queries as Q
from weirgauge.operators import views as V
from weirgauge.operators.metrics import window_metrics
from weirgauge.operators.ticks import tick_spine
from weirgauge.plans.pipelines import fired_alerts
from weirgauge.sources.flow_table import read_flows, write_flows


def test_range_is_closed_and_newest_first(make_flows):
    flows = make_flows(dict(at=500), dict(at=1500))
    assert Q.flows_in_range(flows, T0 + 1000, T0 + 2000, 10).count() == 1
    found = Q.flows_in_range(flows, T0 + 500, T0 + 1500, 10).collect()
    assert [r.received_at_ms - T0 for r in found] == [1500, 500]
    assert Q.flows_in_range(make_flows(*[dict(at=n) for n in range(5)]), T0, T0 + 9, 3).count() == 3


def test_table_keeps_rows_and_prunes(spark, make_flows, tmp_path):
    flows = make_flows(dict(at=0), dict(at=86_400_000, exporter_ip="2001:db8::1", bytes=4_000_000_000), dict(at=-1))
    path = str(tmp_path / "flows")
    write_flows(flows, path)
    write_flows(make_flows(dict(at=5)), path)
    table = read_flows(spark, path)
    assert table.count() == 4
    assert table.drop("flow_date").intersectAll(flows).count() == 3
    query = Q.flows_in_range(table, T0 + 86_400_000, T0 + 86_400_001, 10)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flow_date" in plan and "GreaterThanOrEqual(received_at_ms" in plan
    assert query.count() == 1


def test_newest_flows_of_a_long_range_read_the_newest_dates(spark, make_flows, tmp_path):
    day, path = 86_400_000, str(tmp_path / "flows")
    write_flows(make_flows(*[dict(at=n * day + k * 60_000, bytes=k) for n in range(0, 400, 8) for k in range(3)]), path)
    table, last = read_flows(spark, path), T0 + 400 * day

    def since(limit, start=T0):
        return (Q.oldest_date_needed(table, start, last, limit) - dt.date(2024, 1, 1)).days

    # Looked at: the last date, two before it, four before these, and so on.
    assert [since(n) for n in (2, 6, 40, 1000)] == [400 - 14, 400 - 30, 400 - 126, 0]
    newest = Q.flows_in_range(table, T0, last, 2)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flow_date" in plan and ">= 2025-01-2" in plan
    assert [(r.received_at_ms - T0) // day for r in newest.collect()] == [392, 392]
    some, everything = Q.flows_in_range(table, T0, last, 40), Q.flows_in_range(table, T0, last, 1000)
    assert some.count() == 40 and everything.count() == 150
    assert Q.flows_in_range(table, last - 20 * day, last, 1000).count() == 6
    assert Q.flows_in_range(table, T0 + 5, T0 + 4, 10).count() == 0 and Q.flows_in_range(table, T0, last, 0).count() == 0
    assert Q.flows_in_range(table.drop("flow_date"), T0, last, 40).collect() == some.collect()


def test_history_arguments(make_flows):
    flows = make_flows(*[dict(at=n * 1000) for n in range(1200)])
    now = moment(T0 + 1_200_000)

    def count(**how):
        return Q.flow_history(flows, now=now, **how).count()

    assert count() == 100
    assert count(limit=5000) == 1000
    assert count(start="2024-01-01T00:19:00Z", limit=1000) == 60
    assert count(start="rubbish", limit=1000) == 1000
    assert count(end="2024-01-01T00:00:09Z", limit=1000) == 10
    assert count(end="rubbish", limit=7) == 7
    row = Q.flow_history(make_flows(dict(at=1999, src_ip=16843009)), now=now).first()
    assert (row.src_ip, row.received_at, row.total) == ("1.1.1.1", "2024-01-01T00:00:01Z", 1)
    assert Q.flow_history(flows, end="1999-01-01T00:00:00Z").count() == 0


def test_totals_and_exporters(make_flows):
    flows = make_flows(dict(at=0, exporter_ip="a"), dict(at=100_000, exporter_ip="b"), dict(at=50_000, exporter_ip="a"))
    assert tuple(Q.flow_totals(flows).first()) == (3, 3, 300)
    assert tuple(Q.flow_totals(flows.limit(0)).first()) == (0, 0, 0)
    seen = {r.exporter_ip: int(r.last_seen.timestamp() * 1000) - T0 for r in Q.exporter_last_seen(flows).collect()}
    assert seen == {"a": 50_000, "b": 100_000}

    def active(ms):
        return Q.active_exporters(flows, F.timestamp_millis(F.lit(T0 + ms))).first()[0]

    assert [active(-1), active(0), active(100_000), active(349_999), active(350_000), active(400_000)] == [0, 1, 2, 2, 1, 0]
    per_tick = {int(r.tick.timestamp() * 1000) - T0: r.active_exporters for r in V.exporters_per_tick(flows).collect()}
    assert per_tick[0] == 1 and per_tick[100_000] == 2 and per_tick[340_000] == 2
    assert per_tick[350_000] == 1 and 400_000 not in per_tick


def test_events(make_flows):
    event = json.loads(Q.flow_events(make_flows(dict(at=1500, dst_ip=16843009))).first().event)
    assert len(event) == 12 and event["dst_ip"] == "1.1.1.1" and event["received_at"] == "2024-01-01T00:00:01.500Z"


def test_views(make_flows):
    flows = make_flows(dict(at=1, src_ip=16843009, bytes=600), dict(at=15_000, bytes=1000, exporter_ip="b"))
    metrics = window_metrics(flows)
    headline = V.summary(metrics, flows).first()
    assert (headline.window_secs, headline.bytes_per_sec, headline.active_exporters) == (10, 100.0, 2)
    talkers = V.top_talkers_view(metrics).where("side = 'source'").orderBy("rank").collect()
    assert [(t.ip, t.bytes, t.bytes_per_sec) for t in talkers] == [("0.0.0.1", 1000, 1000 / 60), ("1.1.1.1", 600, 10.0)]
    assert V.summary(metrics.limit(0), flows.limit(0)).count() == 0
    fired = fired_alerts(flows)
    samples = V.metric_samples(flows, metrics, fired, tick_spine(flows, (10,)), prefix="net_").cache()
    names = {r.metric for r in samples.select("metric").distinct().collect()}
    assert names == {"net_" + n for n in [*V.GAUGES, *V.COUNTERS, "alerts_total", "active_exporters"]}
    last = {r.metric: r.value for r in V.latest_samples(samples, ["net_bytes_total", "net_flows_per_sec"], "60s").collect()}
    assert last == {"net_bytes_total": 1600.0, "net_flows_per_sec": 2 / 60}
    assert V.total_alerts(fired.limit(0)).first()[0] == 0
    assert V.rate_series(metrics, "bytes_per_sec").count() == 6


def test_logs(spark):
    rows = [(0, "warn", "ALERT"), (60_000, "error", "Alert"), (60_001, "info", "no alert here"), (75_000, "warning", "x")]
    lines = spark.createDataFrame(
        [(moment(T0 + at), json.dumps(dict(level=level, message=message))) for at, level, message in rows]
        + [(moment(T0), "not json")], "ts timestamp, line string")
    assert V.log_filter(lines).count() == 5
    assert sorted(r.level for r in V.log_filter(lines, level="error|warn").collect()) == ["error", "warn"]
    assert V.log_filter(lines, message="(?i)alert").count() == 2
    rates = {(int(r.tick.timestamp() * 1000) - T0, r.level): r.rate for r in V.log_rate(lines).collect()}
    assert rates[(45_000, "warn")] == 1 / 60 and (60_000, "warn") not in rates
    assert rates[(60_000, "error")] == 1 / 60 and (60_000, "info") not in rates and rates[(75_000, "info")] == 1 / 60


def test_config():
    assert validate_config(EngineConfig(accepted_versions=(5, 9, 10)))
    bad = [EngineConfig(accepted_versions=(5, 7)), EngineConfig(snapshot_interval_secs=0),
           EngineConfig(detection=DetectionConfig(cooldown_secs=0)),
           EngineConfig(detection=DetectionConfig(udp_flood=UdpFloodConfig(min_udp_ratio=-0.1))),
           EngineConfig(detection=DetectionConfig(port_scan=PortScanConfig(max_bytes_per_flow=-1)))]
    for config in bad:
        with pytest.raises(ValueError):
            validate_config(config)
    assert EngineConfig().detection.cooldown_secs == 60
