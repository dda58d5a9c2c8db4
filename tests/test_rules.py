import dataclasses

from moments import T0
from pyspark.sql import functions as F

from weirgauge.config import (
    DestinationHotspotConfig, DetectionConfig, PortScanConfig, SynFloodConfig, UdpFloodConfig,
)
from weirgauge.operators.rules import candidate_alerts, route_rules, scanners, with_scanners

UDP = dict(flows=100, packets_per_sec=1000.0, unique_src_ips=20, protocol_dist={17: 90, 6: 10},
           top_dst_ips=[(16843009, 900), (134744072, 100)])
SYN = dict(flows=100, tcp_flows=100, syn_only_flows=75, packets_per_sec=500.0, avg_flow_duration_ms=100,
           protocol_dist={6: 100}, top_dst_ips=[(16843009, 900)])
HOT = dict(flows=10, bytes=500_000, bytes_per_sec=50_000.0, top_dst_ips=[(16843009, 450_000), (1, 50_000)],
           protocol_dist={6: 10})


def fired_places(make_metrics, rule, *rows, config=DetectionConfig()):
    found = route_rules(make_metrics(*rows), config).where(F.col("rule") == rule).collect()
    return sorted((int(r.triggered_at.timestamp() * 1000) - T0) // 10_000 for r in found)


def test_udp_flood(make_metrics):
    rows = [UDP, UDP | dict(packets_per_sec=999.0), UDP | dict(protocol_dist={17: 50, 6: 50}),
            UDP | dict(unique_src_ips=5), UDP | dict(protocol_dist={17: 80, 6: 20}, unique_src_ips=10),
            UDP | dict(flows=0), UDP | dict(window_secs=60), UDP | dict(protocol_dist={6: 100})]
    assert fired_places(make_metrics, "udp_flood", *rows) == [0, 4]
    (alert,) = route_rules(make_metrics(UDP)).where("rule = 'udp_flood'").collect()
    assert (alert.severity, alert.target_ip, alert.window_secs) == ("High", None, 10)
    assert alert.indicators == [
        "packets/sec: 1000 (threshold: 1000)", "UDP ratio: 90% of flows (threshold: 80%)",
        "unique source IPs: 20 (threshold: 10)", "unique destination IPs: 1",
        "top destination IPs: 1.1.1.1(900B), 8.8.8.8(100B)"]


def test_syn_flood(make_metrics):
    rows = [SYN, SYN | dict(tcp_flows=0, syn_only_flows=0), SYN | dict(packets_per_sec=499.0),
            SYN | dict(syn_only_flows=60), SYN | dict(avg_flow_duration_ms=501),
            SYN | dict(syn_only_flows=70, avg_flow_duration_ms=500), SYN | dict(window_secs=300)]
    assert fired_places(make_metrics, "syn_flood", *rows) == [0, 5]
    (alert,) = route_rules(make_metrics(SYN)).where("rule = 'syn_flood'").collect()
    assert (alert.severity, alert.target_ip) == ("High", None)
    assert alert.indicators == [
        "packets/sec: 500 (threshold: 500)", "SYN-only ratio: 75% of TCP flows (threshold: 70%)",
        "average flow duration: 100ms (threshold: 500ms)", "unique destination IPs: 1",
        "top destination IPs: 1.1.1.1(900B)"]


def test_destination_hotspot(make_metrics):
    rows = [HOT, HOT | dict(top_dst_ips=[(1, 350_000)]), HOT | dict(bytes_per_sec=50.0), HOT | dict(bytes=0),
            HOT | dict(top_dst_ips=[(1, 400_000)]), HOT | dict(top_dst_ips=[]), HOT | dict(bytes_per_sec=100.0)]
    assert fired_places(make_metrics, "destination_hotspot", *rows) == [0, 4, 6]
    (alert,) = route_rules(make_metrics(HOT)).collect()
    assert (alert.severity, alert.target_ip) == ("Medium", 16843009)
    assert alert.indicators == [
        "destination 1.1.1.1 received 90% of total traffic in 10s window (threshold: 80%)", "traffic rate: 0.1 MB/sec"]


def test_port_scan_rule(make_metrics, spark):
    base = dict(window_secs=60, flows=100, bytes=4400, scan_ports=100)
    cases = [base, base | dict(scan_ports=30), base | dict(bytes=20_000), base | dict(window_secs=10),
             base | dict(scan_ports=50, bytes=10_000), base | dict(flows=0), base | dict(scan_ports=None)]
    metrics = make_metrics(*[{k: v for k, v in c.items() if k != "scan_ports"} for c in cases])
    ports = spark.createDataFrame(
        [(c["window_secs"], n, 7, c["scan_ports"]) for n, c in enumerate(cases)], "window_secs bigint, n bigint, scan_ip bigint, scan_ports bigint")
    per_tick = ports.select("window_secs", F.timestamp_millis(T0 + F.col("n") * 10_000).alias("tick"), "scan_ip", "scan_ports")
    found = route_rules(with_scanners(metrics, per_tick)).orderBy("triggered_at").collect()
    assert [(int(r.triggered_at.timestamp() * 1000) - T0) // 10_000 for r in found] == [0, 4]
    assert found[0].target_ip == 7 and found[0].severity == "Medium"
    assert found[0].indicators == [
        "source 0.0.0.7 contacted 100 unique destination ports in 60s (threshold: 50)",
        "average bytes per flow: 44 bytes (threshold: 100)"]
    other = DetectionConfig(port_scan=PortScanConfig(window_secs=30))
    assert route_rules(with_scanners(metrics, per_tick), other).count() == 0


def test_port_scan_picks_the_widest_then_lowest_source(make_flows):
    flows = make_flows(*[dict(src_ip=s, dst_port=p, bytes=40) for s, n in ((9, 60), (4, 55), (3, 60), (2, 49)) for p in range(n)])
    (best,) = scanners(flows).where("tick = '2024-01-01 00:00:10'").collect()
    assert (best.scan_ip, best.scan_ports) == (3, 60)
    everyone = scanners(flows, DetectionConfig(port_scan=PortScanConfig(all_sources=True)))
    assert sorted(r.scan_ip for r in everyone.where("tick = '2024-01-01 00:00:10'").collect()) == [3, 4, 9]
    alerts = candidate_alerts(flows).where("rule = 'port_scan'").collect()
    assert {a.target_ip for a in alerts} == {3}


def test_switches(make_metrics, make_flows):
    rows = [UDP | dict(bytes=1000, bytes_per_sec=100.0)]
    names = {"udp_flood": UdpFloodConfig, "syn_flood": SynFloodConfig, "destination_hotspot": DestinationHotspotConfig}
    fires = {r.rule for r in route_rules(make_metrics(*rows)).collect()}
    assert fires == {"udp_flood", "destination_hotspot"}
    for name, kind in names.items():
        config = dataclasses.replace(DetectionConfig(), **{name: kind(enabled=False)})
        assert {r.rule for r in route_rules(make_metrics(*rows), config).collect()} == fires - {name}
    off = DetectionConfig(enabled=False)
    assert route_rules(make_metrics(*rows), off).count() == 0
    assert candidate_alerts(make_flows(dict()), off).count() == 0
