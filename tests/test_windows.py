import random

import pytest
from moments import T0
from pyspark.sql import Window
from pyspark.sql import functions as F

from weirgauge.operators import coverage as C
from weirgauge.operators import metrics as M
from weirgauge.operators.ticks import assign_windows, pane_secs, tick_spine


def rel(rows):
    return sorted((r.window_secs, int(r.tick.timestamp() * 1000) - T0, *r[2:]) for r in rows)


def test_closed_edges(make_flows):
    flows = make_flows(dict(at=20_000))
    ticks = [t for _, t in rel(assign_windows(flows, (10, 60)).where("window_secs = 10").select("window_secs", "tick").collect())]
    assert ticks == [20_000, 30_000]
    inside = make_flows(dict(at=20_001))
    assert rel(assign_windows(inside, (10,)).select("window_secs", "tick").collect()) == [(10, 30_000)]


@pytest.mark.parametrize("windows, step", [((10, 60, 300), 10), ((10, 60), 7), ((10,), 25), ((15, 40), 10)])
def test_panes_agree_with_direct_windows(spark, make_flows, windows, step):
    rng = random.Random(step)
    flows = make_flows(*[
        dict(at=rng.choice([rng.randrange(0, 400_000), rng.randrange(0, 40) * 10_000, rng.randrange(0, 400) * 1000]),
             src_ip=rng.randrange(8), dst_ip=rng.randrange(4), bytes=rng.choice([0, 10, 10, 500]),
             dst_port=rng.randrange(30), protocol=rng.choice([6, 17, 1]), tcp_flags=rng.choice([2, 18, 16, 0]),
             start_time=rng.randrange(50), end_time=rng.randrange(50)) for _ in range(600)]).cache()
    direct = assign_windows(flows, windows, step).cache()

    def same(left, right):
        assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0

    same(M.window_counts(flows, windows, step), direct.groupBy("window_secs", "tick").agg(
        F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
    ).select("window_secs", "flows", "packets", "bytes", "tick"))
    same(M.unique_endpoints(flows, windows, step), direct.groupBy("window_secs", "tick").agg(
        F.countDistinct("src_ip").alias("a"), F.countDistinct("dst_ip").alias("b")).select("window_secs", "a", "b", "tick"))
    same(M.bytes_by_endpoint(flows, windows, step).where("side = 0").drop("side").select("window_secs", "tick", "ip", "bytes"),
         direct.groupBy("window_secs", "tick", "src_ip").agg(F.sum("bytes")))
    same(M.source_port_fanout(flows, windows, step).select("window_secs", "tick", "src_ip", "n_ports"),
         direct.groupBy("window_secs", "tick", "src_ip").agg(F.countDistinct("dst_port")))
    rank = F.row_number().over(Window.partitionBy("window_secs", "tick").orderBy(F.desc("bytes"), F.asc("ip")))
    largest = direct.groupBy("window_secs", "tick", F.col("src_ip").alias("ip")).agg(F.sum("bytes").alias("bytes"))
    for n in (1, 3, 5):
        same(M.top_talkers(flows, windows, step, n).where("side = 0").select("window_secs", "tick", "ip", "bytes", "rank"),
             largest.withColumn("rank", rank).where(F.col("rank") <= n))


def test_segments_do_not_change_results(make_flows):
    rng = random.Random(3)
    flows = make_flows(*[dict(at=rng.randrange(0, 900_000), src_ip=rng.randrange(5)) for _ in range(300)])
    panes = M.endpoint_panes(flows, 10).where("side = 0").drop("side").withColumnRenamed("bytes", "amount")
    reaches = M.closed_reaches((10, 300))
    results = []
    for ticks in (1, 30, 31, 360):
        placed = C.place_partials(panes, ["ip"], reaches, segment_ticks=ticks)
        sums = C.amount_spans(placed, ["ip"], reaches, segment_ticks=ticks)
        present = C.presence_spans(placed, ["ip"], reaches, segment_ticks=ticks)
        results.append([sorted(map(tuple, C.at_ticks(spans).collect())) for spans in (
            sums, present, C.count_spans(present, [], "n"), C.count_spans(sums, [], "n"))])
        assert results[-1][2] == results[-1][3]
    assert all(r == results[0] for r in results) and results[0][0]


def test_pane_width():
    assert pane_secs((10, 60, 300), 10) == 10
    assert pane_secs((10, 60), 7) == 1
    assert pane_secs((15, 40), 10) == 5


def test_counts_and_protocols(make_flows):
    flows = make_flows(dict(src_ip=1, bytes=1000, packets=10, protocol=6), dict(src_ip=2, bytes=2000, packets=20, protocol=17),
                       dict(src_ip=1, bytes=0, packets=0, protocol=6))
    (row,) = M.window_metrics(flows, (60,)).collect()
    assert (row.flows, row.packets, row.bytes, row.unique_src_ips, row.unique_dst_ips) == (3, 30, 3000, 2, 1)
    assert row.protocol_dist == {6: 2, 17: 1}
    assert (row.flows_per_sec, row.packets_per_sec, row.bytes_per_sec) == (3 / 60, 0.5, 50.0)
    assert [(t.ip, t.bytes) for t in row.top_src_ips] == [(2, 2000), (1, 1000)]


def test_tcp_counters(make_flows):
    flows = make_flows(
        dict(tcp_flags=0x02, start_time=0, end_time=101), dict(tcp_flags=0x12, start_time=500, end_time=100),
        dict(tcp_flags=0x10), dict(protocol=17, tcp_flags=0x02, end_time=9999))
    (row,) = M.window_metrics(flows, (10,)).collect()
    assert (row.tcp_flows, row.syn_only_flows, row.avg_flow_duration_ms) == (3, 1, 33)
    (udp,) = M.window_metrics(make_flows(dict(protocol=17)), (10,)).collect()
    assert (udp.tcp_flows, udp.avg_flow_duration_ms) == (0, 0)


def test_top_five_ties_go_to_the_lower_address(make_flows):
    flows = make_flows(*[dict(src_ip=ip, bytes=100) for ip in (9, 3, 7, 1, 5, 8)], dict(src_ip=4, bytes=101))
    (row,) = M.window_metrics(flows, (10,)).collect()
    assert [t.ip for t in row.top_src_ips] == [4, 1, 3, 5, 7]


def test_quiet_ticks_are_zero(make_flows):
    flows = make_flows(dict(at=1), dict(at=45_000))
    rows = rel(M.window_metrics(flows, (10,)).select("window_secs", "tick", "flows", "top_src_ips").collect())
    assert [(t, n) for _, t, n, _ in rows] == [(10_000, 1), (20_000, 0), (30_000, 0), (40_000, 0), (50_000, 1)]
    assert rows[1][3] == []
    busy = M.window_metrics(flows, (10,), keep_empty=False)
    assert busy.count() == 2
    assert tick_spine(flows, (10, 60)).count() == 10


def test_no_flows_at_all(make_flows):
    assert M.window_metrics(make_flows(dict()).limit(0)).count() == 0


def test_latest_snapshot_and_event(make_flows):
    metrics = M.window_metrics(make_flows(dict(at=1, src_ip=16843009, bytes=7), dict(at=25_000)), (10, 60))
    latest = rel(M.latest_snapshot(metrics).select("window_secs", "tick", "flows").collect())
    assert latest == [(10, 30_000, 1), (60, 30_000, 2)]
    event = M.snapshot_event(metrics).orderBy("window_secs", "tick").first()
    assert (event.top_src_ips, event.protocol_dist) == ("1.1.1.1=7", "6=1")


def test_ports_of_a_source_are_bitmaps(spark, make_flows):
    """A scanner of all ports beside sources with a few, also on word borders."""
    ports = [0, 63, 64, 127, 4095, 32767, 32768, 65535]
    few = make_flows(*[dict(src_ip=7, dst_port=p, at=n * 9000 + 1) for n, p in enumerate(ports * 2)])
    base = make_flows(dict(src_ip=9, at=5000))
    scan = base.drop("dst_port").crossJoin(spark.range(65_536).select(F.col("id").cast("int").alias("dst_port"))).select(*base.columns)
    flows = few.unionByName(scan)
    panes = M.port_panes(flows, 10)
    assert panes.where("src_ip = 9").count() == 1024  # not 65536
    fanout = M.source_port_fanout(flows, (60,))
    got = sorted((r.src_ip, int(r.tick.timestamp() * 1000) - T0, r.n_ports) for r in fanout.collect())
    want = M.with_tick(M.expand_windows(flows.withColumn("moment_us", M.event_us(flows)), "moment_us", (60,), 10)).groupBy(
        "src_ip", "tick").agg(F.countDistinct("dst_port").alias("n"))
    assert got == sorted((r.src_ip, int(r.tick.timestamp() * 1000) - T0, r.n) for r in want.collect())
    assert max(n for _, _, n in got) == 65_536


def test_port_bitmaps_are_opened_where_they_arrive(make_flows):
    plan = M.source_port_fanout(make_flows(dict()), (60,))._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0:]
    assert "dst_port" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    # Pane bitmaps, bitmaps by segment, change points of the counts by place and in order.
    assert plan.count("Exchange hashpartitioning") == 4
