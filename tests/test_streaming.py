import random
from functools import reduce

import pytest
from moments import T0, moment
from packets import STANDARD, cut, record, template, v5, v5_record, v9
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.config import DetectionConfig, EngineConfig, PortScanConfig
from weirgauge.operators import alerts as A
from weirgauge.operators import metrics as M
from weirgauge.operators import views as V
from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.operators.decode import decode_flows
from weirgauge.operators.panes import merge_panes, pane_rows
from weirgauge.operators.rules import candidate_alerts
from weirgauge.operators.ticks import tick_spine
from weirgauge.plans.pipelines import run_available, stream_samples
from weirgauge.schema import DATAGRAM_SCHEMA, FLOW_SCHEMA, WINDOW_METRICS_SCHEMA
from weirgauge.sources.flow_table import read_flows
from weirgauge.streaming import metrics_stream, tables
from weirgauge.streaming.alert_stream import sent_alerts, stored_alerts
from weirgauge.streaming.decode_stream import VERSION_TABLE, decode_batch
from weirgauge.streaming.engine import FLOW_TABLE, process_flows, start_flow_engine
from weirgauge.streaming.metrics_stream import absorb_flows, current_metrics, stored_exporters, stored_totals
from weirgauge.streaming.tables import FANOUT, groups_of, read_batch, read_table, write_batch

NOW = {"availableNow": True}
FLAT = ["map_entries(protocol_dist) as protocol_dist" if c == "protocol_dist" else c for c in WINDOW_METRICS_SCHEMA.fieldNames()]


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def capture(spark, path, first, *packets):
    rows = [(first + n, moment(T0 + ms), exporter, bytearray(payload)) for n, (ms, exporter, payload) in enumerate(packets)]
    spark.createDataFrame(rows, DATAGRAM_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream_equals_batch(spark, root, flows):
    """Everything the stream holds is what the batch operators make of all flows."""
    same(read_flows(spark, f"{root}/flows").select(*FLOW_SCHEMA.fieldNames()), flows)
    same(current_metrics(spark, root).selectExpr(*FLAT), M.window_metrics(flows, keep_empty=False).selectExpr(*FLAT))
    want = A.number_alerts(apply_cooldown(candidate_alerts(flows)))
    same(stored_alerts(spark, root), want)
    totals = stored_totals(spark, root).first()
    assert totals["flows"] == flows.count() and totals["bytes"] == flows.agg(F.sum("bytes")).first()[0]
    return want


def traffic(rng, exporter, start, seconds):
    out = []
    for second in range(start, start + seconds):
        for _ in range(3):
            out.append((second * 1000 + rng.randrange(1000), exporter, v5(
                v5_record(dst=(1, 1, 1, 1), octets=90_000 + second, sport=rng.randrange(9)),
                v5_record(src=(10, 0, rng.randrange(3), 7), dport=rng.randrange(40), proto=17, octets=700))))
    return sorted(out, key=lambda packet: packet[0])


def test_datagrams_to_alerts_in_two_sittings(spark, tmp_path):
    folder, root = str(tmp_path / "capture"), str(tmp_path / "out")
    rng = random.Random(5)

    def templated(start, seconds):
        return [(s * 1000, "10.9.9.2", v9(cut(256, record(ie1=100 + s)))) for s in range(start, start + seconds)]

    def mixed(start, seconds):
        return sorted(traffic(rng, "10.9.9.1", start, seconds) + templated(start, seconds), key=lambda p: p[0])

    announce = (20_000, "10.9.9.2", v9(cut(0, template(256, STANDARD))))
    # The template of the second exporter arrives after its first packets and is
    # only sent in the first sitting.
    capture(spark, folder, 0, *mixed(0, 20), announce, *mixed(20, 100))
    run_available(spark, folder, root)
    capture(spark, folder, 10_000, *mixed(120, 95))
    run_available(spark, folder, root)

    flows = decode_flows(spark.read.schema(DATAGRAM_SCHEMA).parquet(folder)).cache()
    assert flows.where("exporter_ip = '10.9.9.2'").count() == 195
    want = stream_equals_batch(spark, root, flows)
    # The hot destination and the SYN-only TCP flows fire at 10, 70, 130 and 190 seconds.
    assert {r.rule: r["count"] for r in want.groupBy("rule").count().collect()} == {"destination_hotspot": 4, "syn_flood": 4}
    sent = sent_alerts(spark, root)
    same(sent.select("rule", "target_ip", "triggered_at"), want.select("rule", "target_ip", "triggered_at"))
    assert stored_exporters(spark, root).count() == 2
    samples = stream_samples(spark, root)
    assert not [f for f in samples.inputFiles() if "/flows/" in f]
    flat = ["tick", "metric", "map_entries(labels) as labels", "value"]
    batch = V.metric_samples(flows, M.window_metrics(flows), want, tick_spine(flows, (10,)))
    same(samples.selectExpr(*flat), batch.selectExpr(*flat))
    assert samples.where("metric = 'flows_total'").agg(F.max("value")).first()[0] == flows.count()


def test_a_second_exporter_comes_later_over_the_same_time(spark, tmp_path):
    """Late flows, several micro-batches, files out of order: nothing is lost."""
    folder, root = str(tmp_path / "capture"), str(tmp_path / "out")
    rng = random.Random(6)
    early = traffic(rng, "10.9.9.1", 0, 100)
    capture(spark, folder, 5000, *early[150:])
    capture(spark, folder, 0, *early[:150])
    run_available(spark, folder, root, files_per_batch=1)
    capture(spark, folder, 9000, *traffic(rng, "10.9.9.3", 0, 80))
    capture(spark, folder, 9900, *traffic(rng, "10.9.9.1", 400, 5))
    run_available(spark, folder, root, files_per_batch=1)
    flows = decode_flows(spark.read.schema(DATAGRAM_SCHEMA).parquet(folder)).cache()
    assert flows.count() == 2 * 3 * 185
    stream_equals_batch(spark, root, flows)
    sent = sent_alerts(spark, root)
    assert sent.count() == sent.select("rule", "target_ip", "triggered_at").distinct().count() > 0


def hot_flows(make_flows, seconds, exporter="e"):
    return make_flows(*[dict(at=s * 1000 + n, src_ip=n, dst_ip=9, bytes=50_000, exporter_ip=exporter) for s in seconds for n in range(4)])


def test_replayed_batches_leave_no_double(spark, make_flows, tmp_path, monkeypatch):
    """A batch breaks off after some of its tables are written, is read meanwhile, and
    runs again."""
    root = str(tmp_path / "out")
    first, second = hot_flows(make_flows, range(0, 50)), hot_flows(make_flows, range(50, 130))
    process_flows(first, 0, root)
    for broken in ("absorb_flows", "deliver_batch", None):
        if broken:
            with monkeypatch.context() as patch:
                def fail(*args, **kwargs):
                    raise RuntimeError("executor lost")
                patch.setattr(f"weirgauge.streaming.engine.{broken}", fail)
                with pytest.raises(RuntimeError):
                    process_flows(second, 1, root)
            assert read_table(spark, f"{root}/flows", FLOW_TABLE).count() == 4 * 130
        else:
            process_flows(second, 1, root)
            process_flows(second, 1, root)
    flows = first.unionByName(second)
    want = stream_equals_batch(spark, root, flows)
    sent = sent_alerts(spark, root)
    assert sent.count() == sent.select("rule", "target_ip", "triggered_at").distinct().count()
    # All but the tick still open has been sent.
    closed = want.where(F.unix_millis("triggered_at") <= T0 + 120_000)
    same(sent.select("rule", "target_ip", "triggered_at"), closed.select("rule", "target_ip", "triggered_at"))


def test_earlier_batches_do_not_see_later_ones(spark, make_flows, tmp_path):
    """A replay computes from the tables as its predecessors left them."""
    root = str(tmp_path / "out")
    for n, seconds in enumerate((range(0, 10), range(10, 20), range(20, 30))):
        process_flows(hot_flows(make_flows, seconds), n, root)
    before = read_batch(spark, f"{root}/metrics", metrics_stream._METRICS, 1, ["day"]).selectExpr(*FLAT).collect()
    process_flows(hot_flows(make_flows, range(10, 20)), 1, root)
    assert sorted(read_batch(spark, f"{root}/metrics", metrics_stream._METRICS, 1, ["day"]).selectExpr(*FLAT).collect()) == sorted(before)


def test_write_batch(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = spark.range(1).schema
    assert read_table(spark, path, schema).count() == 0
    write_batch(spark.range(3), path, 4)
    write_batch(spark.range(30), path, 4)
    write_batch(spark.range(2), path, 5)
    assert read_table(spark, path, schema).count() == 32 and read_batch(spark, path, schema, 4).count() == 30
    assert read_batch(spark, path, schema, 6).count() == 0


def test_groups_of_batches():
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 8640):
        groups = groups_of(n)
        covered = [b for tier, last in groups for b in range(last - FANOUT ** tier + 1, last + 1)]
        assert covered == list(range(n))
    assert len(groups_of(8640)) <= 20 and max(len(groups_of(n)) for n in range(8640)) <= 35


def test_many_batches_are_merged_by_tiers(spark, make_flows, tmp_path, monkeypatch):
    """Groups of two and four batches; a replay of the batch that closes them."""
    monkeypatch.setattr(tables, "FANOUT", 2)
    root = str(tmp_path / "out")
    parts = [make_flows(*[dict(at=(7 * n + k) * 1000, src_ip=k, dst_port=n * 64 + k, bytes=n) for k in range(4)]) for n in range(5)]
    for n, part in enumerate(parts):
        absorb_flows(part, n, root)
        if n == 3:
            absorb_flows(part, n, root)
    flows = reduce(DataFrame.unionByName, parts)
    same(current_metrics(spark, root).selectExpr(*FLAT), M.window_metrics(flows, keep_empty=False).selectExpr(*FLAT))
    read = tables.read_tiered(spark, f"{root}/panes", metrics_stream._PANES, 4, "hour", [T0 // 3_600_000])
    assert {tuple(f.split("/")[-4:-2]) for f in read.inputFiles()} == {("tier=2", "batch_id=3"), ("tier=0", "batch_id=4")}
    merged = merge_panes(read.drop("hour"))
    same(merged, merge_panes(pane_rows(flows)))


def test_a_stray_old_flow_reads_its_own_hour(spark, make_flows, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    process_flows(hot_flows(make_flows, range(0, 7200, 600)), 0, root)
    stray = make_flows(dict(at=-T0 + 1000 * 3600 * 5 + 1_800_000), dict(at=7_150_000, bytes=7))
    seen, read = [], metrics_stream.read_tiered

    def noted(spark, path, schema, batch_id, by, values):
        rows = read(spark, path, schema, batch_id, by, values)
        seen.append((sorted(values), {f.split("/hour=")[1].split("/")[0] for f in rows.inputFiles()}))
        return rows

    monkeypatch.setattr(metrics_stream, "read_tiered", noted)
    process_flows(stray, 1, root)
    today = T0 // 3_600_000
    assert seen == [([5, today + 1, today + 2], {"5", str(today + 1)})]
    flows = hot_flows(make_flows, range(0, 7200, 600)).unionByName(stray)
    same(current_metrics(spark, root).selectExpr(*FLAT), M.window_metrics(flows, keep_empty=False).selectExpr(*FLAT))


def test_templates_written_per_batch_do_not_grow(spark, tmp_path):
    """A batch writes the versions that it has received, not those known before."""
    path, narrow = str(tmp_path / "templates"), STANDARD[:9]
    got = []
    for n in range(6):
        fields = narrow if n % 2 else STANDARD
        packets = [v9(cut(256, record(narrow if n % 2 == 0 else STANDARD, ie1=10 * n))) if n else v9(),
                   v9(cut(0, template(256, fields)), cut(256, record(fields, ie1=10 * n + 1)))]
        batch = spark.createDataFrame(
            [(10 * n + k, moment(T0 + n), "e", bytearray(p)) for k, p in enumerate(packets)], DATAGRAM_SCHEMA)
        for _ in range(1 + (n == 3)):  # one batch is replayed
            rows = decode_batch(batch, n, path).select("bytes").collect()
        got += [r.bytes for r in rows]
    assert sorted(got) == sorted([10 * n + 1 for n in range(6)] + [10 * n for n in range(1, 6)])
    own = [tables.read_own(spark, path, VERSION_TABLE, n, "shard").count() for n in range(6)]
    assert own == [1] * 6


def test_contacts_only_where_they_are_read(spark, make_flows, tmp_path):
    off = DetectionConfig(port_scan=PortScanConfig(enabled=False))
    flows = make_flows(*[dict(at=n * 100, dst_port=n) for n in range(60)])
    absorb_flows(flows, 0, str(tmp_path / "on"))
    absorb_flows(flows, 0, str(tmp_path / "off"), off)
    topics = {name: {r.topic for r in read_table(spark, str(tmp_path / name / "panes"), metrics_stream._PANES).select("topic").distinct().collect()}
              for name in ("on", "off")}
    assert topics == {"on": {0, 1, 2, 3}, "off": {0, 1, 2}}


def test_empty_batches(spark, make_flows, tmp_path):
    root = str(tmp_path / "out")
    process_flows(make_flows(), 0, root)
    assert current_metrics(spark, root).count() == 0 and stored_alerts(spark, root).count() == 0
    process_flows(hot_flows(make_flows, range(5)), 1, root)
    process_flows(make_flows(), 2, root)
    process_flows(hot_flows(make_flows, range(5, 9)), 3, root)
    stream_equals_batch(spark, root, hot_flows(make_flows, range(9)))


@pytest.mark.parametrize("windows, step", [((10,), 25), ((15, 40), 10)])
def test_odd_windows(spark, make_flows, tmp_path, windows, step):
    rng = random.Random(step)
    at = [rng.choice([rng.randrange(300_000), rng.randrange(60) * 5000]) for _ in range(200)]
    root = str(tmp_path / "out")
    off = DetectionConfig(enabled=False)
    flows = make_flows(*[dict(at=ms, src_ip=ms % 5) for ms in at], dict(at=900_000))
    for n, part in enumerate(flows.randomSplit([1.0, 1.0, 1.0], 3)):
        absorb_flows(part, n, root, off, windows, step)
    same(current_metrics(spark, root).selectExpr(*FLAT), M.window_metrics(flows, windows, step, keep_empty=False).selectExpr(*FLAT))


def test_flow_stream(spark, make_flows, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    make_flows(dict(at=1), dict(at=2, exporter_ip="b", bytes=5)).write.parquet(source)
    start_flow_engine(spark.readStream.schema(FLOW_SCHEMA).parquet(source), root, EngineConfig(), **NOW).awaitTermination()
    assert tuple(stored_totals(spark, root).first()) == (2, 2, 105)
    assert read_flows(spark, f"{root}/flows").where("flow_date = '2024-01-01'").count() == 2
