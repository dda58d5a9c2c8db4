import random

import pytest
from moments import T0, moment
from pyspark.sql import functions as F

from weirgauge.operators import alerts as A
from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.operators.cooldown_maps import as_candidates, block_maps, compose_maps, last_firings
from weirgauge.streaming import alert_stream, cooldown_tree, tables
from weirgauge.streaming.cooldown_tree import alerts_between, update_cooldown
from weirgauge.streaming.engine import process_flows
from weirgauge.streaming.metrics_stream import _CANDIDATES, _METRICS, DAY, FIRED_SCHEMA, PROGRESS_SCHEMA, _day
from weirgauge.streaming.tables import read_table, write_batch

SECOND = 1_000_000
START = T0 * 1000


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def candidates(spark):
    def make(rows):
        return spark.createDataFrame(
            [(rule, "High", target, 10, ["x"], moment(T0 + at * 1000)) for rule, target, at in rows], FIRED_SCHEMA)
    return make


def plain(rows, quiet):
    """Last firing and number of firings of each key, one candidate after the other."""
    last, count = {}, {}
    for rule, target, at in sorted(rows, key=lambda r: r[2]):
        key = rule, target
        if key not in last or at - last[key] >= quiet:
            last[key], count[key] = at, count.get(key, 0) + 1
    return {key: (START + at * SECOND, count[key]) for key, at in last.items()}


@pytest.mark.parametrize("quiet, block, density", [(60, 60, 90), (60, 130, 40), (45, 50, 150), (300, 300, 30), (0, 100, 20)])
def test_maps_compose_to_the_last_firing(candidates, quiet, block, density):
    rng = random.Random(quiet + block)
    rows = sorted({(rule, target, rng.randrange(300) * 10) for rule in "ab" for target in (None, 5) for _ in range(density)},
                  key=str)
    maps = block_maps(candidates(rows), quiet * SECOND, block * SECOND)
    want = plain(rows, quiet)

    def found(chain, order):
        return {(r.rule, r.target_ip): (r.at_us, r.fired) for r in last_firings(chain, order, quiet * SECOND).collect()}

    assert found(maps, "block") == want
    parent = F.floor(F.col("block") / 4).cast("bigint")
    above = compose_maps(maps, "block", parent, parent * 4, quiet * SECOND)
    assert found(above, "parent") == want
    again = F.floor(F.col("parent") / 4).cast("bigint")
    top = compose_maps(above, "parent", again, again * 4, quiet * SECOND).withColumnRenamed("parent", "top")
    assert found(top, "top") == want


def test_a_map_is_no_larger_than_its_first_block(candidates):
    maps = block_maps(candidates([("a", 1, at * 10) for at in range(600)]), 60 * SECOND, 600 * SECOND)
    parent = F.floor(F.col("block") / 8).cast("bigint")
    above = compose_maps(maps, "block", parent, parent * 8, 60 * SECOND)
    assert above.agg(F.max(F.size("entries"))).first()[0] <= 6
    assert maps.agg(F.max(F.size("exits"))).first()[0] == 6


def test_no_maps(candidates):
    none = block_maps(candidates([("a", 1, 0)]).limit(0), 60 * SECOND, 600 * SECOND)
    parent = F.floor(F.col("block") / 8).cast("bigint")
    assert compose_maps(none, "block", parent, parent * 8, 60 * SECOND).count() == 0
    firings = last_firings(none, "block", 60 * SECOND)
    assert as_candidates(firings, FIRED_SCHEMA.fields).schema.fieldNames() == FIRED_SCHEMA.fieldNames()


class Stream:
    """The tables that a stream's earlier stages leave, with candidates as given."""

    def __init__(self, spark, root, candidates, cooldown):
        self.spark, self.root, self.make, self.cooldown = spark, root, candidates, cooldown
        self.now, self.batch, self.newest = {}, 0, None

    def add(self, low, high, rows, replay=False):
        """A batch with flows from second ``low`` to ``high`` leaves ``rows`` as the
        candidates of the ticks that it touches."""
        if replay:
            self.batch -= 1
        ticks = [t for t in range(-(-low // 10) * 10, high + 300 + 1, 10)]
        self.now.update({t: [] for t in ticks})
        for row in rows:
            self.now[row[2]] = [*self.now[row[2]], row]
        at = [(moment(T0 + t * 1000), 10) for t in ticks]
        blank = self.spark.createDataFrame(at, "tick timestamp, window_secs bigint")
        metrics = blank.select(*[
            (F.col(c.name) if c.name in blank.columns else F.lit(None).cast(c.dataType)).alias(c.name)
            for c in _METRICS.fields if c.name != DAY])
        write_batch(metrics.withColumn(DAY, _day(F.unix_micros("tick"))), f"{self.root}/metrics", self.batch, [DAY])
        found = self.make(rows or [("none", 0, 0)]).where(F.lit(bool(rows)))
        write_batch(found.withColumn(DAY, _day(F.unix_micros("triggered_at"))).select(*_CANDIDATES.fieldNames()),
                    f"{self.root}/candidates", self.batch, [DAY])
        self.newest = max(high, self.newest or 0)
        write_batch(self.spark.createDataFrame([(START + self.newest * SECOND,)], PROGRESS_SCHEMA), f"{self.root}/progress", self.batch)
        spans = [(START + low * SECOND, START + high * SECOND)]
        update_cooldown(self.spark, self.root, self.batch, spans, self.cooldown)
        self.batch += 1

    def expected(self, low, high):
        rows = [r for tick, found in self.now.items() for r in found if tick <= -(-self.newest // 10) * 10]
        numbered = A.number_alerts(apply_cooldown(self.make(rows), self.cooldown))
        at = F.unix_micros("triggered_at")
        return numbered.where(at.between(START + low * SECOND, START + high * SECOND))

    def check(self, low, high):
        want = self.expected(low, high)
        same(alerts_between(self.spark, self.root, START + low * SECOND, START + high * SECOND, self.cooldown), want)
        return want.count()


def test_late_candidates_move_the_phase_of_all_that_follows(spark, tmp_path, candidates, monkeypatch):
    """A key that is always a candidate fires at other ticks after an earlier first one."""
    for module in (tables, cooldown_tree):
        monkeypatch.setattr(module, "FANOUT", 7)
    monkeypatch.setattr(cooldown_tree, "BLOCK_SECS", 100)
    stream = Stream(spark, str(tmp_path / "out"), candidates, 60)
    steady = [("a", 7, t) for t in range(1200, 3010, 10)]
    stream.add(1200, 2700, steady)
    before = stream.check(2000, 2500)
    # A late flow makes the tick before the first one a candidate, too.
    stream.add(890, 890, [("a", 7, 1190)])
    assert stream.check(2000, 2500) > 0 and before > 0
    # All candidates of a stretch go: late flows lower the share that made them.
    stream.add(1500, 1600, [])
    stream.check(1800, 2600)
    stream.add(1500, 1600, [], replay=True)
    stream.check(0, 4000)


def test_batches_in_any_order(spark, tmp_path, candidates, monkeypatch):
    for module in (tables, cooldown_tree):
        monkeypatch.setattr(module, "FANOUT", 6)
    monkeypatch.setattr(cooldown_tree, "BLOCK_SECS", 70)
    rng = random.Random(4)
    stream = Stream(spark, str(tmp_path / "out"), candidates, 45)
    for _ in range(4):
        low = rng.randrange(0, 4000)
        high = low + rng.randrange(0, 500)
        first = -(-low // 10) * 10
        stream.add(low, high, [(rule, target, t) for t in range(first, high + 301, 10) for rule in "ab" for target in (None, 3)
                               if rng.random() < 0.6])
        at = rng.randrange(0, 4500)
        stream.check(at, at + 400)
    stream.check(0, 10_000)


def test_work_of_a_batch_does_not_grow(spark, tmp_path, candidates, monkeypatch):
    """Whatever lies between, a late batch writes its blocks and a node per level."""
    for module in (tables, cooldown_tree):
        monkeypatch.setattr(module, "FANOUT", 12)
    stream = Stream(spark, str(tmp_path / "out"), candidates, 60)
    written = []
    for hours in (1, 64):
        stream.add(hours * 3600, hours * 3600 + 5, [("a", 1, hours * 3600 + 10)])
        stream.add(600, 605, [("a", 1, 610)])
        rows = read_table(spark, f"{stream.root}/cooldown-60", cooldown_tree._STORED).where(F.col("batch_id") == stream.batch - 1)
        nodes = [r[0] for r in rows.select("node").distinct().collect()]
        written.append((sum(n.startswith("0-") for n in nodes), max(int(n.split("-")[0]) for n in nodes), len(nodes)))
    assert len({blocks for blocks, *_ in written}) == 1
    assert all(n <= b + 2 * lv for b, lv, n in written)
    seen, read = [], cooldown_tree.read_parts

    def noted(spark, path, schema, column, values):
        seen.append(len(list(values)))
        return read(spark, path, schema, column, values)

    monkeypatch.setattr(cooldown_tree, "read_parts", noted)
    assert stream.check(64 * 3600, 64 * 3600 + 100) == 1
    # The blocks before are named by the digits of their number.
    assert max(seen) == 8 + 9 + 11 + 4 + 11


def test_another_cooldown_than_the_stream_keeps(spark, make_flows, tmp_path):
    root = str(tmp_path / "out")
    assert alerts_between(spark, root, 0, START).count() == 0
    process_flows(make_flows(*[dict(at=s * 1000, dst_ip=9, bytes=50_000_000) for s in range(100)]), 0, root)
    want = alert_stream.stored_alerts(spark, root)
    assert want.count() > 0
    same(alerts_between(spark, root, START, START + 100 * SECOND), want.where(F.unix_micros("triggered_at") >= START))
    with pytest.raises(ValueError, match="no cooldown of 30 s"):
        alerts_between(spark, root, 0, START, 30)
