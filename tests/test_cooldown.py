import random

import pytest
from moments import T0, moment

from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.schema import ALERT_SCHEMA, FIRED_COLUMNS
from weirgauge.streaming.metrics_stream import FIRED_SCHEMA


@pytest.fixture(scope="module")
def candidates(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(rule, "High", target, 10, ["x"], moment(T0 + at)) for rule, target, at in rows], FIRED_SCHEMA)
    return make


def result(fired):
    return sorted(((r.rule, r.target_ip or 0, int(r.triggered_at.timestamp() * 1000) - T0) for r in fired.collect()))


def one_by_one(rows, secs):
    last, kept = {}, []
    for rule, target, at in sorted(rows, key=lambda r: r[2]):
        before = last.get((rule, target))
        if before is None or at - before >= secs * 1000:
            last[(rule, target)] = at
            kept.append((rule, target or 0, at))
    return sorted(kept)


def test_exact_boundary(candidates):
    rows = [("a", None, 0), ("a", None, 59_000), ("a", None, 60_000), ("a", None, 119_000)]
    assert result(apply_cooldown(candidates(*rows))) == [("a", 0, 0), ("a", 0, 60_000)]


def test_suppressed_candidates_do_not_extend(candidates):
    rows = [("a", 1, at * 10_000) for at in range(13)]
    assert [at for *_, at in result(apply_cooldown(candidates(*rows)))] == [0, 60_000, 120_000]


def test_keys_are_independent(candidates):
    rows = [("a", None, 0), ("a", 1, 10_000), ("b", None, 20_000), ("a", 2, 30_000), ("a", 1, 40_000)]
    assert len(result(apply_cooldown(candidates(*rows)))) == 4


@pytest.mark.parametrize("secs, block", [(60, 60), (60, 130), (45, 50), (300, 300), (10, 100), (60, 21600)])
def test_agrees_with_one_by_one(candidates, secs, block):
    rng = random.Random(secs * block)
    rows = {(rule, target, rng.randrange(0, 200) * 10_000) for rule in "ab" for target in (None, 5) for _ in range(90)}
    assert result(apply_cooldown(candidates(*rows), secs, block)) == one_by_one(rows, secs)


def test_no_candidates(candidates):
    assert apply_cooldown(candidates(("a", None, 0)).limit(0)).count() == 0
    assert apply_cooldown(candidates(("a", None, 0))).columns == FIRED_COLUMNS
    assert set(FIRED_COLUMNS) == set(ALERT_SCHEMA.fieldNames()) - {"id"}
