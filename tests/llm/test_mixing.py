import random
from collections import defaultdict

import pytest

from weirgauge.llm.mixing import cube_sample, flight, land, mix_sources, mixed_documents, source_targets


def reference_targets(sizes, weights=(5, 2, 1), most=3):
    """Share, stop, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(25)} | {None: 7, "Z": 3, "é": 900, "": 4}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(
        list(sizes.items()), "source string, source_size long").repartition(6)).collect()}
    assert got == pytest.approx(reference_targets(sizes), rel=1e-9, abs=1e-9)


def test_flight_keeps_sums():
    rng = random.Random(3)
    units = [(i, rng.random(), float(rng.randrange(0, 2000))) for i in range(500)]
    decided, left = flight(units, 11)
    final = decided | {k: p for k, p, _ in left}
    assert len(left) <= 2 and set(decided.values()) <= {0.0, 1.0} and len(final) == 500
    assert sum(final.values()) == pytest.approx(sum(p for _, p, _ in units), abs=1e-5)
    assert sum(final[k] * x for k, _, x in units) == pytest.approx(sum(p * x for _, p, x in units), rel=1e-6)


def test_flight_keeps_probabilities():
    """Over many draws each unit is taken about as often as it should be."""
    units = [(i, p, x) for i, (p, x) in enumerate(zip([0.1, 0.5, 0.9, 0.3, 0.7, 0.25], [1.0, 5.0, 9.0, 9.0, 2.0, 4.0]))]
    taken = [0.0] * len(units)
    for seed in range(4000):
        decided, left = flight(units, seed)
        for key, p in (decided | {k: p for k, p, _ in left}).items():
            taken[key] += p / 4000
    assert taken == pytest.approx([p for _, p, _ in units], abs=0.03)


def test_land_is_nearest():
    assert land([(0, 0.5, 10.0), (1, 0.5, 20.0), (2, 0.5, 30.0)]) == {0: 0.0, 1: 0.0, 2: 1.0}
    assert land([]) == {}


def test_levels(spark):
    """Small blocks, so that several levels follow one another."""
    rng = random.Random(9)
    rows = [(s, rng.getrandbits(60), rng.random(), rng.randrange(1, 900), n) for s, n in ((0, 3000), (1, 40)) for _ in range(n)]
    units = spark.createDataFrame(rows, "stratum long, key long, prob double, size long, n_stratum long")
    got = cube_sample(units, block_rows=60).collect()
    again = cube_sample(units.repartition(7), block_rows=60).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    assert {r["prob"] for r in got} == {0.0, 1.0}
    for s in (0, 1):
        due = sum(r[2] * r[3] for r in rows if r[0] == s)
        assert sum(r["prob"] * r["size"] for r in got if r["stratum"] == s) == pytest.approx(due, abs=30)
    assert cube_sample(units.limit(0)).count() == 0


def test_mix(make_docs, odd_rows):
    rng = random.Random(2)
    rows = odd_rows + [(100 + i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice("abcd")) for i in range(400)]
    docs = make_docs(rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    want_size = {}
    for doc_id, text, _, source in rows:
        n = len(text.encode().split()) if text else 0
        sizes[source] += n
        want_size.setdefault(doc_id, []).append(n)
    targets = reference_targets(sizes)
    for r in got:
        assert r["size"] in want_size[r["doc_id"]] and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    by_source = {s: (sizes[s], targets[s]) for s in sizes}
    for r in got:
        assert any(r["source_size"] == n and r["target"] == pytest.approx(t) for n, t in by_source.values())
        target[r["target"]] = target.get(r["target"], 0) + r["taken"]
    for wanted, took in target.items():
        # The large odd documents are most of their sources.
        assert took == pytest.approx(wanted, rel=0.05, abs=80) or wanted > 0.9 * took
    assert sorted(map(str, mix_sources(docs.repartition(3)).collect())) == sorted(map(str, got))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(r["copies"] for r in got) == mixed.count()
    assert mix_sources(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0
