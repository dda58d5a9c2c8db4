import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgauge.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, id int, point int, cluster int, distance int, inertia int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def brute(rows, clusters, rounds, components, scale=C.SCALE, seed=C.SEED):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)
    known = [p for _, p in hashed[:clusters]]

    def nearest(p):
        return min((sum((x - y) ** 2 for x, y in zip(p, c)), k) for k, c in enumerate(known))

    for _ in range(rounds):
        members = {}
        for _, p in kept:
            members.setdefault(nearest(p)[1], []).append(p)
        known = [[sum(col) // len(members[k]) for col in zip(*members[k])] if k in members else c for k, c in enumerate(known)]
    found = [(i, *nearest(p)) for i, p in kept]
    own = {}
    for _, d, k in found:
        own[k] = own.get(k, 0) + d
    return sorted(((i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, known[k])).encode()).hexdigest())
                   for i, d, k in found), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.drop("centroid").collect()), key=str)


def vectors(seed, n, width, spread=0.2):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(6, width))
    return [(centres[i % 6] + spread * chance.normal(size=width)).astype(np.float32).tolist() for i in range(n)]


@pytest.mark.parametrize("clusters, width", [(1, 3), (7, 5), (12, 16)])
def test_equals_comparing_with_all(spark, clusters, width):
    rows = list(enumerate(vectors(1, 150, width)))
    got = C.cluster_vectors(make(spark, rows), clusters=clusters, rounds=4, components=width)
    assert rows_of(got) == brute(rows, clusters, 4, width)


def test_odd_vectors_and_ties(spark):
    rows = [
        (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (None, [0.5, 0.5]), (None, [-0.5, -0.001]), (4, None), (5, []),
        (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [float("nan"), 0.0]), (10, [float("-inf"), 0.0]), (11, [-0.0, 0.0]),
    ]
    for clusters in (1, 3, 50):
        got = C.cluster_vectors(make(spark, rows), clusters=clusters, rounds=3, components=2)
        assert rows_of(got) == brute(rows, clusters, 3, 2)


def test_no_vectors(spark):
    empty = C.cluster_vectors(make(spark, []))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    assert empty.count() == 0
    assert C.cluster_vectors(make(spark, [(1, [1.0]), (2, None)])).count() == 0


def test_components_that_do_not_fit_end_the_job(spark):
    with pytest.raises(Exception, match="exceeds"):
        C.cluster_vectors(make(spark, [(1, [1e30, 0.0])]), components=2).collect()


WHOLE = st.integers(-C.MOST + 1, C.MOST - 1) | st.integers(-3, 3)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda d: st.tuples(
    st.lists(st.lists(WHOLE, min_size=d, max_size=d), min_size=1, max_size=12),
    st.lists(st.lists(WHOLE, min_size=d, max_size=d), min_size=1, max_size=12))))
def test_search_finds_the_nearest_of_any_vectors(given_):
    known, points = given_
    owner, best, _ = C.CentroidSearch(known).nearest(np.array(points, np.int64))
    for p, k, d in zip(points, owner.tolist(), best.tolist()):
        assert (d, k) == min((sum((x - y) ** 2 for x, y in zip(p, c)), i) for i, c in enumerate(known))


def test_bounds_spare_distances():
    chance = np.random.default_rng(3)
    level, spread = chance.integers(-5000, 5000, 2000), chance.integers(1, 3000, 2000)
    points = level[:, None] + (spread[:, None] * chance.normal(size=(2000, 16))).astype(np.int64)
    owner, best, computed = C.CentroidSearch(points[:50].tolist()).nearest(points)
    assert computed < 0.5 * 50 * len(points)
    apart = points[:, None, :] - points[None, :50, :]
    assert (best == (apart ** 2).sum(axis=2).min(axis=1)).all()
