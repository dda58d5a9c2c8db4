import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgauge.llm import embedding_links as E

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, place int, tile int, links int, id int, dim int"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, 3, 4, 5) for i, v in rows], schema)


def brute(rows, threshold=E.THRESHOLD):
    """All pairs of rows, one by one."""
    units = []
    for _, v in rows:
        good = v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(x != 0 for x in v)
        units.append(np.array(v, np.float32).astype(float) if good else None)
    n, links = len(rows), [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b):
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold or np.array_equal(a, b):
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        lowest = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), lowest, rows[i][0] == lowest))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def family(seed, n, width, spread, groups):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(groups, width))
    return [(centres[i % groups] + spread * chance.normal(size=width)).astype(np.float32).tolist() for i in range(n)]


@pytest.mark.parametrize("tile_rows", [24, 1000])
def test_equals_all_pairs(spark, tile_rows):
    rows = [(1000 - i, v) for i, v in enumerate(family(1, 160, 24, 0.32, 9) + family(2, 40, 24, 1.0, 40))]
    got = rows_of(E.link_vectors(make(spark, rows), tile_rows=tile_rows, pivots=5))
    assert got == brute(rows)
    assert 0 < sum(r[1] > 0 for r in got) < 200  # some link, some do not


def test_odd_vectors(spark):
    vectors = family(3, 6, 8, 0.1, 2)
    rows = [
        (1, vectors[0]), (2, vectors[2]), (2, vectors[0]), (None, vectors[1]), (None, vectors[1]), (9, vectors[3]),
        (10, None), (11, []), (12, [0.0] * 8), (13, [1.0, None] + [0.0] * 6), (14, [float("nan")] * 8), (15, [float("inf")] + [0.0] * 7),
        (16, vectors[0][:4]), (17, vectors[0][:4]), (18, [x * 1e30 for x in vectors[0]]), (19, [x * 1e-30 for x in vectors[0]]),
        (20, [-x for x in vectors[0]]), (21, [-0.0, 1.0]), (22, [0.0, 1.0]), (None, [0.3, -1.0, 5.0]), (3, [5.0]), (4, [0.5]), (5, [-1.0]),
    ]
    assert rows_of(E.link_vectors(make(spark, rows), tile_rows=4, pivots=3)) == brute(rows)


def test_many_copies_are_one_row_in_the_tiles(spark):
    vectors = family(4, 3, 16, 0.02, 1)
    rows = [(i, vectors[0]) for i in range(500)] + [(i, vectors[1]) for i in range(500, 600)] + [(600, family(5, 1, 16, 1, 1)[0])]
    got = rows_of(E.link_vectors(make(spark, rows)))
    assert got == sorted([(i, 599, 0, i == 0) for i in range(600)] + [(600, 0, 600, True)], key=str)


def test_empty_table_and_double_vectors(spark):
    assert E.link_vectors(make(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-3]), (3, [0.0, 1.0])]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(E.link_vectors(wide)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        E.link_vectors(make(spark, []), threshold=0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 70), st.sampled_from([0.05, 0.5, 0.9, 0.99]), st.floats(0.001, 2))
def test_int8_bounds_lose_no_pair(seed, width, threshold, spread):
    left, right = (np.array(family(seed + k, 40, width, spread, 3), np.float32) + np.float32(1e-3) for k in (0, 1))
    a, b, open_ = E.Tile(left).close(slice(0, 40), E.Tile(right), slice(0, 40), threshold)
    cosine = E.unit_vectors(left) @ E.unit_vectors(right).T
    got = np.zeros_like(cosine, bool)
    got[a, b] = True
    clear = np.abs(cosine - threshold) > 1e-12
    assert (got == (cosine >= threshold))[clear].all()


def test_bounds_leave_few_pairs_open():
    tile = E.Tile(np.array(family(8, 1000, 64, 0.35, 10), np.float32))
    open_ = sum(o for _, _, o in E.tile_links(tile, None, 0.9))
    links = sum(len(a) for a, _, _ in E.tile_links(tile, None, 0.9))
    assert links and open_ < 0.2 * 1000 * 999 / 2


def test_wide_vectors_are_multiplied_in_exact_parts():
    raw = np.ones((2, 3000), np.float32)
    tile = E.Tile(raw)
    assert tile.products(slice(0, 2), tile, slice(0, 2)).tolist() == [[127.0 * 127 * 3000] * 2] * 2


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_forest_connects_as_its_links_do(links):
    forest = E.Forest(31)
    pairs = np.array(links, np.int64).reshape(-1, 2)
    forest.link(pairs[:, 0], pairs[:, 1])
    label = list(range(31))
    for _ in range(31):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert forest.roots(np.arange(31)).tolist() == label


def test_far_tiles_are_not_compared(spark, monkeypatch):
    chance = np.random.default_rng(0)
    centres = np.eye(16)[:8]
    rows = [(i, (centres[i % 8] + 0.01 * chance.normal(size=16)).tolist()) for i in range(160)]
    seen, original = {}, E.tile_pairs

    def counted(tiles, threshold):
        seen["tiles"], pairs = tiles.count(), original(tiles, threshold)
        seen["pairs"] = pairs.count()
        return pairs

    monkeypatch.setattr(E, "tile_pairs", counted)
    assert rows_of(E.link_vectors(make(spark, rows), tile_rows=20, pivots=64)) == brute(rows)
    assert seen == {"tiles": 8, "pairs": 8}


def test_every_pair_of_tiles_is_compared_once(spark):
    for n in (1, 2, 3, 4, 7, 8):
        tiles = spark.createDataFrame([(1, i, [1.0], 0.0) for i in range(n)] + [(2, n + i, [1.0], 0.0) for i in range(3)],
                                      "dim int, tile long, centre array<double>, radius double")
        got = sorted((min(r), max(r)) for r in E.tile_pairs(tiles, 0.9).collect())
        assert got == [(i, j) for i in range(n + 3) for j in range(i, n + 3) if (i < n) == (j < n)]
