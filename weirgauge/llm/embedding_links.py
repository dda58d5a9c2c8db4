"""Near-duplicate embeddings by products of int8 tiles.

Vectors are scaled to unit length and quantised to int8, each with a step of its own.
With ``x = x' + e`` for the quantised ``x'`` and the exactly known length ``E`` of the
error, the product of two unit vectors differs from that of their quantised forms by
``(1 + E1) * (1 + E2) - 1`` at most. The int8 product therefore rejects a pair for
certain, accepts it for certain, or leaves it open; only open pairs are computed again in
double precision. No pair is lost, and none below the threshold is let in.

Equal vectors are one row with a count, so copies make no pairs. The others are sorted by
the nearest of some pivots, which brings likes together, and packed into tiles. A tile is
a ball around its mean direction; two tiles whose balls are too far apart are not compared.
Every other pair of tiles is one task, which holds two tiles and returns a row per vector
that has links at most: their number, and one link to the smallest vector of the vector's
component within the task. So a dense group is counted and connected without writing its
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.llm.components import connected
from weirgauge.llm.ranking import numbered
from weirgauge.storage import settle

THRESHOLD = 0.9
TILE_ROWS = 8_192
PIVOTS = 64  # vectors that order the others; they decide speed and not results
_CHUNK = 2_048
_EXACT_WIDTH = 1_024  # 127 * 127 * 1024 < 2**24: such products are whole numbers in 32-bit floats
_OPEN_AT_ONCE = 1 << 16
_ROUNDING = 1e-9  # more than double precision loses on the way to a bound


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one."""
    wide = raw.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # else squares may overflow
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


class Tile:
    """Int8 form of unit vectors: ``quantised * step`` is off by ``error`` in length."""

    def __init__(self, raw: np.ndarray):
        self.units = unit_vectors(raw)
        self.step = np.abs(self.units).max(axis=1) / 127
        self.quantised = np.rint(self.units / self.step[:, None]).astype(np.int8)
        off = self.units - self.quantised * self.step[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", off, off)) + _ROUNDING

    def products(self, rows: slice, other: "Tile", columns: slice) -> np.ndarray:
        """Whole-number products of quantised vectors."""
        total: np.ndarray | None = None
        for at in range(0, self.quantised.shape[1], _EXACT_WIDTH):
            part = slice(at, at + _EXACT_WIDTH)
            product = self.quantised[rows, part].astype(np.float32) @ other.quantised[columns, part].astype(np.float32).T
            total = product if total is None else total.astype(np.float64) + product
        return total

    def close(self, rows: slice, other: "Tile", columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Places within ``rows`` and ``columns`` of the pairs whose cosine reaches
        ``threshold``, and how many were computed in double precision."""
        product = self.products(rows, other, columns)
        step, error = self.step[rows], self.error[rows]
        other_step, other_error = other.step[columns], other.error[columns]
        # A line of the tile at a time, with the worst error of the other side: passes
        # what may reach the threshold, and a little more.
        reach = threshold + 1 - (1 + error) * (1 + other_error.max())
        least = np.where(reach > 0, reach / (step * other_step.max()), reach / (step * other_step.min()))
        least = np.nextafter(least.astype(product.dtype), product.dtype.type(-np.inf))
        a, b = np.nonzero(product >= least[:, None])
        cosine = product[a, b].astype(np.float64) * step[a] * other_step[b]
        margin = (1 + error[a]) * (1 + other_error[b]) - 1
        may = cosine + margin >= threshold
        a, b, sure = a[may], b[may], (cosine - margin >= threshold)[may]
        unsure = np.flatnonzero(~sure)
        for at in range(0, len(unsure), _OPEN_AT_ONCE):
            some = unsure[at:at + _OPEN_AT_ONCE]
            exact = np.einsum("ij,ij->i", self.units[rows][a[some]], other.units[columns][b[some]])
            sure[some] = exact >= threshold
        return a[sure], b[sure], len(unsure)


class Forest:
    """Components of a few thousand vectors, from links that come in arrays."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def roots(self, places: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(places, return_inverse=True)
        return np.array([self.root(i) for i in distinct.tolist()], np.int64)[back]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take in the links ``a[i], b[i]``. Of many, one per vector and round is made,
        until none joins two components."""
        while len(a):
            _, first_a = np.unique(a, return_index=True)
            _, first_b = np.unique(b, return_index=True)
            for i in np.union1d(first_a, first_b).tolist():
                x, y = self.root(int(a[i])), self.root(int(b[i]))
                self.parent[max(x, y)] = min(x, y)
            apart = self.roots(a) != self.roots(b)
            a, b = a[apart], b[apart]


def _matrix(vectors: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _raw(blob: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<f{width}").reshape(n, -1)


def _pack(width: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table.num_rows
        raw = np.ascontiguousarray(_matrix(table.column("vector"), n), f"<f{width}")
        units = unit_vectors(raw)
        centre = units.sum(axis=0)
        length = float(np.linalg.norm(centre))
        centre = centre / length if length > 0 else units[0]
        radius = float(np.arccos(np.clip((units @ centre).min(), -1, 1))) + _ROUNDING
        return pa.table({
            "n": pa.array([n], pa.int32()), "first": table.column("place").slice(0, 1), "counts": [table.column("n").to_numpy().astype("<i8").tobytes()],
            "vectors": [raw.tobytes()], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius], pa.float64()),
            "dim": table.column("dim").slice(0, 1), "tile": table.column("tile").slice(0, 1)})
    return pack


def tile_links(left: Tile, right: Tile | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Links of a tile with another (``right`` places count on from ``left``'s), or
    within it, chunk by chunk."""
    n = len(left.step)
    other = right or left
    for at in range(0, n, _CHUNK):
        for to in range(0 if right else at, len(other.step), _CHUNK):
            a, b, open_ = left.close(slice(at, at + _CHUNK), other, slice(to, to + _CHUNK), threshold)
            a, b = a + at, b + to
            if right is None:
                upper = a < b
                a, b = a[upper], b[upper]
            yield a, b + (n if right else 0), open_


def _compare(width: int, threshold: float):
    def compare(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("first")
        tiles = [Tile(_raw(v, n, width)) for v, n in zip(pair["vectors"], pair["n"])]
        counts = np.concatenate([np.frombuffer(c, "<i8") for c in pair["counts"]])
        places = np.concatenate([np.arange(f, f + n) for f, n in zip(pair["first"], pair["n"])])
        forest, links = Forest(len(places)), np.zeros(len(places), np.int64)
        for a, b, _ in tile_links(tiles[0], tiles[1] if len(tiles) > 1 else None, threshold):
            if len(a):
                np.add.at(links, a, counts[b])
                np.add.at(links, b, counts[a])
                forest.link(a, b)
        linked = np.flatnonzero(links)
        roots = forest.roots(linked) if len(linked) else linked
        return pd.DataFrame({"place": places[linked], "links": links[linked], "root": places[roots]})
    return compare


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """``tile, other``: every pair of tiles of one dimension, a tile with itself included,
    whose balls come within the angle of ``threshold``. Each tile leads half of its pairs."""
    per_dim = tiles.groupBy("dim").agg(F.min("tile").alias("low"), F.count(F.lit(1)).alias("m"))
    led = tiles.select("dim", "tile", "centre", "radius").join(F.broadcast(per_dim), "dim")  # a row per dimension
    m, at = F.col("m"), F.col("tile") - F.col("low")
    half = F.when((m % 2 == 0) & (at >= (m / 2).cast("bigint")), m / 2 - 1).otherwise(F.floor(m / 2)).cast("bigint")
    paired = led.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), half))).select(
        "dim", "tile", "centre", "radius", (F.col("low") + (at + F.col("step")) % m).alias("other"))
    balls = tiles.select(F.col("tile").alias("other"), F.col("dim").alias("other_dim"), F.col("centre").alias("other_centre"),
                         F.col("radius").alias("other_radius"))
    cosine = F.aggregate(F.zip_with("centre", "other_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = F.col("radius") + F.col("other_radius") + math.acos(max(-1.0, threshold)) + 1e-6  # acos loses digits near 1
    met = paired.join(balls, (F.col("tile") < F.lit(1 << 62)) & (paired["other"] == balls["other"]) & (F.col("dim") == F.col("other_dim")))
    return met.where(angle <= reach).select("tile", paired["other"].alias("other"))


def _chained(units: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest of the rest."""
    cosine, order, left = units @ units.T, [0], list(range(1, len(units)))
    while left:
        order.append(left.pop(int(cosine[order[-1], left].argmax())))
    return units[order]


def _ordered(vectors: DataFrame, pivots: int) -> DataFrame:
    """Number the vectors so that those near the same pivot follow one another, and so
    do pivots that are near each other."""
    given = vectors.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()
    by_dim: dict[int, list] = {}
    for row in given:
        by_dim.setdefault(row.dim, []).append(row.vector)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {dim: _chained(unit_vectors(np.array(v))) for dim, v in by_dim.items()}
        for batch in batches:
            lists = batch.column("vector")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            cell, near = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                if int(dim) in known:
                    rows = np.flatnonzero(dims == dim)
                    cosine = unit_vectors(flat[offsets[rows][:, None] + np.arange(dim)]) @ known[int(dim)].T
                    cell[rows], near[rows] = cosine.argmax(axis=1), -cosine.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return numbered(vectors.mapInArrow(place, f"{schema}, cell int, near double"), [F.col(c) for c in ("dim", "cell", "near", "vector")])


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    tile_rows: int = TILE_ROWS, pivots: int = PIVOTS,
) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row of ``vectors``.

    Rows are linked if the cosine of their vectors is ``threshold`` (over 0) or more.
    ``n_links`` counts the rows linked directly, copies one by one; ``component_id`` is the
    smallest id reachable over links and ``kept`` says that it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing,
    and vectors of different dimension do not link. A null id is never a component's; in a
    component of such rows only ``component_id`` is null and all rows are kept. Rows that
    share an id are linked by their vectors like any others. No rows give no rows. Other
    columns are not read, whatever their names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    width = 4 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else 8
    vector = F.col(vector_col).cast("array<float>" if width == 4 else "array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vector.alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    fit = rows.where(usable)
    distinct = fit.groupBy("vector").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("vector"))
    placed = _ordered(settle(distinct, "vectors"), pivots)
    placed = settle(placed.withColumn("tile", F.floor(F.col("place") / tile_rows)), "placed")

    # A tile that two dimensions share is two; tiles are numbered anew without gaps.
    packed = settle(placed.select("dim", "tile", "place", "vector", "n").groupBy("dim", "tile").applyInArrow(
        _pack(width), "n int, first long, counts binary, vectors binary, centre array<double>, radius double, dim int, tile long"), "packed")
    tiles = numbered(packed.drop("tile"), [F.col("dim"), F.col("first")], "tile")
    pairs = settle(tile_pairs(tiles, threshold), "tile-pairs")
    body = tiles.select("tile", "n", "first", "counts", "vectors")
    sides = pairs.join(body, "tile").unionByName(
        pairs.where("tile <> other").withColumnRenamed("tile", "lead").withColumnRenamed("other", "tile").join(body, "tile")
        .select("tile", F.col("lead").alias("other"), "n", "first", "counts", "vectors"))
    key = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    found = settle(sides.select("n", "first", "counts", "vectors", *key).groupBy("low", "high").applyInPandas(
        _compare(width, threshold), "place long, links long, root long"), "tile-links")

    links = found.groupBy("place").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("place").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "place")
    joined = placed.select("place", "vector", "first_id", "n").join(links, "place", "left").join(roots, "place", "left").withColumn(
        "root", F.coalesce("root", "place"))
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = joined.join(lowest, "root").select(
        "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = fit.join(known, "vector").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def sql() -> str:
    """The same rows for the production parameters, in another engine's SQL: all pairs."""
    return f"""
        with recursive fit as (
            select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
            where list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
                and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        links as materialized (
            select a.vec_id as a, b.vec_id as b from fit a join fit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            where list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
        reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
        lowest as (select a as vec_id, min(b) as component_id from reach group by a),
        counted as (select a as vec_id, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
        from lowest left join counted using (vec_id)"""
