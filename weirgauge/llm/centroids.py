"""Clustering around centroids in whole numbers, with the equal-average equal-variance
search.

For vectors of ``d`` components with sums ``S`` and deviations ``V`` (the length of a
vector less its mean), a squared distance is at least ``(S1 - S2)**2 / d + (V1 - V2)**2``.
Centroids are sorted by their sums, which is the order of their means. From a vector's
own mean the search goes outward to the next centroid on either side; it ends where the
means alone are too far apart, passes over centroids whose deviation differs too much, and
computes the distance of the rest in whole numbers. Bounds are rounded down, so the result
is that of comparing with all centroids.

A round is one pass over the vectors; a task returns a partial sum per centroid. Only the
centroids, whose number is a parameter, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.storage import settle

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
MOST = 1 << 27  # of a component in whole numbers: distances stay within 64 bits
_ROWS = 8_192
_SLACK = 1e-12


def whole_points(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """``id, point`` (ints) of the vectors that have ``components`` components, none null
    or non-finite."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is larger
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double")) * float(scale) < float(MOST))
    return vectors.where((F.size(vector) == components) & finite).select(
        F.col(id_col).alias("id"),
        F.when(fits, scaled.cast("array<int>")).otherwise(
            F.raise_error(F.lit(f"a vector component times {scale} exceeds {MOST}"))).alias("point"))


def first_centroids(points: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The points with the smallest hashes of ``<seed>:<id>``."""
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.point) for r in points.select(hash_.alias("h"), "point").orderBy("h", "point").limit(clusters).collect()]


class CentroidSearch:
    """Nearest centroids of whole vectors; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        given = np.array(centroids, np.int64)
        sums = given.sum(axis=1)
        self.order = np.lexsort((np.arange(len(given)), sums))
        self.points, self.sums = given[self.order], sums[self.order]
        self.deviations, self.lengths = _deviations(self.points)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and how many
        distances were computed."""
        n, k, d = len(points), len(self.points), points.shape[1]
        sums = points.sum(axis=1)
        deviations, lengths = _deviations(points)
        left = np.searchsorted(self.sums, sums) - 1
        right = left + 1
        best, owner, computed = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64), 0
        active = np.arange(n)
        while len(active):
            # The next centroid outward: the nearer one by the mean, of those left.
            lo, hi = left[active], right[active]
            low_gap = np.where(lo >= 0, sums[active] - self.sums[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            high_gap = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[active], np.iinfo(np.int64).max)
            down = low_gap <= high_gap
            gap = np.where(down, low_gap, high_gap).astype(np.float64)
            by_mean = gap * gap / d * (1 - _SLACK)
            # Strictly farther: an equal distance may still have a smaller number.
            going = ((lo >= 0) | (hi < k)) & (by_mean <= best[active])
            active, down, by_mean = active[going], down[going], by_mean[going]
            at = np.where(down, left[active], right[active])
            left[active[down]] -= 1
            right[active[~down]] += 1
            apart = np.abs(deviations[active] - self.deviations[at])
            apart = np.maximum(apart - _SLACK * (lengths[active] + self.lengths[at]), 0)
            close = by_mean + apart * apart * (1 - _SLACK) <= best[active]
            rows, at = active[close], at[close]
            computed += len(rows)
            apart = points[rows] - self.points[at]
            distance, number = np.einsum("ij,ij->i", apart, apart), self.order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < owner[rows]))
            best[rows[better]], owner[rows[better]] = distance[better], number[better]
        return owner, best, computed


def _deviations(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = points.astype(np.float64)
    return np.linalg.norm(wide - wide.mean(axis=1, keepdims=True), axis=1), np.linalg.norm(wide, axis=1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            yield piece, piece.column("point").flatten().to_numpy().astype(np.int64).reshape(piece.num_rows, -1)


def _partial_sums(centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centroids)
        totals = np.zeros((len(centroids), len(centroids[0])), np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for _, points in _pieces(batches):
            owner, _, _ = search.nearest(points)
            counts += np.bincount(owner, minlength=len(counts))
            for cluster in np.unique(owner):
                totals[cluster] += points[owner == cluster].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(used.astype(np.int32)), "n": pa.array(counts[used]), "sums": pa.array(totals[used].tolist(), pa.list_(pa.int64()))})
    return run


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floored means of their points. Those without
    points stay."""
    parts = points.select("point").mapInArrow(_partial_sums(centroids), "cluster int, n long, sums array<long>")
    width = len(centroids[0])
    sums = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    after = list(centroids)
    for row in sums.collect():  # a row per centroid at most
        after[row.cluster] = [total // row.n for total in row["sums"]]
    return after


def assigned(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``id, cluster, distance`` of every point."""
    id_field = points.schema["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centroids)
        for piece, rows in _pieces(batches):
            owner, best, _ = search.nearest(rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(owner.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])
    return points.mapInArrow(run, f"id {id_field.dataType.simpleString()}, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """``<id>, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid`` per
    vector that has ``components`` components, none null or non-finite; others are left out.

    A component ``x`` counts as ``floor(scale * x)``; one that does not fit into ``MOST``
    ends the job with an error, since its squared distances would overflow. The first
    centroids are the vectors with the smallest hashes of ``<seed>:<id>`` (a null id is
    hashed as an empty one, ties go to the smaller vector); with fewer vectors than
    ``clusters`` there are as many centroids as vectors. Equal vectors may make equal
    centroids, of which the smaller number gets all. Repeated rows count one by one. No
    vectors give no rows. Other columns are not read, whatever their names.
    """
    points = settle(whole_points(vectors, id_col, vector_col, components, scale), "points")
    centroids = first_centroids(points, clusters, seed)
    spark = vectors.sparkSession
    id_type = points.schema["id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame(
            [], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    for _ in range(rounds):
        centroids = moved(points, centroids)
    rows = settle(assigned(points, centroids), "clusters")
    own = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    known = spark.createDataFrame(
        [(c, total, sum(own.values()), digest(centroids[c]), centroids[c]) for c, total in own.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    return rows.join(F.broadcast(known), "cluster").select(  # a row per centroid
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def sql() -> str:
    """The same rows for the production parameters, in another engine's SQL: every
    round compares all vectors with all centroids."""
    def nearest(name: str, centroids: str) -> str:
        return f"""{name} as (
            select vec_id, p, arg_min(c, d * {2 * CLUSTERS} + c) as c, min(d) as d from (
                select k.vec_id, k.p, z.c, list_sum(list_transform(list_zip(k.p, z.p), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint as d
                from kept k, {centroids} z) group by vec_id, p)"""

    steps = [f"""kept as materialized (
            select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as p
            from embeddings where len(embedding) = {COMPONENTS} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        z0 as (
            select (row_number() over (order by sha256('{SEED}:' || vec_id)) - 1)::int as c, p from kept
            order by c limit {CLUSTERS})"""]
    for step in range(ROUNDS):
        steps.append(nearest(f"a{step}", f"z{step}"))
        steps.append(f"""m{step} as (
            select c, list(m order by i) as p from (
                select c, i, (sum(p[i])::bigint - ((sum(p[i])::bigint % count(*)) + count(*)) % count(*)) // count(*) as m
                from a{step}, range(1, {COMPONENTS + 1}) r(i) group by c, i) group by c),
        z{step + 1} as (select z.c, coalesce(m.p, z.p) as p from z{step} z left join m{step} m using (c))""")
    steps.append(nearest("final", f"z{ROUNDS}"))
    return f"""with {', '.join(steps)}
        select f.vec_id, f.c::int as cluster, f.d as distance, (sum(f.d) over (partition by f.c))::bigint as cluster_inertia,
            (sum(f.d) over ())::bigint as inertia, sha256(array_to_string(z.p, ',')) as centroid_sha256
        from final f join z{ROUNDS} z on f.c = z.c"""
