"""Operator 12: centroid clustering by Lloyd's rounds with Elkan's bounds, in exact integers.

Each vector carries an upper bound of the distance to its own centroid and a lower bound of that to each centroid. A distance
is computed only where the bounds, and the distances between centroids, leave it open. Bounds are whole numbers, rounded away
from the true distance, and a centroid is ruled out only if it is surely farther; so equal distances are always computed, as
exact squares, and the smaller number wins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, scope, written


def above(square: np.ndarray) -> np.ndarray:
    """Whole numbers no less than the root of a square."""
    return np.where(square > 0, np.floor(np.sqrt(square)).astype(np.int64) + 1, 0)


def below(square: np.ndarray) -> np.ndarray:
    """Whole numbers no greater than the root of a square."""
    return np.maximum(np.ceil(np.sqrt(square)).astype(np.int64) - 1, 0)


def squares(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = x - to
    return np.einsum("ij,ij->i", gap, gap)


def settle(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, shift: np.ndarray) -> int:
    """One assignment of all rows of x, in place: `own`, `upper` and `lower` hold what the last one left, for centroids that
    have moved by at most `shift` since. Returns how many distances were computed."""
    k = len(centroids)
    apart = np.stack([squares(centroids, c) for c in centroids])
    apart[np.diag_indices(k)] = np.iinfo(np.int64).max
    upper += shift[own]
    np.maximum(lower - shift, 0, out=lower)
    live = np.flatnonzero(4 * upper * upper >= apart.min(axis=1)[own])
    exact = np.full(len(x), -1, np.int64)
    work = 0

    def open_to(rows: np.ndarray, c: int) -> np.ndarray:
        u = upper[rows]
        return rows[(own[rows] != c) & (u >= lower[rows, c]) & (4 * u * u >= apart[own[rows], c])]

    for c in range(k):
        rows = open_to(live, c)
        loose = rows[exact[rows] < 0]
        if len(loose):
            exact[loose] = squares(x[loose], centroids[own[loose]])
            upper[loose], lower[loose, own[loose]] = above(exact[loose]), below(exact[loose])
            rows = open_to(rows, c)
        found = squares(x[rows], centroids[c])
        work += len(loose) + len(rows)
        lower[rows, c] = below(found)
        better = (found < exact[rows]) | ((found == exact[rows]) & (c < own[rows]))
        rows, found = rows[better], found[better]
        own[rows], exact[rows], upper[rows] = c, found, above(found)
    return work


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _lists(values: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32).ravel()))


def _assign(centroids: list[list[int]], shift: list[int], last: bool):
    """Rows (id, x[, own, upper, lower]) to the same after one assignment, or to (id, cluster, distance)."""
    at, moved = np.array(centroids, np.int64), np.array(shift, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), n)
            if "own" in batch.schema.names:
                was = batch.column("own").to_numpy().astype(np.int64)
                own, upper, lower = was.copy(), batch.column("upper").to_numpy().astype(np.int64), _matrix(batch.column("lower"), n)
                settle(x, own, upper, lower, at, moved)
            else:
                was, own = np.full(n, -1), np.zeros(n, np.int64)
                upper, lower = above(squares(x, at[0])), np.zeros((n, len(at)), np.int64)
                settle(x, own, upper, lower, at, np.zeros_like(moved))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32)), pa.array(squares(x, at[own]))], names=["id", "cluster", "distance"])
            else:
                numbers = [pa.array(v.astype(np.int32)) for v in (was, own, upper)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), *numbers, _lists(lower)], names=["id", "x", "was", "own", "upper", "lower"])

    return run


def whole(vec: Column, scale: int, dim: int) -> Column:
    """The vector's components as floor(scale * c); an error for one so great that a squared distance would not fit a long."""
    limit = math.isqrt((1 << 60) // dim) // 2
    scaled = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    return F.transform(vec, lambda c: F.when(F.abs(c.cast("double")) < limit / scale, scaled(c).cast("int")).otherwise(F.raise_error(F.lit("a component is too great for exact distances")).cast("int")))


def finite(vec: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~odd, F.lit(False))


def elkan_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly `dim` finite components.

    Components become floor(scale * c). The first centroids are the k vectors with the smallest sha256 of `seed:id`; rows that
    repeat an id go by their components there. Each round assigns all vectors, then moves each centroid with vectors to the
    floor of their mean; rounds end early only when no centroid moved, as nothing would change from there on. Equal
    distances go to the smaller number. Null, short, long and non-finite vectors give no row; a vector with a null id is
    clustered, but starts no centroid; fewer than k vectors with ids start as many centroids, and none gives no rows.
    Components beyond 2**26 (at 64 dimensions) raise an error, as squares would not fit a long.

    A round reads and writes one table of vectors and bounds, and the one before it is deleted. A centroid's sums follow
    the vectors that changed hands, so later rounds sum few of them. The driver sees k rows of sums a round.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    kept = kept.filter(finite(F.col("v")) & (F.size("v") == dim)).select("id", whole(F.col("v"), scale, dim).alias("x"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.filter("id IS NOT NULL").orderBy(name, "x").limit(k).select("x").collect()
    fields = "id long, x array<int>, was int, own int, upper int, lower array<int>"
    result = "id long, cluster int, distance long"
    if not first:
        clusters, centroids = spark.createDataFrame([], result), []
    else:
        centroids, shift, state = [[*r["x"]] for r in first], [0] * len(first), kept
        sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
        with scope(spark) as keep:
            for _ in range(rounds):
                last, state = state, written(state.mapInArrow(_assign(centroids, shift, False), fields), "centroid-bounds")
                if last is not kept:
                    discard(last)
                sides = F.explode(F.array(F.struct(F.col("own").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s"))))
                moved = state.filter("own <> was").select("x", sides.alias("side")).filter("side.c >= 0").select("side.c", F.col("side.s").cast("long").alias("s"), "x")
                totals = [F.sum(F.col("s") * F.col("x")[i]).alias(f"x{i}") for i in range(dim)]
                for c, n, *more in moved.groupBy("c").agg(F.sum("s"), *totals).collect():
                    counts[c] += n
                    sums[c] = [a + b for a, b in zip(sums[c], more)]
                before, centroids = centroids, [[s // n for s in sums[c]] if (n := counts[c]) else centroids[c] for c in range(len(centroids))]
                shift = [int(above(np.array([sum((a - b) ** 2 for a, b in zip(p, q))]))[0]) for p, q in zip(before, centroids)]
                if not any(shift):
                    break
            clusters = keep(written(state.mapInArrow(_assign(centroids, shift, True), result), "clusters"))
    ends = clusters.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # k rows
    inertia = {r["cluster"]: r["d"] for r in ends}
    facts = [(c, inertia.get(c), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
