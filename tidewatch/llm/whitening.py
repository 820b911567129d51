"""Operator 13: whitening by a compensated covariance.

Vectors are centred by their exact sums. Outer products are accumulated in double-double: a block of rows is cut into slices
of so few bits that the products of slices, summed over the block, are exact in doubles (the error-free transformation of a
matrix product of Ozaki et al. 2012), and each is added to a pair of high and low parts by an error-free sum (Knuth). Tasks
give their pairs, which are merged the same way. The covariance is small, so its eigenvectors come from LAPACK on the driver:
reduction to tridiagonal form, then divide and conquer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.centroids import finite

BLOCK = 1024
BITS = 21  # 2 * 21 bits and the sum of 1,024 products fit the 53 bits of a double
FIELDS = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
FLAT = 1e-11  # components with less than this share of the greatest eigenvalue are rounding


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding took from it, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more_high: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(high, more_high)
    t, f = two_sum(low, more_low + np.zeros_like(high))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def cut(block: np.ndarray) -> list[np.ndarray]:
    """Slices whose sum is the block exactly, each of at most BITS bits on a grid of its own."""
    parts, rest = [], block
    while (top := np.abs(rest).max(initial=0.0)) > 0:
        grid = np.ldexp(1.0, max(int(np.frexp(top)[1]) - BITS, -1060))
        part = np.rint(rest / grid) * grid
        if not part.any():
            break
        parts.append(part)
        rest = rest - part  # exact: both lie on one grid, within a factor of two
    return parts


class Outer:
    """Sum of the outer products of rows, with a last component of 1, in double-double."""

    def __init__(self, dim: int):
        self.high, self.low = np.zeros((dim + 1, dim + 1)), np.zeros((dim + 1, dim + 1))

    def add(self, rows: np.ndarray) -> None:
        for at in range(0, len(rows), BLOCK):
            block = rows[at : at + BLOCK]
            parts = cut(np.column_stack((block, np.ones(len(block)))))
            for i, p in enumerate(parts):
                for q in parts[i:]:
                    exact = p.T @ q
                    self.high, self.low = add(self.high, self.low, exact)
                    if q is not p:
                        self.high, self.low = add(self.high, self.low, exact.T)


def _values(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


@dataclass
class Whitener:
    """n vectors with sums `sums`; unit eigenvectors are the columns of `axes`, by falling eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    mean: np.ndarray
    identity_error: float = 0.0

    def parts(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        return self.n * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.parts(x) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        gap = self.parts(x)
        if np.abs(gap).max(initial=0) < 2**31 / gap.shape[1] ** 0.5:
            return (gap * gap).sum(axis=1).tolist()
        return (gap.astype(object) ** 2).sum(axis=1).tolist()


def _outer(rows: DataFrame, dim: int, of) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of outer products of `of(x)`, merged over tasks: two levels, and dim + 1 rows reach the driver."""
    fields = "i int, lane int, high array<double>, low array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        outer = Outer(dim)
        for batch in batches:
            if batch.num_rows:
                outer.add(of(_values(batch.column(0), batch.num_rows)))
        lane = TaskContext.get().partitionId() % 64
        table = pa.table({"i": pa.array(range(dim + 1), pa.int32()), "lane": pa.array([lane] * (dim + 1), pa.int32()), "high": pa.array([*outer.high]), "low": pa.array([*outer.low])})
        yield from table.to_batches()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low = np.zeros(dim + 1), np.zeros(dim + 1)
        for h, w in zip(pdf["high"], pdf["low"]):
            high, low = add(high, low, h, w)
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "lane": pdf["lane"].iloc[:1], "high": [high], "low": [low]})

    found = rows.select("x").mapInArrow(run, fields).groupBy("i", "lane").applyInPandas(merge, fields).groupBy("i").applyInPandas(merge, fields).orderBy("i").collect()
    return np.array([r["high"] for r in found]), np.array([r["low"] for r in found])


def _covariance(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and mean of rows that are centred but for rounding; what their mean has left is taken off."""
    sums = (high.astype(np.longdouble) + low) / n
    mean = sums[-1, :-1]
    return (sums[:-1, :-1] - np.outer(mean, mean)).astype(float), mean.astype(float)


def scaled(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None, scale: int, shift: int) -> tuple[DataFrame, int]:
    """(id, x) of the finite vectors of the commonest length, or of `dim`; x is floor(scale * c) + shift. And that length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0))
    if dim is None:
        sizes = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).limit(1).collect()
        dim = sizes[0]["s"] if sizes else 0
    fits = lambda c: F.abs(c.cast("double")) < 2**46 / scale
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift).cast("long")
    x = F.transform("v", lambda c: F.when(fits(c), whole(c)).otherwise(F.raise_error(F.lit("a component is too great for exact sums")).cast("long")))
    return rows.filter(F.size("v") == dim).select("id", x.alias("x")), dim


def fit(rows: DataFrame, dim: int, most: int = 32) -> Whitener | None:
    """A whitener of up to `most` components from all rows (id, x); None if there are none, or all are alike."""
    count, *sums = rows.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(dim)]).first()  # one row of exact sums
    if not count:
        return None
    white = Whitener(count, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, np.zeros(dim))
    cov, white.mean = _covariance(*_outer(rows, dim, white.centred), count)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > FLAT * max(values.max(), 0.0)]
    white.trace, white.values, white.axes = float(np.trace(cov)), values[order], axes[:, order]
    if not len(order):
        return None
    again, _ = _covariance(*_outer(rows, len(order), white.whitened), count)
    white.identity_error = float(np.abs(again - np.eye(len(order))).max())
    return white


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32, dim: int | None = None, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each finite vector and component, up to `most`.

    Components are unit eigenvectors of the covariance of x = floor(scale * c) + shift over all those vectors, numbered from 1
    by falling eigenvalue; one whose eigenvalue is under 1e-11 of the greatest, all rounding, is left out, so copies of
    a single vector give no rows. `deviation`, decimal(38,0), is the exact sum of (n * x - S)**2 over the dimensions. Null, empty and non-finite vectors give no
    rows; neither do vectors of another length than `dim`, by default the commonest (of equals the greatest), as they share no space
    with the rest. Rows that repeat an id, or have none, are rows of their own. An empty table stays empty. A component beyond
    2**46 after scaling raises an error.
    """
    rows, dim = scaled(vectors, id_col, vec_col, dim, scale, shift)
    white = fit(rows, dim, most) if dim else None
    schema = rows.select("id").withColumns({name: F.lit(None).cast(kind) for name, kind in FIELDS.items()}).schema
    if white is None:
        return vectors.sparkSession.createDataFrame([], schema)
    m = len(white.values)
    share = white.values / white.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, k = _values(part.column(1), part.num_rows), part.num_rows
                each = pa.array(np.repeat(np.arange(k), m))
                off = pa.array([Decimal(d) for d in white.deviation(x)], pa.decimal128(38, 0))
                columns = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, white.n)), off.take(each),
                    pa.array(white.whitened(x).ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * m, white.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
