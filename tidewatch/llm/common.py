"""What several operators share: the shared folder, word hashing and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own in local tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        sc.setCheckpointDir(folder)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


class Scope:
    """The paths of the tables that are written while it is open, in one thread of the driver."""

    def __init__(self):
        self.paths: set[str] = set()


_SCOPE: contextvars.ContextVar[Scope] = contextvars.ContextVar("tidewatch-written", default=Scope())
_PATH_OF: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor costs only a reread.

    Tables stay until `discard`, or the end of the `scope` they were written in, since what an operator returns may still
    read them. Those written in no scope stay until `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCOPE.get().paths.add(path)  # before the write, so that a write that fails leaves nothing behind either
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _SCOPE.get().paths.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, _PATH_OF.pop(table))


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all tables that were written inside it, and no others.

    What it gives is a function that marks a written table to stay; such a table passes to the scope around this one.
    Scopes nest, and those of other threads have nothing to do with this one.
    """
    mine, around, stay = Scope(), _SCOPE.get(), set()
    token = _SCOPE.set(mine)

    def keep(table: DataFrame) -> DataFrame:
        stay.add(_PATH_OF[table])
        return table

    try:
        yield keep
    finally:
        for path in [p for p in mine.paths if p not in stay]:
            _delete(spark, path)
        _SCOPE.reset(token)
        around.paths |= mine.paths


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Deletes the tables written so far in the scope that is open but `keep`: for the end of a job, when its results are stored."""
    stay = {_PATH_OF[t] for t in keep if t in _PATH_OF}
    for path in [p for p in _SCOPE.get().paths if p not in stay]:
        _delete(spark, path)


#: What the rows of a side that is broadcast may take, as measured; a few times of it in memory.
BROADCAST_BYTES = 8 << 20


def measured(table: DataFrame, row_bytes: Column, total: int | None = None) -> DataFrame:
    """A written table as a side of a join: broadcast where its rows take BROADCAST_BYTES at most, else merged.

    Left to itself Spark goes by the size of the files, and compressed arrays are many times larger as rows. `row_bytes` is
    what a row takes; their sum is read from the table where `total` doesn't give it. An empty table is broadcast.
    """
    if total is None:
        total = table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table.hint("merge")


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


# ---------------------------------------------------------------- word hashing

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


def ascii_space() -> np.ndarray:
    """True for the bytes 0x20 and 0x09 to 0x0D."""
    lut = np.zeros(256, bool)
    lut[[0x20, *range(0x09, 0x0E)]] = True
    return lut


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once, from prefix sums over their bytes.

    A word's hash is sum(T[byte] * B**i) mod 2**64 over its own bytes, then mixed; with prefix sums
    it costs a few array passes and no Python object for a word.
    """

    def __init__(self, separators: np.ndarray, fold: np.ndarray | None = None):
        self.separators, self.fold = separators, fold
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))
        self.pow = self.inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            size = max(n, 1 << 20)
            for name, base in (("pow", _B), ("inv", _B_INV)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(hashes, starts, ends, text index of each word, joined bytes); offsets point into the joined bytes."""
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        lut, fold = self.separators, self.fold
        sep = lut[raw].view(np.int8)
        edge = np.diff(sep, prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._grow(len(raw))
        values = self.table[raw if fold is None else fold[raw]]
        values *= self.pow[: len(raw)]
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
        return hashes, starts, ends, owner, joined


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, order-sensitive; one shorter than k words gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_B)
        out += hashes[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def slices(sizes: list[int], most: int):
    """(from, to) ranges of consecutive items of about `most` in sum; an item above it stands alone."""
    begin = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield begin, len(sizes)


# ---------------------------------------------------------------- components


class Spanner:
    """Components of n things in one task, by arrays: which of many links join what earlier ones have apart."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Indices of links (i, j) that span all of them; every larger label hooks on to a smaller one, so no circle arises."""
        picked, rest = [], np.arange(len(i))
        while True:
            a, b = self.label[i[rest]], self.label[j[rest]]
            rest = rest[a != b]
            if not len(rest):
                return np.concatenate(picked) if picked else rest
            a, b = self.label[i[rest]], self.label[j[rest]]
            high, at = np.unique(np.maximum(a, b), return_index=True)
            picked.append(rest[at])
            parent = np.arange(len(self.label))
            parent[high] = np.minimum(a, b)[at]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]


class Forest:
    """Union-find over the few hashable ids that one task has linked."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while x != root:
            p[x], x = root, p.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id reachable.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until the edges are a set of
    stars. Each step is an aggregate with map-side combine and a join. The aggregates are written before they are
    joined, so that AQE can split a vertex with many edges (no aggregate stands between exchange and join); the driver
    sees two numbers a round. Null ends, loops and repeated edges don't count.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(small.unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct(), "edges")
        discard(last, least, large, low)
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
