"""Operator 3: k-d tree sharding, in DataFrame functions only.

Rows are points in a space of metadata. A node is split at the weighted median of its widest dimension
until the wanted number of leaves, or leaves of the wanted bytes, is reached. Equal texts are one point
(every dimension is a function of the text, and ties are ordered by its hash), so they share a shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import text_bytes, written

BINS = 1024
ROUNDS = 5


def text_dimensions(text: str = "text") -> dict[str, Column]:
    """Metadata of a text: its size, the share of its bytes beyond ASCII letters' one a character, and its check sum; null is empty."""
    size = text_bytes(text).cast("double")
    chars = F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("double")
    return {"log_size": F.log1p(size), "wide": (size - chars) / F.greatest(size, F.lit(1.0)), "hash": F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))}


def _by_node(values: dict[int, object], node: str = "node") -> Column:
    """The value of a row's node; as many cases as the tree has nodes on a level."""
    return reduce(lambda c, n: F.when(F.col(node) == n, F.lit(values[n])).otherwise(c), values, F.lit(None))


def _reached(counts: DataFrame, want: dict[int, float], keep: list[str]) -> dict[int, object]:
    """{node: the first bin in which the node's running weight reaches what is wanted}."""
    upto = counts.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
    picked = upto.filter(F.col("upto") >= _by_node(want)).groupBy("node").agg(F.min_by(F.struct("bin", "upto", "w", *keep), "bin").alias("p"))
    return {r["node"]: r["p"] for r in picked.collect()}


def _splits(points: DataFrame, dims: list[str]) -> dict[int, tuple[str, float, float, int]]:
    """{node: (dimension, low, high, tie)}: the weighted median of each node, by histograms that narrow down.

    Each round adds up the weights of at most BINS bins for a node, in Spark, and keeps the bin that holds the
    median; only its bounds reach the driver. What ties there is split by the hash that orders ties.
    """
    ends = points.groupBy("node").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum("weight").alias("total")).collect()
    spread = {d: max(r[f"hi_{d}"] for r in ends) - min(r[f"lo_{d}"] for r in ends) for d in dims} if ends else {}
    dim, lo, hi, below, half = {}, {}, {}, {}, {}
    for r in ends:
        n = r["node"]
        dim[n] = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / (spread[d] or 1.0), -dims.index(d)))  # noqa: B023
        lo[n], hi[n], below[n], half[n] = float(r[f"lo_{dim[n]}"]), float(r[f"hi_{dim[n]}"]), 0, r["total"] / 2
    if not dim:
        return {}
    value = reduce(lambda c, d: F.when(_by_node(dim) == d, F.col(d)).otherwise(c), dims, F.lit(None).cast("double"))
    points = written(points.withColumn("x", value), "split-points")
    for _ in range(ROUNDS):
        inside = points.withColumns({"lo": _by_node(lo), "hi": _by_node(hi)}).filter("x BETWEEN lo AND hi")
        place = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
        place = F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
        counts = inside.groupBy("node", place.alias("bin")).agg(F.sum("weight").alias("w"), F.min("x").alias("a"), F.max("x").alias("b"))
        for n, p in _reached(counts, {n: half[n] - below[n] for n in dim}, ["a", "b"]).items():
            below[n] += p["upto"] - p["w"]
            lo[n], hi[n] = p["a"], p["b"]
        if lo == hi:
            break
    tied = points.filter(F.col("x").between(_by_node(lo), _by_node(hi))).select("node", "tie", "weight")
    first, last = dict.fromkeys(dim, -(1 << 63)), dict.fromkeys(dim, (1 << 63) - 1)
    weight = {}
    for shift in (54, 44, 34, 24, 14, 4, 0):
        inside = tied.filter(F.col("tie").between(_by_node(first), _by_node(last)))
        counts = inside.groupBy("node", F.shiftright("tie", shift).alias("bin")).agg(F.sum("weight").alias("w"), F.min("tie").alias("a"), F.max("tie").alias("b"))
        for n, p in _reached(counts, {n: half[n] - below[n] for n in dim}, ["a", "b"]).items():
            below[n] += p["upto"] - p["w"]
            first[n], last[n], weight[n] = p["a"], p["b"], p["w"]
        if first == last:
            break
    # The median's own point goes to the side that leaves the halves nearer.
    return {n: (dim[n], lo[n], hi[n], first[n] if weight[n] <= 2 * (half[n] - below[n]) else first[n] - 1) for n in dim}


def kd_shards(df: DataFrame, dims: dict[str, Column], weight: Column, tie: Column, shards: int = 8) -> DataFrame:
    """df with column `shard` (0 to shards - 1): the leaf of each row in a k-d tree of even weights.

    `dims` and `tie` must be equal for rows that have to stay together. `shards` is a power of two.
    Null dimensions count as 0. An empty table stays empty; repeated rows share a shard; a column `shard` gives way.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    names = [f"__d{i}" for i in range(len(dims))]
    rows = df.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, dims.values())], weight.cast("long").alias("__weight"), tie.cast("long").alias("__tie"), F.lit(0).alias("__node"))
    # One point for all rows that must stay together, with their weight: copies are counted before anything moves.
    points = written(rows.groupBy(*names, "__tie").agg(F.sum("__weight").alias("weight")), "points").withColumnRenamed("__tie", "tie").withColumn("node", F.lit(0))

    def right(found: dict, node: str, tie: str) -> Column:
        """1 for the rows of a node beyond its split, else 0."""
        beyond = {n: (F.col(d) > hi) | ((F.col(d) >= lo) & (F.col(tie) > t)) for n, (d, lo, hi, t) in found.items()}
        return reduce(lambda c, n: F.when(F.col(node) == n, beyond[n].cast("int")).otherwise(c), found, F.lit(0))

    for _ in range(shards.bit_length() - 1):
        found = _splits(points, names)
        points = points.withColumn("node", F.col("node") * 2 + right(found, "node", "tie"))
        rows = rows.withColumn("__node", F.col("__node") * 2 + right(found, "__node", "__tie"))
    return rows.withColumn("shard", F.col("__node").cast("int")).drop(*names, "__weight", "__tie", "__node")


def shards_for(df: DataFrame, weight: Column, target_bytes: int) -> int:
    """The least power of two of shards whose leaves are expected to be within the target bytes."""
    total = df.agg(F.sum(weight).alias("n")).first()["n"] or 0
    n = 1
    while total > n * target_bytes:
        n *= 2
    return n


def with_slots(df: DataFrame, id_col: str, bucket_rows: int = 20_000) -> DataFrame:
    """df, which has columns shard and text_crc32, with column `slot` in place of one it has: a gapless number from 0 within each shard.

    Rows of a shard are dealt to buckets by hash; a bucket starts where those before it end, so no task
    numbers a whole shard.
    """
    rows = df.count()
    buckets = max(64, -(-rows // bucket_rows))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(buckets)))
    sizes = df.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(id_col, "text_crc32"))
    return df.withColumn("__own", own).join(starts, ["shard", "__bucket"]).withColumn("slot", (F.col("__start") + F.col("__own") - 1).cast("long")).drop("__bucket", "__own", "__start")
