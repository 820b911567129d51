"""Operator 2: near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks. cos >= t means a squared
distance of at most 2 - 2t, so in at least one block it is at most that block's share (in proportion to its
dimensions). Each block is a range join: a vector lives in one cell of a grid over the block's first
coordinates and visits each cell within reach. Candidates are verified exactly, in double precision.

Where the grid rules out too little (vectors spread evenly over many dimensions), one block and one cell take its place:
all pairs, tile by tile, each pair met once. That sends a vector once a tile instead of once a cell that it visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Spanner, connected_components, written

SLACK = 1e-9
ROUNDED = 3e-5  # more than a squared distance of unit vectors can be off in single precision
BROADCAST_ROWS = 100_000
PLAN_ROWS, PLAN_SHARE = 4096, 0.1  # the grid is taken if it would look at under this share of all pairs of so many vectors; links don't depend on it
SPREAD_VALUES, SPREAD_TILES = 1 << 17, 6  # a cell of more components than this is shared by up to so many tiles even where one could hold it


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def components(values) -> np.ndarray:
    """Vectors as rows of doubles, each times a power of two that brings its greatest component near 1: cosines stay as they
    are, and neither squares of great nor of tiny components leave the range of doubles."""
    raw = np.stack(values.to_numpy()).astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def _bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = [dim * i // blocks for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _visits(threshold: float, blocks: int, axes: int, with_vector: bool):
    """Rows (cell, home, k, n[, v]) of each vector: the block and cell it lives in, and those it visits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            for size, part in pdf.groupby(pdf["v"].map(len)):
                raw = components(part["v"])
                turned = (raw / np.linalg.norm(raw, axis=1)[:, None]) @ rotation(int(size))
                for b, (lo, hi) in enumerate(_bounds(int(size), blocks)):
                    reach = np.sqrt((2 - 2 * threshold) * (hi - lo) / size) + SLACK
                    width = max(2 * reach, 1e-3)
                    place = turned[:, lo : lo + min(axes, hi - lo)] / width
                    home = np.floor(place).astype(np.int64)
                    frac = place - home
                    # the nearer neighbour on each axis, where it is within reach
                    side = np.where(frac < 0.5, -1, 1)
                    gap = np.minimum(frac, 1 - frac) * width
                    for mask in range(1 << home.shape[1]):
                        move = np.array([mask >> j & 1 for j in range(home.shape[1])])
                        near = (gap**2 * move).sum(axis=1) <= reach**2
                        if not near.any():
                            continue
                        cell = (home + side * move)[near]
                        out = {"cell": [f"{size}:{b}:" + ",".join(map(str, c)) for c in cell.tolist()], "home": mask == 0, "k": part["k"].to_numpy()[near], "n": part["n"].to_numpy()[near]}
                        yield pd.DataFrame(out | ({"v": list(part["v"].to_numpy()[near])} if with_vector else {}))

    return run


def _verify(threshold: float, blocks: int, tile: int = 1024, chunk: int = 1 << 16):
    """Of one tile group (residents i by visitors j of a cell): links counted once, and links that span them.

    A pair counts where its smaller key lives, in the first block within budget, so it counts once in all. Single precision
    rules out what is surely beyond the block's budget; double precision decides the rest.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        b = int(pdf["cell"].iloc[0].split(":")[1])
        raw = components(pdf["v"])
        keys, n = pdf["k"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
        size = raw.shape[1]
        norm = np.linalg.norm(raw, axis=1)
        turned = (raw / norm[:, None]) @ rotation(size)
        cuts = _bounds(size, blocks)
        budget = [(2 - 2 * threshold) * (hi - lo) / size + SLACK for lo, hi in cuts]
        rows, cols = np.flatnonzero(pdf["resident"].to_numpy()), np.flatnonzero(pdf["visitor"].to_numpy())
        count, edges = np.zeros(len(keys), np.int64), []
        _, place = np.unique(keys, return_inverse=True)
        spanner = Spanner(int(place.max()) + 1)
        lo, hi = cuts[b]
        part = turned[:, lo:hi].astype(np.float32)
        half = (part**2).sum(axis=1, keepdims=True) / 2
        one = np.ones_like(half)
        left, right = np.hstack((part[rows], -half[rows], one[rows])), np.hstack((part[cols], one[cols], -half[cols]))
        least = np.float32(-(budget[b] + ROUNDED) / 2)

        def settle(i: np.ndarray, j: np.ndarray) -> None:
            fit = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
            fit &= ((turned[i, lo:hi] - turned[j, lo:hi]) ** 2).sum(axis=1) <= budget[b]
            i, j = i[fit], j[fit]
            for first, past in cuts[:b]:
                later = ((turned[i, first:past] - turned[j, first:past]) ** 2).sum(axis=1) > (2 - 2 * threshold) * (past - first) / size + SLACK
                i, j = i[later], j[later]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            new = spanner.add(place[i], place[j])
            edges.append(np.column_stack((keys[i[new]], keys[j[new]])))

        for at in range(0, len(rows), tile):
            r = rows[at : at + tile]
            # only visitors with a greater key count, and they come sorted
            for to in range(int(np.searchsorted(keys[cols], keys[r[0]], side="right")), len(cols), tile):
                i, j = np.nonzero(left[at : at + tile] @ right[to : to + tile].T >= least)
                i, j = r[i], cols[to : to + tile][j]
                fit = keys[i] < keys[j]
                i, j = i[fit], j[fit]
                for x in range(0, len(i), chunk):
                    settle(i[x : x + chunk], j[x : x + chunk])
        has = count > 0
        pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        found = pd.DataFrame({"k": keys[has], "links": count[has], "other": pd.array([pd.NA] * int(has.sum()), "Int64")})
        more = pd.DataFrame({"k": pairs[:, 0], "links": 0, "other": pd.array(pairs[:, 1], "Int64")})
        return pd.concat([found, more]).astype({"k": "int64", "links": "int64"})

    return run


def _grid_prunes(classes: DataFrame, threshold: float, blocks: int, axes: int) -> bool:
    """Whether the grid's cells hold few of all pairs, judged by the vectors with the least keys (hashes)."""
    some = classes.orderBy("k").limit(PLAN_ROWS)
    cells = some.mapInPandas(_visits(threshold, blocks, axes, False), "cell string, home boolean, k long, n long").groupBy("cell").agg(F.count("*").alias("all"), F.count_if("home").alias("home"))
    looks, homes = cells.agg(F.sum((F.col("all") - 1) * F.col("home")), F.sum("home")).first()
    n = (homes or 0) / blocks
    return n > 1 and looks < PLAN_SHARE * n * n


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, blocks: int = 4, axes: int | None = None, cell_values: int = 1 << 21) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept): links are other rows with cosine >= threshold.

    Equal vectors are one class that is compared once; its copies count as links of each other. Rows that repeat an id are
    rows of their own, linked by what their vectors are. Null, empty and zero vectors and those with null or non-finite
    components link with nothing; vectors of different lengths never link. A null id gives a row with no links of its own
    and is none of others. An empty table stays empty. Cells with more than `cell_values` vector components are cut into
    tiles, resident rows against visitors, so no task holds a whole cell; more `axes` make cells smaller at the cost
    of more visits (up to 2**axes for each block), which pays as the table grows; by default they follow its size, and the
    grid gives way to all pairs in tiles where it would look at more than PLAN_SHARE of them. The table of cells is broadcast
    only if it has at most BROADCAST_ROWS rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    odd = "id IS NULL OR v IS NULL OR size(v) = 0 OR exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) OR forall(v, x -> x = 0)"
    rows = rows.withColumn("ok", ~F.coalesce(F.expr(odd), F.lit(True)))
    # k names a class: unlike the least id, no two classes share it (a hash of eight bytes is one to one); evenly spread, so that tiles are ranges of it
    classes = written(rows.filter("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("k", F.xxhash64(F.monotonically_increasing_id())), "vector-classes")
    if axes is None:
        axes = min(6, 2 + max(0, (classes.count() >> 17).bit_length()))
        if not _grid_prunes(classes, threshold, blocks, axes):
            blocks, axes = 1, 0
    fields = "cell string, home boolean, k long, n long"
    kind = vectors.schema[vec_col].dataType.simpleString()
    visits = classes.mapInPandas(_visits(threshold, blocks, axes, True), f"{fields}, v {kind}")
    cells = classes.mapInPandas(_visits(threshold, blocks, axes, False), fields).groupBy("cell").count()
    values = F.col("count") * F.split_part("cell", F.lit(":"), F.lit(1)).cast("long")
    parts = F.greatest(F.ceil(values / F.lit(cell_values)), F.least(F.lit(SPREAD_TILES), F.ceil(values / F.lit(SPREAD_VALUES))))
    tiles = written(cells.select("cell", parts.cast("int").alias("s")), "vector-cells")
    small = tiles.count() <= BROADCAST_ROWS
    rank = F.floor((F.col("k").cast("double") / 2.0**64 + 0.5) * F.col("s")).cast("int")
    dealt = visits.join(F.broadcast(tiles) if small else tiles, "cell").withColumn("mine", F.least(rank, F.col("s") - 1))
    # A pair counts where its smaller key lives, and tiles are in the order of keys: residents of a tile meet visitors of it and of later ones.
    mine, home = F.col("mine"), F.col("home")
    seen = F.transform(F.sequence(F.lit(0), mine), lambda i: F.struct(i.alias("i"), mine.alias("j"), (home & (i == mine)).alias("resident"), F.lit(True).alias("visitor")))
    lives = F.when(home & (mine + 1 < F.col("s")), F.transform(F.sequence(mine + 1, F.greatest(F.col("s") - 1, mine + 1)), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("resident"), F.lit(False).alias("visitor"))))
    sent = dealt.select("cell", "k", "n", "v", F.explode(F.concat(seen, F.coalesce(lives, F.array().cast("array<struct<i:int,j:int,resident:boolean,visitor:boolean>>")))).alias("t")).select("cell", "t.*", "k", "n", "v")
    found = written(sent.groupBy("cell", "i", "j").applyInPandas(_verify(threshold, blocks), "k long, links long, other long"), "vector-links")

    comps = connected_components(found.filter("other IS NOT NULL").select(F.col("k").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    members = classes.join(comps.withColumnRenamed("id", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    firsts = written(members.groupBy("component").agg(F.min("id").alias("first")), "first-ids")  # written, so that AQE can split a large component
    classed = members.join(firsts, "component").join(links, "k", "left").select(F.col("v").alias("cv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "first")
    out = rows.filter("ok").join(classed, F.col("v") == F.col("cv")).select("id", F.col("links").alias("n_links"), F.col("first").alias("component_id"))
    rest = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
