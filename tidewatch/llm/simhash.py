"""Operator 6: near-duplicate texts by SimHash and Golay-code keys.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles. Two fingerprints that differ
in at most four bits are found exactly: the bits form three segments, so two of the segments together
hold at most two of the errors. Each segment, padded to 23 bits, is decoded to the perfect (23, 12)
Golay code, and so is every neighbour of it at one flipped bit, which gives one to six codeword
indices; segments at a distance of two or less always share an index. Rows meet on the index pairs of
two segments and every meeting is verified by a population count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Forest, Spanner, connected_components, written

SEED = 42
RUN_ROWS = 4096
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, k: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; null and wordless texts give 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= k:
        return int.from_bytes(digest(b" ".join(words), SEED), "big")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    raw = b"".join([digest(line[s:e], SEED) for s, e in zip(begins, ends[k - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    votes = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(bits)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp long) of every row: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of k words with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- keys


class Golay:
    """Nearest-codeword indices of the perfect binary (23, 12) code, by syndrome."""

    def __init__(self):
        rem = np.arange(4096, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            rem = np.where(rem >> bit & 1, rem ^ (GENERATOR << (bit - 11)), rem)
        self.rem = rem
        one = [1 << i for i in range(23)]
        patterns = [0, *one, *(a ^ b for i, a in enumerate(one) for b in one[:i])]
        patterns += [a ^ b ^ c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
        patterns = np.array(patterns, np.int64)
        self.error = np.zeros(2048, np.int64)
        self.error[self.syndrome(patterns)] = patterns

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.rem[words >> 11] ^ (words & 0x7FF)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Distinct indices of each word and of its neighbours at one bit, as rows padded with -1."""
        flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = -np.sort(-found, axis=1)
        return found[:, : max(1, int((found >= 0).sum(axis=1).max(initial=1)))]


def pair_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row index, key) of every index pair of two segments; a key also says which two."""
    lists = [golay.keys((fps >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1), n) for at, n in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = lists[i][:, :, None], lists[j][:, None, :]
        row, *_ = at = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        keys.append(((p << 24) | (a << 12) | b)[at])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 2000):
            part = fps[at : at + 2000]
            rows, keys = pair_keys(part, golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows].view(np.int64))], names=["key", "fp"])


def _spanning(keys: np.ndarray, fps: np.ndarray, most: int, forest: Forest) -> list[tuple[int, int]]:
    """Links within runs of equal keys that join what `forest` had apart."""
    out: list[tuple[int, int]] = []
    at = np.arange(len(keys) - 1)
    label = None
    for step in range(1, len(keys)):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= most]
        if step > 8 and len(hit):  # a long run: most of what is left is linked already
            if label is None:
                label = np.array([forest.find(x) for x in fps.tolist()], np.uint64)
            hit = hit[label[hit] != label[hit + step]]
        new = [(a, b) for a, b in zip(fps[hit].tolist(), fps[hit + step].tolist()) if forest.union(a, b)]
        if new:
            out += new
            label = None
    return out


def _links(most: int, run_rows: int):
    """Links (key -1, a, b) of the runs of equal keys, and the rows (key, fp, 0) of the runs with more than `run_rows`."""

    def of(keys, fps, forest):
        if not len(keys):
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.append(starts, len(keys)))
        long = np.repeat(lengths > run_rows, lengths)
        if long.any():
            yield _frame(fps[long], np.zeros(int(long.sum()), np.uint64), keys[long])
        if new := _spanning(keys[~long], fps[~long], most, forest):
            yield _frame(*np.array(new, np.uint64).T)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held, streamed = Forest(), None, None
        for pdf in frames:
            keys, fps = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            if streamed is not None:
                past = int(np.searchsorted(keys, streamed, side="right"))
                if past:
                    yield _frame(fps[:past], np.zeros(past, np.uint64), keys[:past])
                keys, fps = keys[past:], fps[past:]
            if held is not None:
                keys, fps = np.concatenate((held[0], keys)), np.concatenate((held[1], fps))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from of(keys[:last], fps[:last], forest)
            held = keys[last:], fps[last:]
            if len(held[0]) > run_rows:  # streams on, so that no task holds a long run
                streamed = held[0][0]
                yield from of(*held, forest)
                held = None
        if held is not None:
            yield from of(*held, forest)

    return run


def _tile_links(most: int):
    """Links that span the fingerprints of one tile: blocks i and j of a long run."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, block = pdf["fp"].to_numpy().view(np.uint64), pdf["block"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        spanner, links = Spanner(len(fps)), []
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            x, y = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[cols]) <= most)
            x, y = own[x], cols[y]
            new = spanner.add(x, y)
            links.append(np.column_stack((fps[x[new]], fps[y[new]])))
        links = np.concatenate(links) if links else np.zeros((0, 2), np.uint64)
        return _frame(links[:, 0], links[:, 1]).drop(columns="key")

    return run


def _frame(a: np.ndarray, b: np.ndarray, keys: np.ndarray | int = -1) -> pd.DataFrame:
    return pd.DataFrame({"key": np.broadcast_to(np.asarray(keys, np.int32), len(a)), "a": np.ascontiguousarray(a).view(np.int64), "b": np.ascontiguousarray(b).view(np.int64)})


def linked_fingerprints(fps: DataFrame, most: int = 4, run_rows: int = RUN_ROWS) -> DataFrame:
    """(fp, component) of the fingerprints that have links, of a table of distinct ones (fp): component is the least fingerprint reachable.

    Fingerprints link at `most` (up to 4) or fewer differing bits. A key that more than `run_rows` fingerprints share is cut
    into blocks, which meet two by two in tasks of their own.
    """
    if not 0 <= most <= 4:
        raise ValueError("the keys guarantee at most four differing bits")
    keyed = fps.select("fp").mapInArrow(_emit_keys, "key int, fp long")
    met = written(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_links(most, run_rows), "key int, a long, b long"), "key-links")
    edges = met.filter("key < 0").select("a", "b")
    long = met.filter("key >= 0").select("key", F.col("a").alias("fp"))
    blocks = written(long.groupBy("key").agg(F.ceil(F.count("*") / F.lit(run_rows)).cast("int").alias("s")), "long-runs")
    if not blocks.isEmpty():
        dealt = long.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        tiles = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
        edges = edges.unionByName(tiles.groupBy("key", "i", "j").applyInPandas(_tile_links(most), "a long, b long"))
    return connected_components(edges).withColumnRenamed("id", "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, most: int = 4, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per input row: (id, fp, component_id), component_id the smallest id reachable by links.

    Fingerprints link at `most` (up to 4) or fewer differing bits; equal fingerprints are one class and
    meet the others once. Null and wordless texts have fingerprint 0, a very long text is read whole. A null id is returned
    with a null component, unless its class has ids; rows that repeat an id are rows of their own; an empty table stays
    empty. Nothing quadratic leaves a task: a run of equal keys gives links that span it, not its pairs.
    """
    fps = written(with_fingerprint(docs, id_col, text_col, k), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-classes")
    comps = linked_fingerprints(classes, most, run_rows)
    members = classes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = written(members.groupBy("component").agg(F.min("first").alias("component_id")), "first-ids")  # written, so that AQE can split a large component
    named = members.join(firsts, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")
