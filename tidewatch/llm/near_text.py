"""Near-duplicate texts by the Jaccard similarity of their word shingles, for the pipeline.

Texts with the same set of shingles are one class. Classes are candidates if their five-word SimHash fingerprints are linked by
Golay keys (`simhash.linked_fingerprints`: at most four differing bits), which finds most close copies but few pairs near 0.8, or if
they agree in a band of their MinHash signatures: at a similarity of 0.8, BANDS bands of ROWS values miss a pair with a
probability of 3e-6, above it with less. Candidates link only if the similarity of their whole shingle sets reaches the threshold.

A band that many classes share is chained at random first. Where the chains have left different components in it, their
shingle sets are dealt to blocks of TILE shingles, which meet two by two in tasks that give only the links that join
components: no square of a group leaves a task, and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Forest, WordHasher, ascii_space, connected_components, grams, mix, slices, written
from tidewatch.llm.simhash import fingerprint, linked_fingerprints

SHINGLE = 5
BANDS, ROWS = 32, 5
SHORT_RUN = 8
TILE = 1 << 20
CHUNK = 1 << 20
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_MASK = mix(_ODD)


def _hasher() -> WordHasher:
    """Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    fold = np.arange(256)
    fold[65:91] += 32
    return WordHasher(ascii_space(), fold)


def shingle_sets(texts: list[str | None], hasher: WordHasher, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles; fewer than k words are one shingle, no words give none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in slices([len(t) for t in raw], CHUNK):
        words, _, _, owner, _ = hasher(raw[a:b])
        bounds = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
        for low, high in zip(bounds, bounds[1:]):
            own = words[low:high]
            yield np.unique(grams(own, min(k, len(own)))) if len(own) else own


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature of a set."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[at : at + 512] ^ _MASK[:, None]) * _ODD[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ value)
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = _hasher()
    for batch in batches:
        fps, sizes, keys, texts = [], [], [], batch.column(2).to_pylist()
        sims = np.fromiter((fingerprint(t, SHINGLE) for t in texts), np.uint64, len(texts)).view(np.int64)
        for own in shingle_sets(texts, hasher):
            fps.append(int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
            sizes.append(len(own))
            keys.append(bands(own).view(np.int64))
        columns = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sims), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "print", "fp", "size", "sim", "keys"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = _hasher()
    for batch in batches:
        sets = [own.view(np.int64) for own in shingle_sets(batch.column(1).to_pylist(), hasher)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])


def _pairs(least: float):
    """Pairs within runs of equal keys: all of a short run and a random chain of a long one. Sizes that rule
    the similarity out make no pair."""

    def of(keys, fps, sizes):
        order = np.lexsort((mix(fps.view(np.uint64) ^ keys.view(np.uint64)), keys))
        keys, fps, sizes = keys[order], fps[order], sizes[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.append(starts, len(keys)))
        long = np.repeat(lengths > SHORT_RUN, lengths)
        at = np.arange(len(keys))
        for step in range(1, SHORT_RUN + 1):
            if step > 1:
                at = at[~long[at]]
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            x, y = at, at + step
            keep = (np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y]) - 1e-6) & (fps[x] != fps[y])
            if keep.any():
                a, b = fps[x[keep]], fps[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if last:
                yield from of(*[x[:last] for x in now])
            held = [x[last:] for x in now]
        if held is not None and len(held[0]):
            yield from of(*held)

    return run


def _joining(fps: list[int], labels: list[int], blocks: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between the sets of one tile that join what labels and earlier links have apart; of two blocks only those between them."""
    order = sorted(range(len(fps)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    words, code, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(order)), sizes)
    met = count[code] > 1  # a shingle of one set alone is in no intersection
    code, owner = code[met], owner[met]
    by_word = np.argsort(code, kind="stable")
    holders, ends = owner[by_word], np.searchsorted(code[by_word], np.arange(len(words) + 1))
    bounds = np.searchsorted(owner, np.arange(len(order) + 1))
    forest, out = Forest(), []
    side = np.array([blocks[i] for i in order])
    mixed = len({*blocks}) > 1
    for i in range(len(order)):
        own = code[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        shared = np.bincount(np.concatenate([holders[ends[c] : ends[c + 1]] for c in own.tolist()]), minlength=len(order))
        shared[: i + 1] = 0
        if mixed:
            shared[side == side[i]] = 0
        for j in np.flatnonzero((shared > 0) & (shared >= least * (sizes[i] + sizes - shared) - 1e-6)).tolist():
            x, y = order[i], order[j]
            if forest.union(labels[x], labels[y]):
                out.append((fps[x], fps[y]))
    return out


def _verified(least: float):
    """Links (a, b) of the tiles; rows (key, i, j, fp, label, block, shingles) come sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer():
            links = _joining(*held, least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        at, held = None, ([], [], [], [])
        for batch in batches:
            sets = batch.column(6)
            for n, (key, i, j, *row) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(6)])):
                if (key, i, j) != at:
                    if len(held[0]) > 1:
                        yield answer()
                    at, held = (key, i, j), ([], [], [], [])
                for own, value in zip(held, (*row, sets[n].values.to_numpy())):
                    own.append(value)
        if len(held[0]) > 1:
            yield answer()

    return run


def near_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per input row: (id, print, fp, component_id, first), component_id the smallest id reachable by links.

    Two texts link if the Jaccard similarity of their sets of five-word shingles is `least` (0.8 or more) or
    above. fp stands for the set of shingles; texts without words share the empty one. print tells texts of one id apart;
    first is true for the rows of one text in each component, the least by id and print. A null id comes after all others.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("print", F.xxhash64("t"))
    signed = written(base.select("id", "print", "t").mapInArrow(_sign, "id long, print long, fp long, size int, sim long, keys array<long>"), "signed-texts")
    classes = written(signed.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "size", "sim", "keys")).alias("one")).select("fp", "one.*"), "text-classes")
    worded = classes.filter("size > 0")
    near = written(linked_fingerprints(worded.select(F.col("sim").alias("fp")).distinct()).select(F.col("fp").alias("sim"), "component"), "near-prints")
    # fingerprints that have links, and those that several classes share, are keys beside the bands
    by_print = worded.join(near, "sim", "left").select(F.xxhash64(F.coalesce("component", "sim"), F.lit("print")).alias("key"), "fp", "size")
    keyed = worded.select(F.explode("keys").alias("key"), "fp", "size").unionByName(by_print)
    named = F.struct("no_id", "id", "print")

    def spelled(ends: DataFrame) -> DataFrame:
        asked = classes.join(ends, "fp", "left_semi").select("fp", F.col("id").alias("__id"), F.col("print").alias("__print"))
        texts = base.join(asked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")))
        return written(texts.select("fp", "t").mapInArrow(_spell, "fp long, shingles array<long>").dropDuplicates(["fp"]), "shingle-sets")

    pairs = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(least), "a long, b long").distinct(), "near-pairs")
    sets = spelled(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = written(both.filter(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-6).select("a", "b"), "near-links")
    comps = written(connected_components(links), "near-components")
    labelled = keyed.join(comps.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.filter((F.col("n") > SHORT_RUN) & (F.col("low") < F.col("high"))).select("key")
    rest = written(labelled.join(mixed, "key", "left_semi").select("key", "fp", "size", "label"), "mixed-bands")
    if not rest.isEmpty():
        blocks = written(rest.groupBy("key").agg(F.ceil(F.sum("size") / F.lit(TILE)).cast("int").alias("s")), "band-blocks")
        dealt = rest.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("s")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        tiles = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "label", "block")
        full = tiles.join(spelled(rest.select("fp").distinct()), "fp").select("key", "i", "j", "fp", "label", "block", "shingles")
        more = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_verified(least), "a long, b long")
        comps = connected_components(links.unionByName(more))
    members = classes.select("fp", named.alias("name")).join(comps.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = written(members.groupBy("component").agg(F.min("name").alias("head")), "first-ids")  # written, so that AQE can split a large component
    heads = members.join(firsts, "component").select("fp", "head")
    first = F.col("id").eqNullSafe(F.col("head.id")) & F.col("print").eqNullSafe(F.col("head.print"))
    return signed.select("id", "print", "fp").join(heads, "fp").select("id", "print", "fp", F.col("head.id").alias("component_id"), first.alias("first"))
