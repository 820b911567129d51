"""Operators 3 and 8, and the pipeline."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import packing, queries, sharding, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [(1, None), (2, ""), (3, "word " * 9000), (4, "İstanbul Σίσυφος café x² ½ it's WE'LL ''s !!'s a\x85b <|endoftext|> ﬁ 中文"), (5, "don't 'RE ABC12.5%%%"), (5, "same id"), (None, "no id"), (7, "\n\n")]


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, texts):
    """Each token lies in one piece, pieces fill their sequence without gaps, and their sums are right."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(ids_of(text))
    for doc, mine in by_doc.items():
        for ids in want[doc]:
            own = sorted((r for r in mine if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
            at = 0
            for r in own:
                assert r["start"] == at
                raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
                assert zlib.crc32(raw) == r["ids_crc32"]
                at += r["length"]
            assert at == len(ids)
    assert set(by_doc) == set(want)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["tier"] <= 2048 and at & (at - 1) == 0


def test_packing_awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("x")}).repartition(2)
    rows = packing.pack_documents(df, PATH, block_tokens=3000).collect()
    check_packing(rows, AWKWARD)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack_documents(df.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(df, PATH, tiers=(100, 2048))


def test_packing_small_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op8_packing(spark, small).collect()
    check_packing(rows, docs)
    full = sum(1 for r in rows if r["tier"] == 2048 and r["offset"] == 0)
    assert full >= 0.5 * len({r["sequence_id"] for r in rows})
    loads = defaultdict(int)
    for r in rows:
        loads[r["step_group"]] += r["length"]
    assert max(loads.values()) - min(loads.values()) <= 4 * 2048


def test_pack_is_whole():
    lengths = [1, 2047, 2048, 2049, 5000, 0, 300, 300, 511, 700, 1025]
    windows = packing.pack(lengths)
    seen = defaultdict(list)
    for size, pieces in windows:
        assert sum(n for _, _, n in pieces) == size
        for doc, at, n in pieces:
            seen[doc] += range(at, at + n)
    assert all(sorted(seen[d]) == [*range(n)] for d, n in enumerate(lengths))
    assert packing.pack([]) == []


def test_sharding(spark, small):
    rows = queries.op3_kd_sharding(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, slots, where = defaultdict(int), defaultdict(list), {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert where.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert len(rows) == len(texts) and set(sizes) == set(range(8))
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 8 + 2 * max(r["size"] for r in rows)


def test_null_and_empty_texts_are_one_point(spark, tmp_path):
    rows = [(i, None if i % 2 else "") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_kd_sharding(spark, str(tmp_path)).collect()
    assert len(out) == 440 and len({r["shard"] for r in out if r["size"] == 1}) == 1


def test_pipeline_leaves_other_tables_alone(spark, small):
    """What another query has written outlives the pipeline, also one that runs at the same time; the stages' own tables go."""
    from concurrent.futures import ThreadPoolExecutor
    from pathlib import Path

    from tidewatch.llm.common import shared_dir

    held = queries.op6_simhash_near_dedup(spark, small)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    n, before = held.count(), {p.name for p in folder.iterdir()}
    with ThreadPoolExecutor(2) as pool:
        counts = [f.result() for f in [pool.submit(lambda: corpus_pipeline.run(spark, small).count()) for _ in range(2)]]
    assert counts[0] == counts[1] > 0 and held.count() == n
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert not left - {"pipeline-decontamination", *(p.rsplit("-", 1)[0] for p in ("packed-x", "pieces-x"))}, left


def test_sharding_awkward(spark):
    rows = AWKWARD + [(50 + i, "copy") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "tie": F.lit(2), "weight": F.lit(3), "x": F.lit(4)})
    dims = sharding.text_dimensions()
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    out = sharding.kd_shards(df, dims, F.lit(1), tie, 4).collect()
    assert len(out) == len(rows) and {r["shard"] for r in out} <= {0, 1, 2, 3}
    assert len({r["shard"] for r in out if r["text"] == "copy"}) == 1
    assert sharding.kd_shards(df.limit(0), dims, F.lit(1), tie, 4).collect() == []
    assert sharding.shards_for(df, F.lit(10), 200) == 4
    with pytest.raises(ValueError):
        sharding.kd_shards(df, dims, F.lit(1), tie, 6)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, small).collect(), docs.schema)
        assert kept.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert seen[name]
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.with_toxicity(docs, lexicon).filter("toxicity >= 0.5").collect()}
    assert set(seen["toxicity"]) == {r["doc_id"] for r in docs.collect()} - bad
    ends = queries.decontaminate.contamination(spark.createDataFrame([*seen["decontamination"].items()], "doc_id long, text string"), spark.read.parquet(f"{small}/benchmark.parquet"))
    assert ends.filter("contaminated").count() == 0
    rows = corpus_pipeline.run(spark, small).collect()
    check_packing(rows, [*seen["decontamination"].items()])


def test_pipeline_awkward(spark, small):
    rows = [(i, t, None, None, None) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        assert docs.filter("doc_id IS NULL").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_sharding_against_sorted_medians(spark, small):
    """The tree by sorting every node's points, on the same dimensions."""
    text = F.coalesce("text", F.lit(""))
    dims = sharding.text_dimensions()
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", (sharding.text_bytes() + 1).alias("w"), F.xxhash64(text).alias("tie"), *[c.alias(n) for n, c in dims.items()])
    points = {}
    for r in rows.collect():
        key = (*[r[n] or 0.0 for n in dims], r["tie"])
        points.setdefault(key, [0, []])
        points[key][0] += r["w"]
        points[key][1].append(r["doc_id"])
    nodes = {0: list(points)}
    for _ in range(3):
        spread = [max(p[d] for n in nodes.values() for p in n) - min(p[d] for n in nodes.values() for p in n) for d in range(len(dims))]
        after = {}
        for name, own in nodes.items():
            d = max(range(len(dims)), key=lambda d: ((max(p[d] for p in own) - min(p[d] for p in own)) / (spread[d] or 1.0), -d))  # noqa: B023
            own = sorted(own, key=lambda p: (p[d], p[-1]))  # noqa: B023
            half, at, below = sum(points[p][0] for p in own) / 2, 0, 0
            while below + points[own[at]][0] < half:
                below += points[own[at]][0]
                at += 1
            at += points[own[at]][0] <= 2 * (half - below)
            after[2 * name], after[2 * name + 1] = own[:at], own[at:]
        nodes = after
    want = {i: name for name, own in nodes.items() for p in own for i in points[p][1]}
    got = {r["doc_id"]: r["shard"] for r in queries.op3_kd_sharding(spark, small).collect()}
    assert got == want


def test_slots(spark):
    df = spark.createDataFrame([(i % 7, 0, i % 3) for i in range(90)] + [(None, 0, 1)], "doc_id long, text_crc32 long, shard int")
    out = sharding.with_slots(df, "doc_id", bucket_rows=4).collect()
    for shard in range(3):
        own = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert own == [*range(len(own))]
    assert len(out) == 91 and sharding.with_slots(df.limit(0), "doc_id").collect() == []
