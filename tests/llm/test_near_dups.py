"""Operators 1, 2 and 6 against brute force: the small tables and awkward rows."""

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, embeddings, near_text, queries, simhash, substring
from tidewatch.llm.common import Spanner

LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
AWKWARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, f"{PASSAGE} tail five"), (6, f"head six\n{PASSAGE}"), (7, " ".join(f"p{i}" for i in range(13))),
    (8, LONG), (9, f"{LONG} more"), (10, "a " * 400), (11, "a " * 30), (12, f"É {PASSAGE.upper()} É"), (13, f"{PASSAGE}  tail five"), (14, "one two"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"id": F.lit("clash"), "fp": F.lit(1), "spans": F.lit("x"), "t": F.lit(0), "n_words": F.lit("y")}).repartition(3)


def test_vectors_of_great_and_tiny_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [1.0, 0.0])]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_substring_small_table(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.substring(rows)
    got = {r[0]: tuple(r)[1:] for r in queries.op1_substring_dedup(spark, small).collect()}
    assert got == want
    assert any(n for _, n, _ in want.values())


@pytest.mark.parametrize("broadcast_bytes", [0, common.BROADCAST_BYTES])
def test_substring_awkward(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(substring, "MANY", 2)
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast_bytes)
    df = frame(spark, AWKWARD + [(100 + i, f"{PASSAGE} extra {i}") for i in range(30)]).drop("n_words")
    want = brute.substring([tuple(r) for r in df.select("doc_id", "text").collect()])
    out = substring.remove_repeats(df, shard_rows=20)
    assert {"id", "fp", "spans", "t", "kept_text"} <= set(out.columns)
    rows = out.collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    kept = {r["doc_id"]: r["kept_text"] for r in rows}
    assert kept[1] is None and kept[6] == "head six" and kept[5] == f"{PASSAGE} tail five"


def test_a_side_is_broadcast_by_the_measured_size_of_its_rows(spark):
    """A small file of long arrays is merged, though Spark itself would broadcast it; an empty table is broadcast."""
    with common.scope(spark):
        rows = spark.range(2000).withColumn("spans", F.array_repeat(F.struct(F.lit(1).alias("at"), F.lit(2).alias("length")), 1000))
        table, none = common.written(rows, "spans"), common.written(rows.limit(0), "spans")
        plan = lambda side: spark.range(2000).join(side, "id")._jdf.queryExecution().sparkPlan().toString()
        size = 32 + 32 * F.size("spans")
        assert "BroadcastHashJoin" in plan(table) and "SortMergeJoin" in plan(common.measured(table, size))
        assert "BroadcastHashJoin" in plan(common.measured(table.limit(10), size)) and "BroadcastHashJoin" in plan(common.measured(none, size))


def test_substring_frequent_fingerprint(spark, monkeypatch):
    """A five-word phrase of low hash in ever new contexts must not put all its stretches in one shard."""
    hasher = substring.WordHasher(substring.ascii_space())
    tries = [f"h{i} h{i + 1} h{i + 2} h{i + 3} h{i + 4}" for i in range(20_000)]
    words, *_ = hasher([" ".join(f"h{i}" for i in range(20_004)).encode()])
    low = tries[int(substring.grams(words, 5).argmin())]
    rows = [(i, " ".join([*(f"a{i % 150}x{k}" for k in range(12)), low, *(f"z{i % 170}x{k}" for k in range(12))])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = {}
    monkeypatch.setattr(substring, "_locate", lambda span, real=substring._locate: _counted(real(span), spark, held))
    out = substring.remove_repeats(df, shard_rows=40).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == brute.substring(rows)
    assert any(r["n_removed"] for r in out)
    assert held["rows"].value <= 40


def _counted(run, spark, held):
    """`run`, with the most distinct stretches that a part gave it."""
    from pyspark.accumulators import AccumulatorParam

    class Most(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):  # noqa: N802
            return max(a, b)

    most = held["rows"] = spark.sparkContext.accumulator(0, Most())

    def counted(batches):
        def seen():
            total = {}
            for batch in batches:
                parts, kinds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "kind"))
                for p in [p for p, k in zip(parts, kinds) if k == 0]:
                    total[p] = total.get(p, 0) + 1
                yield batch
            most.add(max(total.values(), default=0))

        yield from run(seen())

    return counted


def test_substring_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(none).collect() == []
    twice = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(twice).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 40)]


def test_golay_keys():
    golay = simhash.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    for flips in ([], [3], [3, 17]):
        other = words.copy()
        for b in flips:
            other ^= 1 << b
        a, b = golay.keys(words, 23), golay.keys(other, 23)
        assert all({*x[x >= 0]} & {*y[y >= 0]} for x, y in zip(a, b))


def test_golay_finds_every_pair_within_four_bits():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fps.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    golay = simhash.Golay()
    keys = lambda x: [{*k.tolist()} for k in (simhash.pair_keys(np.array([f], np.uint64), golay)[1] for f in x)]
    assert all(a & b for a, b in zip(keys(fps), keys(near)))


def test_simhash_small_table(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op6_simhash_near_dedup(spark, small).collect()}
    assert got == brute.simhash(rows)


def test_simhash_awkward(spark):
    rows = AWKWARD + [(200 + i, f"{LONG} {i}") for i in range(60)]
    want = brute.simhash(rows)
    out = simhash.simhash_groups(frame(spark, rows)).collect()
    assert {r["id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in out} == want
    assert want[1][1] == want[3][1] == 1
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_groups(frame(spark, rows), most=5)


def test_long_runs_are_spanned():
    rng = np.random.default_rng(3)
    base = np.full(3000, 12345678901234567, np.uint64)
    for i in range(3000):
        base[i] ^= np.uint64(1) << np.uint64(rng.integers(64)) | np.uint64(1) << np.uint64(rng.integers(64))
    base = np.unique(base)
    links = simhash._spanning(np.zeros(len(base), np.int32), base, 4, simhash.Forest())
    assert len(links) == len(base) - 1


def test_vectors_small_table(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op2_embedding_near_dedup(spark, small).collect()}
    assert got == brute.vectors(rows)


@pytest.mark.parametrize(("cell_values", "broadcast_rows"), [(256, 0), (1 << 21, 100_000)])
def test_vectors_awkward(spark, monkeypatch, cell_values, broadcast_rows):
    monkeypatch.setattr(embeddings, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in centre[i % 12] + 0.12 * rng.standard_normal(16)]) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [2 * x for x in rows[5][1]]), (203, None), (204, []), (205, [0.0] * 16), (206, [float("nan")] + [1.0] * 15), (207, [None] + [1.0] * 15), (208, [1.0, 2.0]), (209, [2.0, 4.0]), (210, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "cell": F.lit(1), "v": F.lit(2)})
    out = embeddings.near_vectors(df, cell_values=cell_values).collect()
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in out} == brute.vectors(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in out)
    assert len(out) == len(rows)


def test_vectors_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def grown_vectors(n, seed=11):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, 64))
    rows[n // 2 : n // 2 + n // 8] = rows[: n // 8] + 0.02 * rng.standard_normal((n // 8, 64))
    return rows


def test_vectors_that_no_grid_prunes_are_sent_once_a_tile(spark, monkeypatch):
    """Evenly spread vectors: what is sent to tasks is a vector a tile, not one for each cell near it."""
    rows = grown_vectors(600)
    sent = []
    plain = embeddings._verify

    def counted(*args):
        total = spark.sparkContext.accumulator(0)
        sent.append(total)
        run = plain(*args)

        def f(pdf):
            total.add(len(pdf))
            return run(pdf)

        return f

    monkeypatch.setattr(embeddings, "_verify", counted)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, cell_values=150 * 64).collect()}
    assert got == brute.vectors([(i, r.tolist()) for i, r in enumerate(rows)])
    assert sent[-1].value <= 600 * 4


def test_vectors_that_a_grid_prunes(spark):
    """Vectors in few narrow clusters keep the grid, and each way finds the same links."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((40, 64))
    rows = [(i, (centre[i % 40] + 0.15 * rng.standard_normal(64)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.vectors(rows)
    for axes, cell_values in ((None, 640), (3, 1 << 21)):
        out = embeddings.near_vectors(df, axes=axes, cell_values=cell_values).collect()
        assert {r["id"]: (r["n_links"], r["component_id"]) for r in out} == want


def jaccard_groups(docs, least=0.8):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    near = lambda a, b: a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9)
    return brute.components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(sets[a], sets[b])])


def test_near_text_small_table(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["id"]: r["component_id"] for r in near_text.near_text_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == jaccard_groups(rows)


@pytest.mark.parametrize(("short_run", "tile"), [(8, 1 << 20), (1, 2000)])
def test_near_text_awkward(spark, monkeypatch, short_run, tile):
    monkeypatch.setattr(near_text, "TILE", tile)
    monkeypatch.setattr(near_text, "SHORT_RUN", short_run)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(400)]
    rows = AWKWARD + [(500, " ".join(base))]
    for i in range(40):  # from well above to well below the threshold
        own = list(base)
        for at in rng.choice(400, 2 + i // 2, replace=False):
            own[at] = f"n{i}x{at}"
        rows.append((501 + i, " ".join(own)))
    want = jaccard_groups(rows)
    got = {r["id"]: r["component_id"] for r in near_text.near_text_groups(frame(spark, rows)).collect()}
    assert got == want and 1 < len({want[i] for i in want if i >= 500}) < 41
    assert near_text.near_text_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_drops_near_duplicates_by_similarity(spark, small):
    base = [f"b{i}" for i in range(400)]
    near = [f"n{i}" if i % 50 == 7 else w for i, w in enumerate(base)]  # eight words changed: 356 of 436 shingles shared
    texts = [" ".join(base), " ".join(near)]
    a, b = (simhash.fingerprint(t) for t in texts)
    assert (a ^ b).bit_count() > 4
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()] == [0]


def test_repeated_ids_keep_their_own_texts(spark):
    unique = " ".join(f"u{i}" for i in range(30))
    rows = [(1, PASSAGE), (5, f"{PASSAGE} tail"), (5, unique), (5, unique), (6, unique), (None, unique)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring.remove_repeats(df).select("doc_id", "text", "n_removed").collect()
    got = sorted((r["doc_id"] or 0, r["text"].split()[0], r["n_removed"]) for r in out)
    assert got == [(0, "u0", 0), (1, "p0", 0), (5, "p0", 40), (5, "u0", 0), (5, "u0", 0), (6, "u0", 30)]


def test_repeated_ids_keep_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (3, None), (None, [0.0, 1.0, 0.0])]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_repeated_ids_in_groups(spark):
    rows = [(3, LONG), (5, LONG), (5, PASSAGE), (None, PASSAGE), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] or 0, r["component_id"]) for r in simhash.simhash_groups(df).collect())
    assert got == [(0, 5), (3, 3), (5, 3), (5, 5), (7, 7)]
    got = sorted((r["id"] or 0, r["component_id"], r["first"]) for r in near_text.near_text_groups(df).collect())
    assert got == [(0, 5, False), (3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True)]


def test_pipeline_near_duplicates_with_repeated_ids(spark, small):
    rows = [(3, LONG), (5, LONG), (5, PASSAGE), (5, PASSAGE), (None, PASSAGE), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect())
    assert got == [(0, "p0"), (3, "w0"), (5, "p0"), (8, ""), (8, "")]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), small).collect() == []


def test_simhash_long_runs_go_to_tiles(spark):
    rng = np.random.default_rng(6)
    words = [f"c{i}" for i in range(250)]
    rows = [(i, " ".join([*words, f"t{i}"])) for i in range(90)] + [(200 + i, " ".join(rng.choice(words, 50))) for i in range(60)]
    got = {r["id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), run_rows=3).collect()}
    assert got == brute.simhash(rows)
    assert len({fp for i, (fp, _) in got.items() if i < 90}) > 3


def test_spanner():
    rng = np.random.default_rng(7)
    spanner, links = Spanner(500), []
    for _ in range(5):
        i, j = rng.integers(0, 500, (2, 80))
        links += [*zip(i.tolist(), j.tolist())]
        new = spanner.add(i, j)
        assert len({*new.tolist()}) == len(new)
    want = brute.components(range(500), links)
    assert len({*spanner.label.tolist()}) == len({*want.values()})
    assert all(spanner.label[a] == spanner.label[b] for a, b in links)


def test_components_can_be_split(spark):
    """No aggregate stands between an exchange and a join, so AQE can split a vertex with many edges; and tables go."""
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(5000, 5001), (5001, 5002), (None, 1), (7, 7)], "a long, b long"))
    joins, real = [], common.written
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        common.written = lambda df, name: joins.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
        comps = {r["id"]: r["component"] for r in common.connected_components(edges).collect()}
    finally:
        common.written = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
    assert comps == {i: 0 for i in range(3000)} | {5000: 5000, 5001: 5000, 5002: 5000}
    for plan in joins:
        if "SortMergeJoin" in plan:
            below = plan[plan.index("SortMergeJoin") :]
            assert "HashAggregate" not in below, below
    common.release(spark)
    assert not common._SCOPE.get().paths
