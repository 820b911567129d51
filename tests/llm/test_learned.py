"""Operators 11 to 13: held-out accuracy and plain versions of their arithmetic."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import centroids, common, language, queries, whitening

# ---------------------------------------------------------------- language


def plain_language(model, text):
    """A word at a time, as the docstring has it."""
    found = language.words(text)
    if not found or not model.names:
        return "und", 0.0
    total = [0.0] * len(model.names)
    for word, n in found.items():
        if word in model.words:
            rows = [model.words[word]]
        else:
            padded = f" {word} "
            for size in range(min(5, len(padded)), 0, -1):
                rows = [model.grams[padded[i : i + size]] for i in range(len(padded) - size + 1) if padded[i : i + size] in model.grams]
                if rows:
                    break
        for k in range(len(total)):
            total[k] += n * (sum(model.table[r][k] for r in rows) / len(rows) if rows else 0.0)
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return model.names[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_language_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op11_language_id(spark, small).collect()
    assert len(rows) == len(want)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(want[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    model, texts = language.learn(docs), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows[::20]:
        name, score = plain_language(model, texts[r["doc_id"]])
        assert name == r["lang_pred"] and score == pytest.approx(r["score"], abs=1e-9)


def test_language_learning_is_counting(spark):
    """The figures are smoothed log shares of counts over the rows that may be learned from."""
    rows = [(i, t, lang) for i in range(40) for t, lang in (("uno dos dos", "es"), ("one two", "en"))]
    rows += [(None, "hidden hidden", "en"), (3, None, "en"), (5, "lost lost lost", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [(t, g) for i, t, g in {*rows} if i is not None and t and g and not _held(i)]
    model = language.learn(df, least=1)
    tally = {g: Counter(w for t, x in learned if x == g for w in t.split()) for g in ("en", "es")}
    assert model.names == ["en", "es"] and set(model.words) == {"uno", "dos", "one", "two"}
    for word, row in model.words.items():
        for k, g in enumerate(model.names):
            assert model.table[row][k] == pytest.approx(math.log((tally[g][word] + 0.5) / (sum(tally[g].values()) + 2)))
    singles = Counter(c for t, g in learned if g == "en" for w in t.split() for c in w)
    n = sum(1 for g in model.grams if len(g) == 1)
    assert model.table[model.grams["o"]][0] == pytest.approx(math.log((singles["o"] + 0.5) / (sum(singles.values()) + 0.5 * n)))
    many = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 4 = 0, 'a', 'b') AS lang")
    with common.scope(spark):
        found = Counter(r["lang"] for r in language.training_rows(many.union(many), rows=200).collect())
    assert set(found) == {"a", "b"} and all(60 < n < 200 for n in found.values())  # equal rows are counted, but give one row


def _held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_awkward(spark):
    rows = [(i, f"der die das und {i} Straße", "de") for i in range(20)] + [(100 + i, f"the and of {i} water", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df, least=2)
    odd = [(1, None), (2, ""), (3, "12 ... !?"), (4, "中文字"), (5, "the " * 600_000), (6, "DIE STRASSE und das"), (6, "the water"), (None, "of the"), (7, "die" * 300_000), (8, "état and the of"), (8, "état and the of"), (9, "²½٣")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "lang_score": F.lit("x"), "item": F.lit(2)}).repartition(3)
    out = language.with_language(frame, model)
    assert out.columns == ["doc_id", "text", "item", "lang_pred", "lang_score"]
    got = {}
    for r in out.collect():
        got.setdefault((r["doc_id"], (r["text"] or "")[:9]), set()).add((r["lang_pred"], r["lang_score"]))
    assert all(len(v) == 1 for v in got.values())
    name = {k: next(iter(v))[0] for k, v in got.items()}
    assert [name[k] for k in ((1, ""), (2, ""), (3, "12 ... !?"), (9, "²½٣"))] == ["und"] * 4
    assert name[4, "中文字"] == "de" and got[4, "中文字"] == {("de", 0.5)}  # all tie: the least name
    assert [name[k] for k in ((5, "the the t"), (6, "DIE STRAS"), (6, "the water"), (None, "of the"), (8, "état and"))] == ["en", "de", "en", "en", "en"]
    assert language.with_language(frame.limit(0), model).collect() == []
    none = language.learn(df.limit(0))
    assert {r["lang_pred"] for r in language.with_language(frame, none).collect()} == {"und"}


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Ab cd. é e-f  gh\n" * 50
    whole = language.words(text)
    monkeypatch.setattr(language, "_PIECE", 7)
    assert language.words(text) == whole and sum(whole.values()) == 300


# ---------------------------------------------------------------- clusters


def plain_clusters(rows, k=8, rounds=10, dim=64):
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    centres = [x for _, x in sorted(((i, x) for i, x in good if i is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in good:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(col) // len(col) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    ends = [(i, *nearest(x)[::-1]) for i, x in good]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    own = Counter()
    for _, c, d in ends:
        own[c] += d
    return sorted((str(i), c, d, own[c], sum(own.values()), shas[c]) for i, c, d in ends)


def clusters(df, **more):
    return sorted((str(r["id"]), *tuple(r)[1:]) for r in centroids.elkan_clusters(df, **more).collect())


def test_clusters_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").limit(200).collect()]
    assert clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)) == plain_clusters(rows)


def test_clusters_ties_and_awkward(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(v) / 1024 for v in rng.integers(-2, 2, 4)]) for i in range(300)]  # a coarse grid: many ties and copies
    rows += [(300, None), (301, []), (302, [1.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (304, [None, 0.0, 0.0, 0.0]), (305, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.001, -0.0005, 0.0, 0.0]), (7, [0.0, 0.0, 0.0, 1.5]), (7, [0.0, 0.0, 0.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "own": F.lit(1), "cluster": F.lit(2)}).repartition(3)
    for k, rounds in ((8, 10), (3, 1), (1, 2)):
        assert clusters(df, k=k, rounds=rounds, dim=4) == plain_clusters(rows, k, rounds, 4)
    few = df.filter("vec_id IN (1, 2)")
    assert clusters(few, dim=4) == plain_clusters([r for r in rows if r[0] in (1, 2)], dim=4)
    assert clusters(df.limit(0), dim=4) == [] and clusters(df.filter("vec_id IS NULL"), dim=4) == []
    with pytest.raises(Exception, match="too great"):
        clusters(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2)


def test_bounds_rule_out_distances_only():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(-20, 20, (500, 6)) + 1000 * c for c in range(5)]).astype(np.int64)
    centres = x[::500].copy()
    own, upper, lower = np.zeros(len(x), np.int64), centroids.above(centroids.squares(x, centres[0])), np.zeros((len(x), 5), np.int64)
    work = centroids.settle(x, own, upper, lower, centres, np.zeros(5, np.int64))
    for _ in range(4):
        moved = centres + rng.integers(-3, 4, centres.shape)
        shift = centroids.above(centroids.squares(centres, moved))
        centres = moved
        work = centroids.settle(x, own, upper, lower, centres, shift)
        true = np.stack([centroids.squares(x, c) for c in centres], axis=1)
        assert np.array_equal(own, true.argmin(axis=1))
        assert (upper**2 >= true[np.arange(len(x)), own]).all() and (lower**2 <= true).all()
        assert work < 0.2 * true.size
    for v in (*range(2000), (1 << 60) - 1, 1 << 60, (1 << 52) + 1):
        square = np.array([v])
        assert int(centroids.above(square)[0]) ** 2 >= v >= int(centroids.below(square)[0]) ** 2


# ---------------------------------------------------------------- whitening


def exact_covariance(x):
    n, dim = len(x), len(x[0])
    mean = [Fraction(sum(r[j] for r in x), n) for j in range(dim)]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(dim)] for i in range(dim)]


def check_whitening(rows, out, most=32):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    cov = np.array(exact_covariance([x for _, x in good]), float)
    values, axes = np.linalg.eigh(cov)
    m = min(most, int((values > 1e-11 * values.max()).sum()))
    n, sums = len(good), [sum(col) for col in zip(*(x for _, x in good))]
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], []).append(r)
        assert r["n"] == n and 0 <= r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(values[-r["component"]] / np.trace(cov), rel=1e-9)
    assert set(got) == {i for i, _ in good}
    w = np.array([[r["whitened"] for r in sorted(got[i], key=lambda r: r["component"])] for i, _ in good])
    assert w.shape == (n, m)
    d = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in good])
    want = d @ (axes[:, ::-1][:, :m] / np.sqrt(values[::-1][:m]))
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, rtol=0, atol=1e-7)
    assert np.allclose(w.T @ w / n, np.eye(m), atol=1e-9)
    for i, x in good:
        assert {int(r["deviation"]) for r in got[i]} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}


def test_whitening_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, queries.op13_whitening(spark, small).collect())


def test_whitening_awkward(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [float("nan")] * 5), (104, [None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "n": F.lit(1), "component": F.lit(2)}).repartition(3)
    check_whitening(rows, whitening.whiten(df, most=3).withColumnRenamed("id", "vec_id").collect(), most=3)
    flat = [(i, [v[0], v[0], 0.25, v[1], 1.0]) for i, v in rows]  # three directions say nothing
    check_whitening(flat, whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).withColumnRenamed("id", "vec_id").collect())
    again = spark.createDataFrame([(1, [0.5] * 3)] * 4, "vec_id long, embedding array<double>")
    assert whitening.whiten(again).collect() == [] and whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id IN (100, 101, 103)")).collect() == []
    twice = whitening.whiten(spark.createDataFrame([(1, [0.5]), (1, [0.5]), (None, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["id"] is None, int(r["deviation"])) for r in twice) == [(False, 96**2), (False, 96**2), (True, 192**2)]
    with pytest.raises(Exception, match="too great"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_double_double_is_exact():
    rng = np.random.default_rng(4)
    block = rng.standard_normal((700, 3)) * np.array([1.0, 1e6, 1e-7])
    assert np.array_equal(sum(whitening.cut(block)[::-1]), block) and whitening.cut(np.zeros((2, 2))) == []
    outer = whitening.Outer(3)
    outer.add(block[:300])
    other = whitening.Outer(3)
    other.add(block[300:])
    high, low = whitening.add(outer.high, outer.low, other.high, other.low)
    full = np.column_stack((block, np.ones(700)))
    for i in range(4):
        for j in range(4):
            want = sum(Fraction(a) * Fraction(b) for a, b in zip(full[:, i].tolist(), full[:, j].tolist()))
            size = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(full[:, i].tolist(), full[:, j].tolist()))
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want) <= size * Fraction(1, 1 << 98)


def test_scopes_delete_their_own_tables(spark, tmp_path):
    held = common.written(spark.range(5).toDF("a"), "held")
    with common.scope(spark) as keep:
        stays, goes = keep(common.written(spark.range(6).toDF("a"), "stays")), common.written(spark.range(7).toDF("a"), "goes")
        with common.scope(spark):
            inner = common.written(spark.range(8).toDF("a"), "inner")
        with pytest.raises(Exception):
            inner.count()
        assert goes.count() == 7
    assert held.count() == 5 and stays.count() == 6
    with pytest.raises(Exception):
        goes.count()
    with pytest.raises(ZeroDivisionError), common.scope(spark):
        late = common.written(spark.range(9).toDF("a"), "late")
        raise ZeroDivisionError
    with pytest.raises(Exception):
        late.count()
