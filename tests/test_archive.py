"""The archive's gate, records and ledger rows, and saved arms, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import bandit
from tidewatch.sources import archive, ledger

NOW = dt.datetime(2026, 6, 20, 8, tzinfo=dt.timezone.utc)
CARD = "canonical_key string, final_score double, independent_source_count int, title string, pushed boolean, first_seen timestamp, cluster_id string"


def when(value):
    return value.replace(tzinfo=dt.timezone.utc)


def test_gate(spark):
    rows = [("a", 55.0, 2), ("b", 54.9, 2), ("c", 99.0, 1), ("d", None, 2), ("e", 99.0, None), ("f", float("nan"), 3), ("g", 10.0, 0)]
    cards = spark.createDataFrame(rows, "id string, final_score double, independent_source_count int")
    got = {r["id"]: (r["outcome"], r["reason"]) for r in archive.outcomes(cards).collect()}
    assert got == {
        "a": ("archived", None), "b": ("refused", "score"), "c": ("refused", "sources"), "d": ("refused", "score"), "e": ("refused", "sources"), "f": ("refused", "score"), "g": ("refused", "sources"),
    }
    assert archive.outcomes(cards, dry_run=True).filter("outcome = 'would-archive'").count() == 1
    assert archive.outcomes(cards, min_sources=3, bar=0).filter("reason IS NULL").count() == 0


def test_records_fill_what_is_missing(spark):
    cards = spark.createDataFrame([("k", 60.0, 2, None, None, None, None), ("l", 70.0, 3, "t", True, dt.datetime(2026, 1, 2), "c1")], CARD)
    cards = cards.withColumns({"opportunity_id": F.when(F.col("canonical_key") == "l", "own").otherwise(""), "status": F.lit(None).cast("string"), "title_2": F.lit("extra"), "reason": F.lit("clash")})
    a, b = archive.records(cards, NOW, "r1").orderBy("canonical_key").collect()
    assert list(a.asDict()) == [f[0] for f in archive.FIELDS]
    assert a["opportunity_id"] == spark.range(1).select(T.opportunity_id(F.lit("k"))).first()[0] and b["opportunity_id"] == "own"
    assert (a["status"], a["title"], a["cluster_id"], a["pushed"], a["push_count"], a["focus_tags"], a["evidence"], a["score_breakdown"]) == ("new", "", "", False, 0, [], [], {})
    assert (a["track"], a["grade"], a["delegated_deepdive"]) == (None, None, None)
    assert a["first_seen"] == a["last_seen"] == b["last_seen"] and b["first_seen"] == dt.datetime(2026, 1, 2)
    assert (b["score"], b["independent_source_count"], b["pushed"], b["run_id"], b["schema_version"]) == (70.0, 3, True, "r1", 1)
    assert archive.records(cards.limit(0), NOW, "r1").count() == 0


def test_a_repeated_run_doubles_nothing(spark, tmp_path):
    cards = spark.createDataFrame([("k", 60.0, 2, "t", False, None, None), ("k", 60.0, 2, "t", False, None, None), ("l", 10.0, 2, "t", False, None, None)], CARD)
    path = str(tmp_path / "a")
    archive.append_archive(cards, path, NOW, "r1", dry_run=True)
    assert not (tmp_path / "a").exists()
    for run in ("r1", "r1", "r2"):
        judged = archive.append_archive(cards, path, NOW, run)
    assert sorted(r["outcome"] for r in judged.collect()) == ["archived", "archived", "refused"]
    got = spark.read.parquet(path)
    assert got.groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 2)]
    archive.append_archive(cards.filter("canonical_key = 'l'"), path, NOW + dt.timedelta(days=1), "r3")  # all refused
    assert spark.read.parquet(path).count() == 4
    for bad in ("", "a/b", "r 1"):
        with pytest.raises(ValueError):
            archive.append_archive(cards, path, NOW, bad)


def test_records_in_the_ledger(spark, tmp_path):
    evidence = F.array(*[F.struct(F.lit(s).alias("source"), F.lit("u").alias("url")) for s in ("x", " ", "a", "x")])
    first = spark.createDataFrame([("k", 60.0, 2, "alpha", True, dt.datetime(2026, 1, 2), "c1")], CARD).withColumn("evidence", evidence)
    later = spark.createDataFrame([("k", 50.0, 2, "beta", False, None, None), ("new", 90.0, 2, None, True, None, "c2")], CARD)
    book = ledger.Ledger(spark, str(tmp_path), buckets=4)
    book.merge(archive.ledger_rows(archive.records(first, NOW, "r1")), 0)
    for _ in range(2):  # the second one is a replay
        book.merge(archive.ledger_rows(archive.records(later, NOW + dt.timedelta(days=1), "r2")), 1)
    old, new = book.rows().orderBy("canonical_key").collect()
    assert (old["cluster_id"], old["push_count"], old["last_score"], old["text"], old["source_set"]) == ("c1", 1, 50.0, "beta ", ["a", "x"])
    assert old["first_seen"] == dt.datetime(2026, 1, 2) and old["last_seen"] == dt.datetime(2026, 6, 21, 8)
    assert [(s["score"], s["source"]) for s in old["samples"]] == [(60.0, "a"), (50.0, "")]
    assert (new["cluster_id"], new["push_count"], new["toks"], new["source_set"]) == ("c2", 1, [], [])


def test_saved_arms_of_any_shape(spark):
    bodies = {
        1: '{"a": {"alpha": 2.5, "beta": "3", "n": 4}}', 2: '{"a": {"alpha": -1, "beta": 0, "n": -2}, "b": {"alpha": null, "beta": "no", "n": 2.9}}', 3: "[1]", 4: "{", 5: None, 6: "7", 7: '{"a": 3, "b": [], "c": null}', 8: "{}",
        9: '{"a": {"alpha": true, "beta": "NaN", "n": true}, "b": {"alpha": "1e400", "n": "x"}, "": {}}', 10: '{"a": {"alpha": {"x": 1}, "n": 99999999999999999999}}',
    }
    states = spark.createDataFrame([*bodies.items()], "key long, body string")
    got = {(r["key"], r["track"]): (r["alpha"], r["beta"], r["n"]) for r in bandit.read_arms(states, "key", "body", (1.0, 2.0)).collect()}
    assert {k for k, _ in got} == {1, 2, 9, 10}
    assert got[1, "a"] == (2.5, 3.0, 4) and got[2, "a"] == (1e-9, 1e-9, 0) and got[2, "b"] == (1.0, 2.0, 2)
    assert got[9, "a"] == (1.0, 2.0, 1) and got[9, "b"] == (1.0, 2.0, 0) and got[9, ""] == (1.0, 2.0, 0)
    assert got[10, "a"][:2] == (1.0, 2.0)


def test_arms_are_saved_and_read_back(spark):
    rows = [("s", "b", 1.5, 2.0, 3), ("s", "a", 1e-9, 7.25, 0), ("t", "a", 1.0, 1.0, 1)]
    arms = spark.createDataFrame(rows, "id string, track string, alpha double, beta double, n long")
    saved = bandit.saved_arms(arms, "id")
    assert {r["id"]: r["body"] for r in saved.collect()}["s"].index('"a"') < {r["id"]: r["body"] for r in saved.collect()}["s"].index('"b"')
    assert sorted(tuple(r) for r in bandit.read_arms(saved, "id", "body").collect()) == sorted(rows)


def test_rewards_are_clamped(spark):
    arms = spark.createDataFrame([("a", None, float("nan"), -3), ("z", -2.0, 0.0, 1)], "track string, alpha double, beta double, n long")
    seen = spark.createDataFrame([("a", 7.0), ("a", -1.0), ("a", None), ("a", float("nan"))], "track string, reward double")
    got = {r["track"]: tuple(r)[1:] for r in bandit.fold_rewards(arms, seen).collect()}
    assert got == {"a": (2.0, 4.0, 4), "z": (1e-9, 1e-9, 1)}
