"""The weekly report, run markers, configuration errors and shared references on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import gate, guards, yields

NOW = dt.datetime(2024, 1, 31)


def ago(days):
    return NOW - dt.timedelta(days=days)


def sections(spark, evidence, pulls, **kw):
    roster = spark.createDataFrame([("dull", True, None), ("early", True, None), ("noisy", True, ""), ("off", False, None)], "name string, enabled boolean, topic_filter string")
    found = spark.createDataFrame(evidence, "opp_id int, ts timestamp, kind string, name string, pushed boolean, faves double, track string")
    pulled = spark.createDataFrame(pulls, "kind string, name string, ts timestamp, kept int")
    return sorted(tuple(r) for r in yields.report(roster, found, pulled, F.lit("2024-01-31").cast("timestamp"), **kw).collect())


EVIDENCE = [
    (1, ago(20), "handle", "early", False, 10.0, "a"),
    (2, ago(1), "handle", "noisy", False, 900.0, "a"),
    (3, ago(1), "handle", "fresh", False, 900.0, "a"),
    (4, ago(2), "handle", "fresh", False, 900.0, "b"),
    (5, ago(2), "source", "feed", False, 900.0, "b"),
    (6, ago(40), "handle", "late", False, 900.0, "b"),
    (7, ago(41), "handle", "late", False, 900.0, "b"),
]
PULLS = [("handle", n, ago(d), 1) for n in ("dull", "early") for d in (1, 8)] + [("handle", "noisy", ago(1 + i % 9), 1) for i in range(20)]


def test_report_prunes_spares_proposes_and_suggests(spark):
    want = [("disabled", "off"), ("propose_add", "fresh"), ("prune", "dull"), ("suggest_filters", "noisy")]
    assert sections(spark, EVIDENCE, PULLS) == want
    assert sections(spark, EVIDENCE, PULLS, apply=True) == sorted([*want, ("disabled", "dull")])


def test_report_prunes_nothing_on_a_short_history(spark):
    short = [("handle", "dull", ago(6), 1), ("handle", "dull", ago(1), 1)]
    assert sections(spark, [], short, apply=True) == [("disabled", "off")]
    assert sections(spark, [], [], apply=True) == [("disabled", "off")]


def test_a_marker_stays_as_it_was(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "label string, at int")
    out = yields.marked_once(rows(("a", 1)), rows(("a", 0), ("b", 3), ("b", 2)))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 2)]


def test_setting_errors(spark):
    cases = {
        None: [],
        "{}": [],
        "[1]": ["not an object"],
        "no json": ["not an object"],
        '{"yield": null}': [],
        '{"yield": 3}': ["yield no object"],
        '{"yield": {"floor": true, "noisy_pull_min": null}}': ["yield.noisy_pull_min no number", "yield.floor no number"],
        '{"yield": {"floor": -1, "prune_after_weeks": 6, "min_history_days": 9, "window_days": 42}}': [],
        '{"yield": {"prune_after_weeks": 6, "window_days": 41.5}}': ["yield.window_days clamped"],
        '{"yield": {"pre_viral_faves_threshold": 100}, "sources": {"twitterapi": {"min_faves_rostered": 101}}}': ["min_faves_rostered clamped"],
        '{"sources": {"twitterapi": {"min_faves_rostered": -1}}}': ["min_faves_rostered clamped"],
        '{"sources": {"a": {"keep_nodes": []}, "b": {"drop_nodes": [1]}, "c": 4}}': ["b.drop_nodes no list of strings"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "config string")
    assert {r["config"]: r["e"] for r in df.select("config", gate.setting_errors(F.col("config")).alias("e")).collect()} == cases


def test_top_offenders_keep_the_best_and_break_ties_by_the_greater_id(spark):
    words = " ".join(f"word{chr(97 + i)}" for i in range(12))
    docs = spark.createDataFrame([(1, words), (2, "too short"), (3, None)], "doc_id int, text string")
    refs = spark.createDataFrame([("a", words), ("b", words), ("c", " ".join(words.split()[:9])), ("d", "")], "item_id string, text string")
    assert [tuple(r) for r in guards.top_offenders(docs, refs, most=2).orderBy(F.desc("n"), F.desc("item_id")).collect()] == [(1, "b", 5), (1, "a", 5)]
