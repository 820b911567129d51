"""Exemptions, replays, shards, shared state, lanes, the ledger's table, encodings and the pulse stream, on hand-made rows."""

import datetime as dt
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import aliases
from tidewatch.functions import text as T
from tidewatch.operators import dedup, grants, privacy, replay, rings, yields
from tidewatch.plans import matching
from tidewatch.sources import binaries, ledger, shards
from tidewatch.streaming import lanes, pulse, state
from tidewatch.streaming.keyvalue import Conflict, StateTable

UTC = dt.timezone.utc


def at(day, hour=0, second=0):
    return dt.datetime(2026, 6, 1, tzinfo=UTC) + dt.timedelta(days=day - 1, hours=hour, seconds=second)


FINDING = "finding long, token string, domain string, repo string, path string, at timestamp"
GRANT = "pos long, token string, scope string, repo string, prefix string, expires timestamp"


def test_most_specific_grant_wins(spark):
    held = [
        (1, "Acme", "all", None, None, None), (2, "acme", "history-only", "r1", "docs", None), (3, "acme", "all", "r1", "docs/old/", at(10)), (4, "acme", "history-only", None, "src", None),
        (5, "beta", "history-only", None, None, None), (6, "gone", "all", None, None, at(1)), (7, "never", "all", None, None, None),
    ]
    rows = [
        (10, "ACME", "tree", "r1", "docs/old/a.md", at(5)), (11, "acme", "tree", "r1", "docs/old/a.md", at(10)), (12, "acme", "history", "r1", "docs/b.md", at(5)), (13, "acme", "tree", "r2", "src/x", at(5)), (14, "acme", "tree", None, None, None),
        (15, "beta", "staged", "r1", "docs", at(5)), (16, "beta", "history", "r1", "docs", at(5)), (17, "gone", "tree", "r1", "a", at(1)), (18, "gone", "tree", "r1", "a", at(0)), (19, None, "tree", "r1", "a", at(1)), (20, "acme", None, "r1", "a", at(1)), (21, "acme", "tree", "r1", "docsx/y", at(5)),
    ]
    f, g = spark.createDataFrame(rows, FINDING).repartition(3), spark.createDataFrame(held, GRANT)
    got = {r["finding"]: r["grant_pos"] for r in grants.granted(f, g).collect()}
    assert got == {10: 3, 11: 1, 12: 2, 13: 1, 14: 1, 15: None, 16: 5, 17: None, 18: 6, 19: None, 20: None, 21: 1}
    uses = {r["pos"]: (r["suppressed"], r["live_collisions"]) for r in grants.grant_uses(f, g).collect()}
    # 2 meets 11 in the tree before 1 suppresses it, but 10 only behind 3; 4 meets 13
    assert uses == {1: (4, 0), 2: (1, 1), 3: (1, 0), 4: (0, 1), 5: (1, 1), 6: (1, 0), 7: (0, 0)}
    assert tuple(grants.grant_receipt(f, g).first()) == (7, 5, 2, 3, 3)
    assert tuple(grants.grant_receipt(f, g.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert grants.granted(f.limit(0), g).collect() == []


def test_grants_against_all_pairs(spark):
    """Many grants on a few keys, against the rule pair by pair; what is joined grows with the findings, not with findings times grants."""
    rng = random.Random(3)
    time = lambda d: None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    f = [(i, rng.choice(["A", "b", None]), rng.choice(["history", "tree", None]), rng.choice(["r", "s", None]), rng.choice(["x/y/f", "x/z", "", None]), time(rng.choice([None, *range(12)]))) for i in range(150)]
    g = [(100 + i, rng.choice(["a", "B"]), rng.choice(["all", *["history-only"] * 3, "none"]), rng.choice(["r", "q", None]), rng.choice(["x", "x/y/", "", None]), time(rng.choice([None, *range(12)]))) for i in rng.sample(range(1000), 60)]
    best, used, ran = {}, dict.fromkeys((r[0] for r in g), 0), dict.fromkeys((r[0] for r in g), 0)
    for i, token, domain, repo, path, at in f:
        met = []
        for pos, t, scope, r, prefix, expires in g:
            head = (prefix or "").strip("/")
            if token and domain and token.lower() == t.lower() and r in (None, repo) and (not head or f"{path or ''}/".startswith(f"{head}/")) and (expires is None or at is None or at < expires):
                met.append(((r is None, -len([p for p in head.split("/") if p]), pos), pos, scope == "all" or (scope == "history-only" and domain == "history")))
        first = min((m[0] for m in met if m[2]), default=None)
        best[i] = first and first[2]
        for rank, pos, applies in met:
            used[pos] += applies and rank == first
            ran[pos] += not applies and (first is None or rank < first)
    findings = spark.createDataFrame(f, "finding long, token string, domain string, repo string, path string, at timestamp")
    held = spark.createDataFrame(g, "pos long, token string, scope string, repo string, prefix string, expires timestamp")
    assert {r["finding"]: r["grant_pos"] for r in grants.granted(findings, held).collect()} == best
    assert {r["pos"]: (r["suppressed"], r["live_collisions"]) for r in grants.grant_uses(findings, held).collect()} == {p: (used[p], ran[p]) for p in used}
    few = held.unionByName(held.withColumn("pos", F.col("pos") + 10_000)).unionByName(held.withColumn("pos", F.col("pos") + 20_000))
    assert grants._met(findings, grants._spans(grants._held(few))).count() == grants._met(findings, grants._spans(grants._held(held))).count()


def test_cross_repo_tokens(spark):
    rows = [
        ("a", "tool", False), ("a", "tool-data", True), ("a", "tool-secrets", True), ("b", "tool-data", True), ("a", "notes", True), ("a", "two-part_name", True), ("a", "mine-config", True), ("a", "mine-hidden-thing", True), ("c", "tool-data", True), ("a", "x-y", True), ("a", None, True), ("a", "a-b-c", False),
    ]
    repos = spark.createDataFrame(rows + rows[:2], "owner string, name string, private boolean")
    got = {r["token"]: (r["kind"], r["owner"], r["witness"]) for r in privacy.cross_repo_tokens(repos, "mine", 30).collect()}
    assert got == {"tool-data": ("linkage", "b", None), "tool-secrets": ("derived", "a", "tool"), "two-part_name": ("linkage", "a", None), "mine-hidden-thing": ("linkage", "a", None)}
    old = {r["token"]: r["kind"] for r in privacy.cross_repo_tokens(repos, None, 31).collect()}
    assert set(old.values()) == {"linkage"} and "mine-config" in old
    assert privacy.cross_repo_tokens(repos, "mine", None).collect() == []


def test_replay_sees_nothing_from_after_a_checkpoint(spark):
    """All checkpoints at once against one run at a time."""
    ev = [(i % 7, at(1 + i % 29, i % 24), "handle", f"h{i % 5}", i % 3 == 0, float(i % 50), "t") for i in range(200)] + [(99, None, "handle", "h0", True, 1.0, "t")]
    ev = spark.createDataFrame(ev, "opp_id long, ts timestamp, kind string, name string, pushed boolean, faves double, track string")
    p = spark.createDataFrame([("handle", f"h{i % 6}", at(1 + i % 29), 1) for i in range(150)] + [("source", "s", at(8), 1)], "kind string, name string, ts timestamp, kept int")
    times = replay.checkpoints("2026-06-08", "2026-06-29")
    got = {(r["checkpoint"].replace(tzinfo=UTC), r["kind"], r["name"]): (r["contributions"], r["pulls"], r["yield"]) for r in replay.replay_yields(ev, p, times, 10).collect()}
    roster = spark.createDataFrame([(f"h{i}", i != 3) for i in range(7)], "name string, enabled boolean")
    pruned = {r["name"]: r["disabled_at"].replace(tzinfo=UTC) for r in replay.replay_prunes(roster, ev, p, times, 1, 4, 1.0).collect()}
    want, first = {}, {}
    for day in (8, 15, 22, 29):
        now = at(day)
        lit = lambda t: F.lit(t.replace(tzinfo=None)).cast("timestamp")
        one = yields.ratios(yields.numerator(ev, lit(now - dt.timedelta(days=10)), lit(now)), yields.denominator(p, lit(now - dt.timedelta(days=10)), lit(now)))
        want |= {(now, r["kind"], r["name"]): (r["contributions"], r["pulls"], r["yield"]) for r in one.collect()}
        spared = ev.filter(yields.window_of(F.col("ts"), lit(now - dt.timedelta(days=30)), lit(now)) & (F.col("faves") < 1)).select("name").distinct()
        weeks = yields.weekly(p.filter("kind = 'handle'").filter(F.col("ts") < lit(now)), ev.filter(F.col("ts") < lit(now)), lit(now), 1)
        for r in yields.prune(roster, weeks, spared, 4).collect():
            first.setdefault(r["name"], now)
    assert got == want and pruned == first and pruned


def test_last_known(spark):
    rows = [("a", at(8), 1), ("a", at(8, 0, 1), 2), ("a", at(20), 3), ("b", at(30), 4), ("c", at(1), None), (None, at(9), 5), ("d", None, 6)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int")
    got = {(r["k"], r["checkpoint"].day): r["v"] for r in replay.last_known(df, "k", "ts", replay.checkpoints("2026-06-08", "2026-06-29"), ["v"]).collect()}
    assert got == {("a", 8): 1, ("a", 15): 2, ("a", 22): 3, ("a", 29): 3, **{("c", d): None for d in (8, 15, 22, 29)}, (None, 15): 5, (None, 22): 5, (None, 29): 5}


def test_ring_buffers_merge(spark):
    rows = [(f"k{i % 2}" if i < 300 else "hot", at(1, 0, i), i) for i in range(2000)] + [(None, at(1), 0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int").repartition(4)
    whole = {r["k"]: [s["v"] for s in r["samples"]] for r in rings.ring_buffer(df, "k", ["ts"], ["v"]).collect()}
    assert whole == {"k0": [*range(240, 300, 2)], "k1": [*range(241, 300, 2)], "hot": [*range(1970, 2000)], None: [0]}
    a, b = (rings.ring_buffer(df.filter(f"v % 3 {op} 0"), "k", ["ts"], ["v"]) for op in ("=", "<>"))
    assert {r["k"]: [s["v"] for s in r["samples"]] for r in rings.merge_rings(a, b, "k").collect()} == whole
    plan = rings.ring_buffer(df, "k", ["ts"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle
    assert rings.ring_buffer(df.limit(0), "k", ["ts"], ["v"]).collect() == []


def test_month_shards(spark, tmp_path):
    folder = tmp_path / "pulls"
    folder.mkdir()
    for month in range(1, 13):
        line = {"run_id": f"m{month}", "ts": f"2026-{month:02d}-20T00:00:00Z", "kept": 1}
        if month == 6:  # a shard of other fields
            line = {"ts": "2026-06-20T00:00:00Z", "handle": "h", "extra": [1]}
        (folder / f"pulls-2026-{month:02d}.jsonl").write_text(json.dumps(line) + "\nnot json\n")
    rows = shards.read_window(spark, str(folder), at(1), at(30))
    assert [(r["run_id"], r["handle"], r["ym"]) for r in rows.collect()] == [(None, "h", "2026-06")]
    assert [f.rsplit("/", 1)[1] for f in rows.inputFiles()] == ["pulls-2026-06.jsonl"]
    two = shards.read_window(spark, str(folder), at(25), at(52))
    assert len(two.inputFiles()) == 2 and [r["run_id"] for r in two.collect()] == ["m7"]
    assert shards.read_window(spark, str(folder / "none"), at(1), at(2)).collect() == []
    assert shards.months(dt.datetime(2025, 12, 31), dt.datetime(2026, 2, 1)) == ["2025-12", "2026-01"] and shards.months(at(1), at(1)) == []
    shards.write_shards(rows.drop("ym", "file"), str(tmp_path / "out"))
    assert shards.read_window(spark, str(tmp_path / "out"), at(1), at(30)).count() == 1


def test_alias_fields(spark):
    bodies = {
        '{"likes": 5, "likeCount": 2}': (2.0, True), '{"likeCount": true, "likes": 7}': (7.0, True), '{"likeCount": "3"}': (0.0, True), '{"like_count": 12.5}': (12.5, False), '{"faves": false}': (0.0, True), '{"likeCount": null, "faves": 11}': (11.0, False),
        '{"favorite_count": 1}': (0.0, True), "{}": (0.0, False), "[1]": (0.0, False), '{"likes": "many"}': (0.0, False), '{"likes": 1e400}': (float("inf"), False), '{"faves": [1]}': (0.0, False),
    }
    df = spark.createDataFrame([(b,) for b in bodies], "b string").withColumn("v", F.try_parse_json("b"))
    got = {r["b"]: (r["n"], r["low"]) for r in df.select("b", aliases.first_number(F.col("v"), aliases.FAVES).alias("n"), aliases.any_below(F.col("v"), aliases.ENGAGEMENT, 10).alias("low")).collect()}
    assert got == bodies


def test_encodings(spark, tmp_path):
    text = "Grüße, naïve – café\r\n" * 40
    files = {
        "a.txt": (text.encode(), "utf-8"), "b.txt": (text.encode("utf-16"), "utf-16"), "c.txt": (b"plain ascii".decode().encode("utf-16-le"), "utf-16"), "d.txt": ("Größe".encode("cp1252"), "cp1252"), "e.txt": (b"", "empty"),
        "f.png": (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\xff\xd8" * 9, None), "g.bin": (bytes(range(128, 256)) + b"\x00", None), "h.bin": (b"\x89\x01\x02\x03" * 50, None), "i.txt": (b"one\x00" + b"x" * 99, "utf-8"), "j.txt": ("Ā0ā1".encode(), "utf-8"),
    }
    (tmp_path / "sub").mkdir()
    for name, (data, _) in files.items():
        (tmp_path / ("sub" if name < "c" else ".") / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in binaries.read_texts(spark, str(tmp_path)).collect()}
    assert {n: r["encoding"] for n, r in got.items()} == {n: e for n, (_, e) in files.items() if n != "e.txt"}  # the reader leaves out files of no bytes
    assert binaries.decoded(b"") == ("", "empty")
    assert got["a.txt"]["text"] == got["b.txt"]["text"] == text and got["c.txt"]["text"] == "plain ascii" and got["d.txt"]["text"] == "Größe"
    assert got["i.txt"]["text"] == "one\x00" + "x" * 99 and got["f.png"]["text"] is None
    assert tuple(spark.sql("SELECT cast(null AS binary) AS b").select(binaries.decode(F.col("b")).alias("d")).select("d.*").first()) == (None, None)


def test_state_table_compare_and_set(spark, tmp_path):
    path = str(tmp_path / "state")
    a, b = StateTable(spark, path, keep=2), StateTable(spark, path, keep=2)
    assert a.snapshot() == (0, {}) and a.get("x", 7) == 7
    version, values = a.snapshot()
    b.put("n", 1)
    with pytest.raises(Conflict):
        a.commit(version, values | {"n": 9})
    assert a.get("n") == 1
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda t: [t.update(lambda v: v | {"n": v["n"] + 1}, tries=50) for _ in range(4)], (a, b)))
    assert a.get("n") == 9 and a.snapshot()[0] == 9
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v=000000000008", "v=000000000009"]
    for p in (tmp_path / "state" / "v=000000000009").glob("*.parquet"):
        p.write_bytes(b"broken")
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    assert b.get("n", "none") == "none"  # state that can't be read is empty
    b.put("n", 5)
    assert a.get("n") == 5


def test_a_number_that_was_taken_and_deleted_is_a_conflict(spark, tmp_path):
    a, b = (StateTable(spark, str(tmp_path / "state"), keep=2) for _ in range(2))
    version, values = a.snapshot()
    for i in range(4):
        b.put("n", i)
    with pytest.raises(Conflict):
        a.commit(version, values | {"n": 9})
    assert a.get("n") == 3 and a.update(lambda v: v | {"m": v["n"]}) == {"n": 3, "m": 3}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v=000000000004", "v=000000000005"]


def test_watermark_waits_for_all_lanes(spark, tmp_path, monkeypatch):
    runs = lanes.LaneRuns(spark, str(tmp_path))
    asked = []

    def lane(since):
        asked.append(since)
        return spark.createDataFrame([(len(asked),)], "n int")

    def broken(since):
        raise OSError("no answer")

    assert runs.watermark() is None and runs.table("a") is None
    assert runs.run("r1", at(1), {"a": lane, "b": broken})["b"].startswith("OSError")
    assert runs.watermark() is None and runs.table("a") is None  # what lane a wrote is not seen
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):  # a crash between the lanes and the commit
        m.setattr(lanes.LaneRuns, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        runs.run("r1", at(2), {"a": lane, "b": lane})
    assert runs.watermark() is None and runs.table("a") is None
    assert runs.run("r1", at(2), {"a": lane, "b": lane}) == {"a": "ok", "b": "ok"}
    assert runs.watermark() == at(2) and runs.table("a").count() == 1 and asked == [None] * 5
    n = len(asked)
    assert runs.run("r1", at(9), {"a": lane, "b": lane}) == {"a": "ok", "b": "ok"} and len(asked) == n and runs.watermark() == at(2)
    runs.run("r2", at(1), {"a": lane})
    assert asked[-1] == at(2) - lanes.OVERLAP and runs.watermark() == at(2)  # never back
    assert runs.table("a").count() == 2


def test_late_rows_stay_late_when_a_batch_is_replayed(spark, tmp_path):
    runs = lanes.LaneRuns(spark, str(tmp_path / "runs"))
    df = spark.createDataFrame([(1, at(1)), (2, at(5)), (3, at(7)), (4, None)], "i int, ts timestamp")
    on_time, late = lanes.split_late(df, at(5))
    assert sorted(r["i"] for r in on_time.collect()) == [2, 3, 4] and [r["i"] for r in late.collect()] == [1]
    assert lanes.split_late(df, None)[0].count() == 4
    runs.run("a", at(5), {})
    write = lanes.late_writer(runs, str(tmp_path / "rows"))
    write(df, 0)
    runs.run("b", at(9), {})
    write(df, 0)  # replayed: the bar is what it was
    write(df, 1)
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert {(r["batch"], r["when"]): r["n"] for r in got.groupBy("batch", "when").agg(F.count("*").alias("n")).collect()} == {(0, "late"): 1, (0, "on_time"): 3, (1, "late"): 3, (1, "on_time"): 1}
    assert runs.state.get("batch:1") == {"last_run": at(9).isoformat(), "on_time": 1, "late": 3}


def row(key, day, score, cluster="", source="s", push=0, text="t"):
    return (key, f"op-{key}", cluster, None, at(day), at(day), score, "peak", push, [source], 1, text, [text], [(at(day), score, source)])


def test_ledger_table(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path), buckets=8, keep=2)
    frame = lambda *rows: spark.createDataFrame([*rows], ledger.ROW)
    assert book.rows().collect() == []
    assert book.merge(frame(row("a", 1, 10.0, "c1", "x", 1), row("a", 3, 30.0, "", "y", 1, "u" * 500), row("b", 2, 5.0)), 0)
    first = {r["canonical_key"]: r for r in book.rows().collect()}
    a = first["a"]
    assert (a["cluster_id"], a["push_count"], a["last_score"], a["source_set"], len(a["text"]), a["first_seen"].day, [s["score"] for s in a["samples"]]) == ("c1", 2, 30.0, ["x", "y"], 400, 1, [10.0, 30.0])
    files = lambda: {f.split("/data/")[1].split("/part")[0] for f in book.rows().inputFiles()}
    before = files()
    assert book.merge(frame(row("b", 4, 6.0, "c2")), 1)
    assert len(files() - before) == 1 and len(files()) == len(before)  # one bucket written anew
    assert not book.merge(frame(row("b", 5, 7.0)), 1)  # a replay
    # a crash before the commit: the folder is there, the manifest is not, and the batch is sent again
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(book.manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        book.merge(frame(row("c", 6, 1.0)), 2)
    assert "c" not in {r["canonical_key"] for r in book.rows().collect()}
    assert book.merge(frame(row("c", 6, 1.0), *[row("b", 6 + i % 3, float(i)) for i in range(40)]), 2)
    got = {r["canonical_key"]: r for r in book.rows().collect()}
    assert len(got) == 3 and len(got["b"]["samples"]) == 30 and got["b"]["cluster_id"] == "c2" and got["a"] == a
    for n in range(3, 7):
        book.merge(frame(row("b", 20 + n, 1.0)), n)
    left = {p.name for p in (tmp_path / "data").iterdir()}
    assert len(left) <= 4 and {r["canonical_key"] for r in book.rows().collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        ledger.Ledger(spark, str(tmp_path), buckets=4).merge(frame(row("z", 1, 1.0)), 99)


def test_ledger_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([row("a", d, float(d), push=1) for d in range(1, 7)], ledger.ROW).repartition(3).write.parquet(src)
    book = ledger.Ledger(spark, str(tmp_path / "ledger"), buckets=4)
    state.run_available(state.read_events(spark, src, ledger.ROW, files=1), ledger.ledger_sink(book), str(tmp_path / "ck"))
    (got,) = book.rows().collect()
    assert (got["push_count"], got["last_score"], len(got["samples"])) == (6, 6.0, 6)


def test_pulse_state_lapses_at_fourteen_days(spark, tmp_path):
    pulse.use_state_store(spark)
    src, got = str(tmp_path / "items"), []
    batches = [
        [("a", at(1)), ("b", at(1)), ("a", at(1, 1)), (None, at(1)), ("c", None)],
        [("a", at(15)), ("b", at(15, 0, 1)), ("a", at(14))],  # fourteen days to the instant still hides; a second more shows
        [("a", at(15, 0, 1)), ("far", at(60))],
        [("b", at(61)), ("far", at(61))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "pulse_key string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = pulse.pulse_branches(spark.readStream.schema("pulse_key string, ts timestamp").parquet(src))
        state.run_available(stream, lambda df, n: got.extend((r["pulse_key"], r["ts"].replace(tzinfo=UTC), r["branch"]) for r in df.collect()), str(tmp_path / "ck"))
    show = sorted((k, t) for k, t, b in got if b == "SHOW")
    assert show == sorted([("a", at(1)), ("b", at(1)), ("b", at(15, 0, 1)), ("a", at(15, 0, 1)), ("far", at(60)), ("b", at(61))])
    assert sorted((k, t) for k, t, b in got if b == "HIDE") == sorted([("a", at(1, 1)), ("a", at(14)), ("a", at(15)), ("far", at(61))])
    held = spark.read.format("statestore").option("stateVarName", "shown").load(str(tmp_path / "ck"))
    assert {r["key"][0] for r in held.collect()} == {"b", "far"}  # a's state has gone


def test_equal_rows_are_matched_once(spark):
    """1,200 equal candidates against 1,200 equal ledger rows meet as one pair, and all of them get the last row."""
    facts = ("ents array<string>, track string, toks array<string>, simhash long, canonical_key string")
    same = (["alpha", "beta"], "t", ["alpha", "beta", "gamma", "delta"], 7)
    cands = spark.createDataFrame([(i, *same, f"c{i}") for i in range(1200)], f"cand_id long, {facts}")
    book = spark.createDataFrame([(i, *same, f"r{i}", "text") for i in range(1200)], f"pos long, {facts}, text string")
    got = dedup.matches(cands, book).collect()
    assert len(got) == 1200 and {(r["row_pos"], r["how"]) for r in got} == {(1199, "soft")}
    one = lambda df, key: df.groupBy(*dedup.FACTS).agg(F.first(key).alias("k")).select(F.col("k").alias("lid"), "toks")
    assert dedup.similar_pairs(one(cands, "cand_id"), one(book, "pos").withColumnRenamed("lid", "rid"), 0.83).count() == 1
    plan = dedup.matches(cands, book)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 6


def test_votes_in_slices(spark):
    from hashlib import md5

    import pandas as pd

    lists = [["alpha", "beta", "agents", "the", ""], [], None, ["agent"] * 7, [f"w{i % 90}" for i in range(1000)], ["", "the"]]

    def plain(x):
        kept = [{"agents": "agent"}.get(t, t) for t in x or [] if t not in ("", "the")]
        hashes = [int.from_bytes(md5(t.encode()).digest()[:8], "big") for t in kept]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    for most in (3, 64, 1 << 18):
        assert T._majority(pd.Series(lists), most).tolist() == [plain(x) for x in lists]


def test_history_and_proposals(spark):
    p = spark.createDataFrame([(at(3),), (None,)], "ts timestamp")
    e = spark.createDataFrame([(at(1),)], "ts timestamp")
    now = F.lit("2026-06-10").cast("timestamp")
    days = lambda a, b: yields.history_days(a, b, now).first()["days"]
    assert (days(p, e), days(p.limit(0), e), days(p.limit(0), e.limit(0)), days(spark.createDataFrame([(at(20),)], "ts timestamp"), e)) == (7.0, 9.0, 0.0, 0.0)
    found = [(1, "new", "a", 2, "u2"), (2, "new", "b", 1, " "), (3, "new", "b", 3, "u3"), (1, "old", "a", 1, "u"), (1, "once", "a", 1, "u"), (1, "bare", "a", 1, None), (2, "bare", "a", 2, None)]
    df = spark.createDataFrame(found, "opp_id long, name string, track string, pos long, url string")
    got = {r["name"]: (r["n_opps"], r["tracks"], r["sample_url"]) for r in yields.propose(df, spark.createDataFrame([("old",)], "name string")).collect()}
    assert got == {"new": (3, "a,b", "u2"), "bare": (2, "a", None)}
    sets = yields.sets_compared(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "name string"), spark.createDataFrame([("b",), ("c",), (None,)], "name string"))
    assert sorted((str(r["name"]), *r[1:]) for r in sets.collect()) == [("None", True, False, False), ("a", False, False, True), ("b", True, False, False), ("c", False, True, False)]


def test_frequent_entities_make_no_pairs(spark):
    """Rows that share entities and track but not their texts don't meet; what does match is found, against the rule pair by pair."""
    facts = "ents array<string>, track string, toks array<string>, simhash long"
    row = lambda side, i: (i, ["alpha", "beta"], "t", [f"{side}{i}", "alpha", "beta", *[f"{side}{i}x{j}" for j in range(20)]], ((i + 1000 * len(side)) * 0x9E3779B97F4A7C15) % (1 << 62))
    left, right = (spark.createDataFrame([row(s, i) for i in range(1, 60)], f"{k} long, {facts}") for s, k in (("c", "lid"), ("rr", "rid")))
    assert dedup._soft_pairs(left, right).count() == 0
    rng = random.Random(6)

    def some(n):
        out = []
        for i in range(n):
            toks = rng.sample("abcdefghijkl", rng.choice([0, 1, 2, 3, 4, 6, 9]))
            out.append((i, toks[:3], rng.choice("xy"), toks, rng.choice([0, -1, 5, 1 << 63 - 1]) ^ rng.choice([0, 1, 3, 7, 15, 1 << 40])))
        return out

    c, r = some(120), some(120)
    want = {}
    for i, ents, track, toks, h in c:
        for pos, e2, t2, k2, g in r:
            a, b = set(toks), set(k2)
            sim = len(a & b) / len(a | b) if a and b else 0.0
            shared = len({*ents} & {*e2})
            subject = not a or not b or a <= b or b <= a or toks[0] == k2[0]
            near = g != 0 and bin((h ^ g) & (1 << 64) - 1).count("1") <= 3
            if sim >= 0.83 or ((shared >= 2 or (shared >= 1 and track == t2)) and subject and (near or sim >= 0.45)):
                want[i] = max(want.get(i, (-1, -1)), (sim, pos))
    cands, book = spark.createDataFrame(c, f"cand_id long, {facts}"), spark.createDataFrame([(*x, "text") for x in r], f"pos long, {facts}, text string")
    assert {x["cand_id"]: (x["similarity"], x["row_pos"]) for x in dedup.soft_matches(cands, book).collect()} == want


def test_a_family_of_near_copies_makes_no_table_of_pairs(spark, monkeypatch):
    """Rows of one first token that all match are judged where they meet, over a grid of slices; the answers are those of all pairs."""
    facts = "ents array<string>, track string, toks array<string>, simhash long"
    rng = random.Random(4)
    some = lambda side: [["alpha", *rng.sample([f"s{i}" for i in range(40)], 34), *[f"{side}{i}x{j}" for j in range(9)]] for i in range(150)]
    mine, book = some("c"), some("r")
    left, right = (spark.createDataFrame([(i, x[:8], "t", x, 1 << i % 60) for i, x in enumerate(rows)], f"{k} long, {facts}") for rows, k in ((mine, "lid"), (book, "rid")))
    assert dedup._soft_pairs(left, right).count() == 0  # 22,500 when pairs were listed first
    want = {}
    for i, a in enumerate(mine):
        for pos, b in enumerate(book):
            sim, shared = len({*a} & {*b}) / len({*a} | {*b}), len({*a[:8]} & {*b[:8]})
            if shared and (sim >= 0.45 or bin(1 << i % 60 ^ 1 << pos % 60).count("1") <= 3):
                want[i] = max(want.get(i, (-1, -1)), (sim, pos))
    cands, ledger_rows = left.withColumnRenamed("lid", "cand_id"), right.withColumnRenamed("rid", "pos").withColumn("text", F.lit("text"))
    for most in (dedup.SLICE, 40):
        monkeypatch.setattr(dedup, "SLICE", most)
        assert {x["cand_id"]: (x["similarity"], x["row_pos"]) for x in dedup.soft_matches(cands, ledger_rows).collect()} == want


def test_branch_lists_no_pairs_of_one_first_token(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    text = lambda i: " ".join(["alpha", *rng.sample([f"word{j}" for j in range(20)], 16), f"own{i}"])
    spark.createDataFrame([(i, text(i), "en", "web", i) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    held, plain = {}, dedup.kept
    monkeypatch.setattr(dedup, "kept", lambda df, name: held.update({name: plain(df, name)}) or held[name])
    rows = matching.q_branch(spark, str(tmp_path)).collect()
    assert len(rows) == 40 and all(r["branch"] != "NEW" for r in rows)
    assert held["ledger-pairs"].count() == 0  # 1,600 when pairs were listed first
