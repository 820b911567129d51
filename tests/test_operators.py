import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import bandit, dedup, guards, pulse, yields
from tidewatch.sources import feeds, sinks

T0 = dt.datetime(2026, 6, 25, 12, tzinfo=dt.timezone.utc)


def ledger(spark, rows):
    df = spark.createDataFrame(rows, "id long, title string, track string")
    df = df.select("id", F.col("title").alias("text"), "track", T.entities(F.col("title"), 8).alias("ents"), T.entities(F.col("title"), 64).alias("toks"))
    return df.join(T.simhash64(df, "id", F.col("text")), "id").withColumn("canonical_key", T.canonical_key(F.col("ents"), F.col("track")))


def test_matching(spark):
    old = ledger(spark, [
        (0, "Stripe launches hosted billing portal for vertical marketplaces", "saas"), (1, "MinerU parses scientific documents into markdown", "ai"),
        (2, "MinerU parses scientific documents into markdown", "ai"), (3, "", "ai"),
    ]).withColumnRenamed("id", "pos")
    new = ledger(spark, [
        (10, "Adyen launches hosted billing portal for vertical marketplaces", "saas"), (11, "MinerU parses scientific documents into markdown", "ai"),
        (12, "MinerU parses scientific documents into markdown tables quickly, benchmarks", "ai"), (13, "Completely unrelated gardening robots", "hw"),
    ]).withColumnRenamed("id", "cand_id")
    got = {r["cand_id"]: (r["row_pos"], r["how"]) for r in dedup.matches(new, old).collect()}
    assert got == {11: (1, "exact"), 12: (2, "soft")}  # the first row by key, the last of equals by similarity


def test_branch(spark):
    df = spark.createDataFrame([
        (False, "peak", None, 60.0, None, ["a"], []), (True, "peak", "emerging", 60.0, 60.0, ["a"], ["a"]), (True, "", "peak", 61.0, 60.0, ["a"], ["a"]),
        (True, "peak", "peak", 75.0, 60.0, ["a"], ["a"]), (True, "peak", "peak", 60.0, 60.0, ["a", "b"], ["a"]), (True, "peak", "peak", 60.0, 60.0, ["a", "b", "c"], ["a", "b"]),
    ], "m boolean, s string, ps string, c double, pc double, src array<string>, psrc array<string>")
    got = [r[0] for r in df.select(dedup.branch(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["NEW", "RESURFACE", "SUPPRESS", "RESURFACE", "RESURFACE", "SUPPRESS"]


def test_ring_buffer(spark):
    row = spark.range(1).select(dedup.fold_samples(F.sequence(F.lit(1), F.lit(30)), F.array(F.lit(31), F.lit(32))).alias("a"), dedup.fold_samples(F.array(F.lit(1)), F.array(F.lit(2))).alias("b")).first()
    assert row["a"] == [*range(3, 33)] and row["b"] == [1, 2]


def test_week_buckets(spark):
    now = F.lit("2026-06-25 12:00:00").cast("timestamp")
    times = ["2026-06-25 12:00:00", "2026-06-25 11:59:59.999999", "2026-06-18 12:00:00", "2026-06-18 11:59:59.999999"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(yields.week_bucket(F.col("t").cast("timestamp"), now)).collect()]
    assert got == [-1, 0, 0, 1]


def test_six_actor_replay(spark):
    """Who is pruned at each weekly pass: a dead handle first, one that faded later, nobody else."""
    day = lambda n, h: T0.replace(hour=h) + dt.timedelta(days=n)
    cards = {"steady": [4, 11, 18, 25, 32, 39, 46], "fader": [4, 11], "ghost": [10], "newcomer": [15, 18, 21, 24, 28, 31, 35, 38, 42, 45]}
    kept = lambda who, d: {"steady": 3, "dead": 0, "fader": 2 if d <= 11 else 0}[who]
    ev = spark.createDataFrame([(f"{w}-{d}", day(d, 9), w, "t") for w, ds in cards.items() for d in ds], "opp_id string, ts timestamp, name string, track string").cache()
    pl = spark.createDataFrame([(w, day(d, 8), kept(w, d)) for w in ("steady", "dead", "fader") for d in range(49)], "name string, ts timestamp, kept int").cache()
    roster = spark.createDataFrame([("steady", True), ("dead", True), ("fader", True), ("ghost", True)], "name string, enabled boolean")
    out, pruned, proposed = [], set(), []
    for d in (6, 13, 20, 27, 34):
        now = F.lit(day(d, 12).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        e, p = ev.filter(F.col("ts") < now), pl.filter((F.col("ts") < now) & ~F.col("name").isin([*pruned, ""]))
        weeks = yields.weekly(p, e, now, 2)
        recent = p.filter(F.col("ts") >= now - F.expr("INTERVAL 14 DAYS")).groupBy("name").agg(F.sum("kept").alias("k")).filter("k > 0").select("name")
        gone = sorted(r["name"] for r in yields.prune(roster, weeks, recent).collect() if r["name"] not in pruned)
        pruned |= {*gone}
        out.append(gone)
        proposed.append({r["name"]: r["n_opps"] for r in yields.propose(e, roster).collect()})
    assert out == [[], ["dead"], [], ["fader"], []]
    assert [p.get("newcomer") for p in proposed[:3]] == [None, None, 2]


def test_ratio_is_null_without_pulls(spark):
    up = spark.createDataFrame([("handle", "a", 2, 1, 1), ("handle", "b", 2, 0, 0)], "kind string, name string, contributions long, pushed long, pre_viral long")
    down = spark.createDataFrame([("handle", "a", 4, 2), ("handle", "c", 1, 0)], "kind string, name string, pulls long, kept long")
    assert {r["name"]: r["yield"] for r in yields.ratios(up, down).collect()} == {"a": 0.5, "b": None, "c": 0.0}


def test_identity_flags(spark):
    roster = spark.createDataFrame([("A",), ("b",), ("c",), ("d",)], "name string")
    sweep = spark.createDataFrame([("A", "a", 5), ("b", "bb", 5), ("c", None, None), ("x", "x", 1)], "name string, found_name string, posts int")
    assert {tuple(r) for r in yields.identity_flags(roster, sweep).collect()} == {("b", "drift"), ("c", "dead")}


def test_missed_dates(spark):
    days = lambda last: [str(d) for d in spark.range(1).select(yields.missed_dates(F.lit(last).cast("date"), F.lit("2026-06-25").cast("date"), 3)).first()[0]]
    assert days("2026-06-24") == ["2026-06-25"] and days("2026-06-25") == [] and len(days("2020-01-01")) == 3


def test_bandit(spark):
    arms = spark.createDataFrame([("a", 2.0, float("nan"), 3)], "track string, alpha double, beta double, n long")
    seen = spark.createDataFrame([("a", 1.0), ("b", 0.25), ("b", 0.25)], "track string, reward double")
    got = {r["track"]: tuple(r)[1:] for r in bandit.fold_rewards(arms, seen).collect()}
    assert got["b"] == (1.5, 2.5, 2) and got["a"][0] == 3.0 and got["a"][2] == 4
    drawn = bandit.fold_rewards(arms, seen).withColumn("theta", bandit.draw("s", F.col("track"), F.col("alpha"), F.col("beta")))
    assert [r["theta"] for r in drawn.orderBy("track").collect()] == [r["theta"] for r in drawn.orderBy("track").collect()]


def test_redaction():
    text = "mail bob@host.com or bob@host.com, call +1 415 555 0132, card 4111 1111 1111 1111, see https://x.com/a/status/1234567890123456789 by @ann 2020-2026"
    red, found = guards.redact_text(text, guards.EGRESS)
    assert "[EMAIL_1] or [EMAIL_1]" in red and "[CARD_1]" in red and "[PHONE_1]" in red and "https://x.com/a/status/1234567890123456789 by @ann 2020-2026" in red
    assert found == {"EMAIL": 2, "CARD": 1, "PHONE": 1}
    assert guards.redact_text("plain　text 2019 2020 2021", guards.EGRESS) == ("plain　text 2019 2020 2021", {})
    assert guards.redact_text("bob@host。com")[0] == "[EMAIL_1]"
    assert guards.redact_text(None) == ("", {})


def test_dashes(spark):
    fix = lambda s: spark.createDataFrame([(s,)], "s string").select(guards.fix_dashes(guards.fix_table_row(F.col("s")))).first()[0]
    assert fix("one thing — another") == "one thing, another"
    assert fix("pages 3–5") == "pages 3 to 5"
    assert fix("goes on —") == "goes on,"
    assert fix("— opens") == "opens"
    assert fix("| a | — | b |") == "| a | none | b |"


def test_severity_and_paths(spark):
    rows = spark.createDataFrame([("secret", "history"), ("linkage", "history"), ("linkage", "tree"), ("derived", "tree")], "k string, d string")
    assert [r[0] for r in rows.select(guards.severity(F.col("k"), F.col("d"))).collect()] == ["BLOCK", "DEBT", "BLOCK", "WARN"]
    shape = lambda p: spark.createDataFrame([(p,)], "p string").select(guards.path_shape(F.col("p"))).first()[0]
    assert shape("x/metrics/a.jsonl") == "metrics-ledger" and shape("src/app.py") is None and shape("runs/a.example.json") is None


def test_pulse(spark):
    items = spark.createDataFrame([("u:a", 0, 1.0, T0, "t"), ("u:a", 1, 9.0, T0, "t"), ("u:b", 2, 1.0, None, "s"), ("u:c", 3, 5.0, T0, "r"), ("", 4, 9.0, T0, "q")], "pulse_key string, pos int, rank double, ts timestamp, title string")
    seen = spark.createDataFrame([("u:c", T0)], "pulse_key string, last_shown timestamp")
    got = [r["pulse_key"] for r in pulse.select_rendered(items, seen).collect()]
    assert got == ["u:a", "u:b"]
    now = F.lit("2026-07-09 12:00:00").cast("timestamp")
    assert {r["pulse_key"] for r in pulse.merge_seen(seen, items.filter("pos = 2"), now).collect()} == {"u:b", "u:c"}


def test_topic_filter_and_keep_drop(spark):
    ok = lambda text, flt: spark.createDataFrame([(text, flt)], "t string, f string").select(feeds.topic_match(F.col("t"), F.col("f"))).first()[0]
    assert ok("New AI agent", "ai OR -spam") and not ok("said again", "ai") and ok("anything", "-is:retweet OR") and ok("x", None)
    keep = lambda c: spark.createDataFrame([(c,)], "c string").select(feeds.keep_drop(F.col("c"), ["Tech"], ["ads"])).first()[0]
    assert keep(" tech ") and not keep(None) and not keep("other")


def test_feeds(spark):
    rss = "<!-- hi --><rss><channel><item><title>One</title><link> http://a </link><category>dev</category><pubDate>Thu, 25 Jun 2026 08:00:00 GMT</pubDate><description><![CDATA[<b>x</b>]]></description></item><item><title>Two</title></item></channel></rss>"
    raw = spark.createDataFrame([(rss,), ("<!DOCTYPE x [<!ENTITY a 'b'>]>" + rss,), (None,)], "body string")
    rows = sorted(feeds.parse_rss(raw).collect(), key=lambda r: r["title"])
    assert [r["title"] for r in rows] == ["One", "Two"] and rows[0]["url"] == "http://a" and rows[0]["ts"] is not None and rows[1]["ts"] is None
    topics = spark.createDataFrame([('[{"title": "T", "replies": 3, "created": 1782374400, "node": {"name": "python"}}, {"title": "U", "created": 1e30}]',), ("not json",)], "body string")
    got = sorted(feeds.parse_topics(topics).filter("title IS NOT NULL").collect(), key=lambda r: r["title"])
    assert got[0]["category"] == "python" and got[0]["heat"] == 3.0 and got[1]["ts"] is None


def test_timeline_pages_of_the_last_response(spark):
    import json

    post = lambda i: {"id": str(i), "text": "x", "likeCount": 9, "createdAt": "2024-02-01T00:00:00Z"}
    body = lambda *ids: json.dumps({"tweets": [post(i) for i in ids]})
    roster = spark.createDataFrame([("A", "t", 1, True, None), ("b", "t", 1, True, None)], "handle string, track string, tier int, enabled boolean, topic_filter string")
    responses = spark.createDataFrame([("@a", body(1), 0), ("a", body(2, 3), 1), ("A", body(4), 1), ("b", None, None)], "handle string, body string, pos int")
    signals, pulls = feeds.collect_timelines(roster, responses, F.lit("2024-01-01").cast("timestamp"))
    assert signals.count() == 3
    assert {tuple(r) for r in pulls.collect()} == {("a", 3, 3), ("b", 0, 0)}


def test_pull_shards(spark, tmp_path):
    pulls = spark.createDataFrame([("r", T0, "h", 1)], "run_id string, ts timestamp, handle string, kept int")
    sinks.append_pulls(pulls, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("ym = '2026-06'").count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shingles_are_shuffled_once_at_most(spark):
    line = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    docs = spark.createDataFrame([(3, line), (1, line), (2, "x " + line), (1, line), (1, line + " y"), (4, None), (None, line)], "doc_id long, text string")
    refs = spark.createDataFrame([(7, line), (8, "x " + line)], "item_id long, text string")
    pairs = guards.shared_first_owners(docs)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 23)]
    assert plan_of(guards.shared_first_owners(docs.filter("doc_id = 3"))).count("hashpartitioning(shingle") == 1
    share = guards.duplicate_share(docs, refs)
    assert {r["doc_id"]: (r["n_shingles"], r["n_dup"]) for r in share.collect()} == {1: (24, 23), 2: (24, 24), 3: (23, 23), None: (23, 23)}
    assert {tuple(r) for r in guards.top_offenders(docs, refs).collect()} == {(1, 7, 23), (1, 8, 23), (2, 7, 23), (2, 8, 24), (3, 7, 23), (3, 8, 23), (None, 7, 23), (None, 8, 23)}
    for df in (guards.duplicate_share(docs.filter("doc_id = 3"), refs), guards.top_offenders(docs.filter("doc_id = 3"), refs)):
        assert "hashpartitioning(shingle" not in plan_of(df)


def test_a_configuration_is_parsed_once(spark):
    from tidewatch.operators import gate

    df = spark.createDataFrame([("[1]",), ("{",), (None,)], "c string").select(gate.setting_errors(F.col("c")).alias("e"))
    assert [r["e"] for r in df.collect()] == [["not an object"], ["not an object"], []]
    # of the whole, and of the four lists of a source
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 1 + 4
