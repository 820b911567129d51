import datetime as dt

from pyspark.sql import functions as F

from tidewatch.streaming import state

DDL = "canonical_key string, first_seen timestamp, last_seen timestamp, last_score double, lifecycle_stage string, push_count long, source_set array<string>"


def test_ledger_stream_is_idempotent(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 6, n, tzinfo=dt.timezone.utc)
    rows = [("a", day(1), day(1), 50.0, "peak", 1, ["x"]), ("a", day(3), day(3), 70.0, "fading", 1, ["y"]), ("b", day(2), day(2), 10.0, "", 0, ["x"])]
    src, out = str(tmp_path / "src"), str(tmp_path / "ledger")
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(src)
    write = state.ledger_writer(out)
    state.run_available(state.read_events(spark, src, DDL, files=1), write, str(tmp_path / "ck"))
    last = max(p.name for p in (tmp_path / "ledger").iterdir())
    got = {r["canonical_key"]: r for r in spark.read.parquet(f"{out}/{last}").collect()}
    assert got["a"]["push_count"] == 2 and got["a"]["last_score"] == 70.0 and got["a"]["source_set"] == ["x", "y"] and got["a"]["first_seen"].day == 1
    before = spark.read.parquet(f"{out}/{last}").orderBy("canonical_key").collect()
    number = int(last[2:])
    write(spark.read.schema(DDL).parquet(src).limit(0), number + 1)
    assert spark.read.parquet(f"{out}/v={number + 1}").orderBy("canonical_key").collect() == before


def test_resurfacing(spark, tmp_path):
    src, ddl = str(tmp_path / "cards"), "canonical_key string, score double, ts timestamp"
    t, got = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc), []
    for rows in ([("a", 50.0, t), ("b", 10.0, t)], [("a", 52.0, t), ("b", 30.0, t)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = state.resurfacing(state.read_events(spark, src, ddl, files=1))
        state.run_available(stream, lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(got) == [("a", "NEW", 50.0), ("a", "SUPPRESS", 52.0), ("b", "NEW", 10.0), ("b", "RESURFACE", 30.0)]


def test_windows(spark, tmp_path):
    src = str(tmp_path / "events")
    t = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)
    rows = [("e1", t, "view"), ("e1", t, "view"), ("e2", t + dt.timedelta(minutes=1), "view"), ("e3", t + dt.timedelta(hours=3), "buy")]
    spark.createDataFrame(rows, "event_id string, ts timestamp, event_type string").write.parquet(src)
    stream = state.deduplicated(state.read_events(spark, src, "event_id string, ts timestamp, event_type string"), "event_id")
    got = []
    state.run_available(stream.select("event_id"), lambda df, n: got.extend(r[0] for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(got) == ["e1", "e2", "e3"]
    counts = state.windowed_counts(spark.read.parquet(src), "1 hour").agg(F.sum("n")).first()[0]
    assert counts == 4
