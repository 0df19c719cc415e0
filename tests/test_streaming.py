"""Commits, retries, dedupe and late feedback."""

import pytest
from pyspark.sql import functions as F

from rivulet.config import StreamConfig
from rivulet.sources import avro, files
from rivulet.streaming.engine import Commits, DecodedEngine, DurableDedupe, Engine, LateFeedback, Ledger, Sink, Source, parquet_sink, with_retry
from rivulet.streaming.sequences import sequence_sink

EV = "event_id string, request_id string, user_id string, event_type string, timestamp_ms bigint"


def test_commit_once_and_tampering(spark, tmp_path):
    c = Commits(spark, str(tmp_path))
    df = spark.range(5)
    assert c.write("a/batch=1", df) and not c.write("a/batch=1", spark.range(9))
    assert c.read("a/batch=1").count() == 5 and c.validate("a/batch=1")["rows"] == 5
    assert c.write("a/batch=2", df.limit(0))
    part = next((tmp_path / "a/batch=1").glob("*.parquet"))
    part.unlink()
    with pytest.raises(ValueError):
        c.validate("a/batch=1")
    with pytest.raises(ValueError):
        c.write("a/batch=3", df.withColumnRenamed("id", "Batch"))


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("no")
        return 7

    assert with_retry(flaky, 2, 0) == 7
    with pytest.raises(RuntimeError):
        with_retry(lambda: (_ for _ in ()).throw(RuntimeError()), 1, 0)


def test_dedupe_over_batches_and_retry(spark, tmp_path):
    d = DurableDedupe(Commits(spark, str(tmp_path)), "10 minutes")
    df = lambda *rows: spark.createDataFrame(rows, "event_id string, timestamp_ms bigint")
    ids = lambda x: sorted(r["event_id"] for r in x.collect())
    assert ids(d.process(df(("a", 0), ("a", 0), ("b", 1)), 0)) == ["a", "b"]
    second = df(("a", 0), ("c", 2))
    assert ids(d.process(second, 1)) == ["c"] and ids(d.process(second, 1)) == ["c"]
    # a row older than the watermark stays if it wasn't seen; keys are forgotten after the delay
    assert ids(d.process(df(("late", -10**9), ("z", 10**7)), 2)) == ["late", "z"]
    assert ids(d.process(df(("a", 10**7)), 3)) == ["a"]


def test_late_feedback(spark, tmp_path):
    lf = LateFeedback(Commits(spark, str(tmp_path)), "1 minute")
    df = lambda *rows: spark.createDataFrame(rows, EV)
    ids = lambda x: sorted(r["event_id"] for r in x.collect())
    assert ids(lf.process(df(("i", "r", "u", "impression", 1000)), 0, 2000)) == []
    late = df(("c", "r", "u", "click", 30_000), ("far", "r2", "u", "click", 10**12))
    assert ids(lf.process(late, 1, 31_000)) == []  # one event from the future closes nothing
    end = df(("x", "r3", "u", "impression", 70_000))
    assert ids(lf.process(end, 2, 71_000)) == ["c", "i"]
    assert ids(lf.process(end, 2, 999_000)) == ["c", "i"]  # a retry repeats the decision
    assert ids(LateFeedback.orphans(df(("a", "r", "u", "click", 1)))) == ["a"]


def test_engine_writes_each_sink_once(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "out"))
    src = tmp_path / "in"
    spark.range(10).write.parquet(str(src))
    seen, failed = [], []

    def flaky(df, batch_id):
        if not failed:
            failed.append(1)
            raise RuntimeError("once")
        seen.append(df.count())

    engine = Engine(c, [lambda df, _: df.filter("id % 2 = 0")], [parquet_sink(c, "even"), Sink("flaky", flaky)])
    q = engine.run(spark.readStream.schema("id bigint").parquet(str(src)), str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    engine.batch(spark.range(10), 0)  # a retry of the batch
    assert seen == [5] and c.read("even/batch=000000000000").count() == 5
    with pytest.raises(ValueError):
        Engine(c, [], [Sink("a", flaky), Sink("a", flaky)])


def test_ledger(spark, tmp_path):
    add = lambda n: lambda old: spark.createDataFrame([((old.first()["n"] if old is not None else 0) + n,)], "n int")
    ledger = Ledger(spark, str(tmp_path), remember=2)
    assert [ledger.apply("s", b, add(1)) for b in (1, 1, 2, 5, 2)] == [1, 0, 1, 1, -1] and ledger.read("s").first()["n"] == 3
    # what is remembered outlives the process; a change that fails leaves nothing behind
    again = Ledger(spark, str(tmp_path), remember=2)
    assert [again.apply("s", b, add(1)) for b in (5, 3)] == [0, -1] and again.read("other") is None

    def broken(old):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        again.apply("s", 6, broken)
    assert again.apply("s", 6, add(10)) == 1 and again.read("s").first()["n"] == 13


def test_decoded_engine(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "out"))
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1000), ("a", 1000), ("b", 2000), (None, 5)], "event_id string, timestamp_ms bigint").coalesce(1).write.json(str(src))
    seen, fail = [], [True]

    def decode(df):
        return df.filter("event_id IS NOT NULL"), df.filter("event_id IS NULL").select(F.lit("no_id").alias("error_code"), "timestamp_ms")

    def flaky(df, batch_id):
        if fail and fail.pop():
            raise RuntimeError("once")
        seen.append(sorted(r["event_id"] for r in df.collect()))

    reports = []
    engine = DecodedEngine(c, decode, DurableDedupe(c, "1 month"), [lambda df, _: df.withColumn("x", F.lit(1))], [parquet_sink(c, "rows"), Sink("flaky", flaky)], report=lambda *r: reports.append(r))
    source = Source("json", {"path": str(src)}, "event_id string, timestamp_ms bigint")
    engine.run_configured(source, StreamConfig(trigger_seconds=0), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert seen == [["a", "b"]] and reports == [(0, 3, {"no_id": 1})] and c.marked("_complete/000000000000")
    batch = spark.read.schema("event_id string, timestamp_ms bigint").json(str(src))
    engine.batch(batch, 0)  # a retry of the whole batch
    assert seen == [["a", "b"]] and c.read("rows/batch=000000000000").count() == 2 and c.read("raw/valid/batch=000000000000").count() == 3 and c.read("raw/dead/batch=000000000000").count() == 1
    engine.batch(batch, 1)
    assert seen == [["a", "b"], []]
    with pytest.raises(ValueError, match="watermark"):
        engine.run_configured(source, StreamConfig(watermark="soon"), str(tmp_path / "other"))


def test_sequence_sink(spark, tmp_path):
    ledger, archive = Ledger(spark, str(tmp_path / "state")), Commits(spark, str(tmp_path / "archive"))
    sink = sequence_sink("sequences", ledger, 3, archive)
    rows = lambda *at: spark.createDataFrame([("u", "click", f"i{t}", t, "click", None) for t in at] + [("u,2", "click", "i", 1, "click", None)], "user_id string, kind string, item_id string, ts bigint, action string, rating double")
    for batch_id, at in ((0, (1, 2)), (0, (1, 2)), (1, (3, 4))):
        sink.write(rows(*at), batch_id)
    assert [(r["item_id"], r["n"]) for r in ledger.read("sequences").collect()] == [("i2,i3,i4", 3)]
    assert archive.read("sequences/batch=000000000001").count() == 1


def test_large_files_are_digested_alike(spark, tmp_path, monkeypatch):
    c = Commits(spark, str(tmp_path))
    c.write("a", spark.range(100).withColumn("p", F.col("id") % 3), ["p"])
    want = c.validate("a")
    monkeypatch.setattr(Commits, "DIGEST_BYTES", 0)
    assert c.validate("a") == want and len(want["files"]) >= 3


V1 = {"type": "record", "name": "E", "fields": [{"name": "event_id", "type": "string"}, {"name": "user_id", "type": "string"}, {"name": "event_type", "type": "string"}, {"name": "timestamp_ms", "type": "long"}, {"name": "item_id", "type": ["null", "string"], "default": None}]}
V2 = V1 | {"fields": [*V1["fields"], {"name": "rating", "type": ["null", "double"], "default": None}, {"name": "tags", "type": {"type": "map", "values": "string"}, "default": {}}]}


def test_avro(spark):
    assert avro.fingerprint("int") == 0x7275D51A3F395C8F and avro.fingerprint("string") == 0x8F014872634503C7  # published check values
    old, new = avro.Codec(V1), avro.Codec(V1, V2)
    e = {"event_id": "1", "user_id": "u", "event_type": "click", "timestamp_ms": -5, "item_id": "i"}
    assert new.decode(old.encode(e)) == e | {"rating": None, "tags": {}}
    full = e | {"rating": 2.5, "tags": {"a": "b"}}
    assert new.decode(new.encode(full)) == full
    good = new.encode(full)
    bad = {b"": "invalid_marker", b"\0" * 12: "invalid_marker", good[:2] + b"\1" * 8 + good[10:]: "unknown_fingerprint", good[:-3]: "corrupt_payload", good + b"\0": "corrupt_payload"}
    for raw, code in bad.items():
        with pytest.raises(avro.DecodeFailure) as x:
            new.decode(raw)
        assert x.value.code == code
    with pytest.raises(avro.DecodeFailure):
        new.encode(e | {"item_id": None})
    assert new.encode(e | {"item_id": None, "event_type": "search"})
    raw = spark.createDataFrame([(bytearray(good), "t", 0, 1), (bytearray(b"xx"), "t", 0, 2), (None, "t", 0, 3)], "value binary, topic string, partition int, offset bigint")
    from pyspark.sql import types as T

    valid, dead = avro.decode_frame(raw, new, T._parse_datatype_string("event_id string, rating double, tags map<string,string>"))
    assert valid.first()["rating"] == 2.5 and [r["error_code"] for r in dead.collect()] == ["invalid_marker"] * 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a:1.0 0.5\nbad\n:1\nb:x 1\nc:2\n")
    assert {r["id"]: r["vector"] for r in files.read_embeddings(spark, str(tmp_path / "e.txt")).collect()} == {"a": [1.0, 0.5], "c": [2.0]}
    (tmp_path / "c.json").write_text('{"i": {"title": "T", "genres": ["g"]}, "j": {}}')
    assert {r["item_id"]: r["genres"] for r in files.read_catalog(spark, str(tmp_path / "c.json")).collect()} == {"i": ["g"], "j": None}
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\nu,m,4.5,7\n")
    assert files.read_ratings(spark, str(tmp_path / "r.csv")).first()["rating"] == 4.5
    assert files.json_document({"b": float("nan"), "a": [1.0]}) == '{"a": [1.0], "b": null}'


def test_more_sources(spark, tmp_path):
    (tmp_path / "i.csv").write_text("a,b\n1,x\n2,y\n")
    assert dict(files.read_inferred(spark, str(tmp_path / "i.csv")).dtypes) == {"a": "int", "b": "string"}
    with pytest.warns(UserWarning, match="catalog"):
        assert files.read_or_empty(spark, lambda: spark.read.parquet(str(tmp_path / "none")), "a int", "catalog").count() == 0
    (tmp_path / "s.jsonl").write_text('{"user_id": "u", "items": [{"item_id": "i", "label": 1.0}]}\n')
    (tmp_path / "s.json").write_text('[{"user_id": "u", "items": [{"item_id": "i", "label": 1.0}]}, {"user_id": "v"}]')
    (tmp_path / "c.json").write_text('{"user_id": {"0": "u", "10": "v", "9": "w"}, "request_ts": {"0": 5}}')
    for name, users in (("s.jsonl", ["u"]), ("s.json", ["u", "v"]), ("c.json", ["u", "w", "v"])):
        assert [r["user_id"] for r in files.read_slates(spark, str(tmp_path / name)).collect()] == users
    (tmp_path / "r.json").write_text('{"requestId": "r", "timestamp": 5, "feedbackTimestamp": 9, "state": {"genres": ["b", "a", "b"]}}\n{"requestId": "q", "timestamp": 3}\nbad\n')
    rows = files.read_replay(spark, str(tmp_path / "r.json"), 4).select(files.event_time().alias("t"), files.state_key(F.col("state.genres"), F.col("state.tags")).alias("k")).collect()
    assert [tuple(r) for r in rows] == [(9, "g:a,b|t:")]
    for day in ("20240101", "20240102", "20240105"):
        files.write_new(spark.createDataFrame([(day,)], "d string"), str(tmp_path / f"events_{day}"))
    with pytest.raises(Exception, match="exist"):
        files.write_new(spark.range(1), str(tmp_path / "events_20240101"))
    assert sorted(r["table_suffix"] for r in files.dated_tables(spark, str(tmp_path), "events_", "20240102", "20240105").collect()) == ["20240102", "20240105"]
    with pytest.raises(FileNotFoundError):
        files.dated_tables(spark, str(tmp_path), "events_", "20250101", "20250102")
    assert files.csv_document([{"b": 1, "a": float("nan")}, {"b": [1], "c": "x,y"}]) == 'a,b,c\n,1,\n,[1],"x,y"\n'
    topic = files.to_json_topic(spark.createDataFrame([("k", None)], "id string, x int"), "id", {"h": "v"}).first()
    assert (topic["key"], topic["value"], bytes(topic["headers"][0]["value"])) == ("k", '{"id":"k","x":null}', b"v")


def test_feedback_schedule_and_calibration(spark):
    from rivulet.sources import simulate

    now, later = simulate.split_slate([{"event_type": "impression", "timestamp_ms": 1000}, {"event_type": "click", "timestamp_ms": 4000, "n": 1}, {"event_type": "order", "timestamp_ms": 500, "n": 2}])
    assert len(now) == 1 and [(d, e["n"]) for d, e in later] == [(3.0, 1), (0.0, 2)]
    s = simulate.FeedbackSchedule(scale=2.0, clock=lambda: 10.0)
    for d, e in (*later, (3.0, {"n": 3})):
        s.schedule(d, e)
    assert [e["n"] for e in s.due(10.0)] == [2] and s.next_due_in(12.0) == 4.0 and [e["n"] for e in s.due(16.0)] == [1, 3] and s.pending() == 0 and s.next_due_in() is None
    with pytest.raises(ValueError):
        simulate.FeedbackSchedule(scale=0)
    share = {r["lift"]: r["preferred_share"] for r in simulate.calibrate(spark, [1.0, 6.0], slates=600).collect()}
    assert abs(share[1.0] - 0.25) < 0.05 and share[6.0] > 0.5


def test_keyed_state(spark, tmp_path):
    s = files.KeyedState(spark, str(tmp_path / "state"))
    delta = spark.createDataFrame([("a", 2), ("b", 1)], "k string, n bigint")
    assert s.read() is None and s.add_counts(delta, "k", "n", 1) and not s.add_counts(delta, "k", "n", 1) and s.add_counts(delta.filter("k = 'a'"), "k", "n", 2)
    assert {r["k"]: r["n"] for r in s.read().collect()} == {"a": 4, "b": 1}
    assert s.read().filter(F.col("k") == "a").count() == 1
    assert [tuple(r) for r in s.lookup(spark.createDataFrame([("a",), ("z",)], "k string"), "k").collect()] == [("a", 4)]


def test_archive_replay_and_redrive(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import types as T

    from rivulet.sources import replay

    c = Commits(spark, str(tmp_path))
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "n int").withColumn("date", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("n")))
    c.write("raw/batch=0", days(0, 1), ["date"])
    c.write("raw/batch=1", days(2), ["date"])
    names = ["raw/batch=0", "raw/batch=1"]
    assert sorted(r["n"] for r in replay.archive(c, names, dt.date(2024, 1, 2)).collect()) == [1, 2]
    got = []

    def send(df):
        if len(got) == 1 and not failed:
            failed.append(1)
            raise RuntimeError("once")
        got.append(df.count())

    failed = []
    with pytest.raises(RuntimeError):
        replay.replay(c, names, send)
    assert replay.replay(c, names, send) == ["raw/batch=1"] and got == [2, 1] and replay.replay(c, names, send) == []
    codec = avro.Codec(V1)
    good = codec.encode({"event_id": "1", "user_id": "u", "event_type": "click", "timestamp_ms": 1, "item_id": "i"})
    dead = spark.createDataFrame([("t", 0, 1, bytearray(good), "unknown_fingerprint"), ("t", 0, 2, bytearray(b"x"), "invalid_marker")], "kafka_topic string, kafka_partition int, kafka_offset int, raw_value binary, error_code string")
    again, left = replay.redrive(dead, codec, T._parse_datatype_string("event_id string"))
    assert [(r["kafka_offset"], bytes(r["value"])) for r in again.collect()] == [(1, good)] and [tuple(r) for r in left.collect()] == [("invalid_marker", 1)]


def test_accounts(spark):
    from rivulet.operators import accounts

    df = spark.range(400).select((F.col("id") % 2 == 0).alias("suspended"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("geo"), (F.col("id") % 7).alias("n"))
    _, auc = accounts.flag_model(df, ["geo"], ["n"])
    assert auc > 0.99
    assert accounts.typed(spark.createDataFrame([("1", "z")], "a string, b string"), {"a": "int", "b": "int"}).first() == (1, None)
    assert {r["v"] for r in df.select(accounts.listed("geo", ["x"]).alias("v")).collect()} == {"x", "other"}
