"""Queries that put the driver's tables through sources, sinks and the batch engine, with what must come out as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.columns import Gate
from rivulet.operators import accounts, measures, profiles, samples
from rivulet.plans.adapters import EVENTS, SAMPLES, events, table
from rivulet.plans.catalogue import _CFG, _VALID, _profile_samples, _r, _samples, query
from rivulet.plans.report_queries import _context
from rivulet.sources import avro, files, replay
from rivulet.streaming.cutting import cut, scratch
from rivulet.streaming.engine import Commits, DecodedEngine, DurableDedupe, Engine, LateFeedback, Ledger, Sink, dedupe_within_watermark, parquet_sink
from rivulet.streaming.sequences import sequence_sink

# --- files


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def topic_roundtrip(spark, d):
    """Rows as messages (key, JSON of all columns, headers) and back."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    sent = files.to_json_topic(rows, "c_custkey", {"batch": "1"})
    return files.from_json_topic(sent, rows.schema)


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, '7' AS batch FROM customer")
def topic_payload(spark, d):
    sent = files.to_json_topic(table(spark, d, "customer"), "c_custkey", {"batch": "7"})
    return sent.select("key", F.get_json_object("value", "$.c_mktsegment").alias("segment"), F.col("headers")[0]["value"].cast("string").alias("batch"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(c_nationkey AS VARCHAR) AS movie_id, c_acctbal AS rating, c_custkey * 10 AS timestamp FROM customer")
def ratings_csv(spark, d):
    path = scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("userId"), F.col("c_nationkey").alias("movieId"), F.col("c_acctbal").alias("rating"), (F.col("c_custkey") * 10).alias("timestamp")).write.csv(path, header=True)
    return files.read_ratings(spark, path).withColumnsRenamed({"userId": "user_id", "movieId": "movie_id"})


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_inferred(spark, d):
    path = scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(path, header=True)
    return files.read_inferred(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1")
def csv_report(spark, d):
    """A report written as one CSV, and the same once more behind it."""
    path = scratch(spark)
    rows = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    files.write_csv(rows, path)
    files.write_csv(rows, path, mode="append")
    return spark.read.csv(path, header=True, schema="c_mktsegment string, n bigint")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings")
def embedding_text(spark, d):
    path = scratch(spark)
    files.write_embeddings(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return files.read_embeddings(spark, path).select("id", F.size("vector").cast("long").alias("width"), (_r(total) + F.lit(0.0)).alias("total"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type AS title, array_to_string(string_split(lower(p_name), ' '), '|') AS genres FROM part")
def catalog_json(spark, d):
    """One JSON object by item, as catalogs come; written by Spark for this query."""
    path = scratch(spark)
    entry = F.struct(F.col("p_partkey").cast("string").alias("k"), F.struct(F.col("p_type").alias("title"), F.split(F.lower("p_name"), " ").alias("genres")).alias("v"))
    table(spark, d, "part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)
    return files.read_catalog(spark, path).select("item_id", "title", F.array_join("genres", "|").alias("genres"))


@query(
    f"""WITH {SAMPLES} SELECT concat_ws(':', request_id, user_id) AS slate_id, user_id, min(impression_ts) AS request_ts, string_agg(item_id, ',' ORDER BY position, item_id) AS items FROM sm GROUP BY request_id, user_id"""
)
def slate_files(spark, d):
    path = f"{scratch(spark)}.jsonl"
    samples.build_slates(_samples(spark, d)).write.json(path)
    return files.read_slates(spark, path).select("slate_id", "user_id", "request_ts", F.array_join(F.transform("items", lambda i: i["item_id"]), ",").alias("items"))


@query(
    f"""WITH {EVENTS} SELECT event_id AS request, user_id AS user, CASE WHEN k % 2 = 0 THEN timestamp_ms + 5 ELSE timestamp_ms END AS t, 'g:' || array_to_string(list_sort(list_distinct(['x' || (k % 3), 'x' || (k % 2)])), ',') || '|t:' AS state
    FROM ev WHERE CASE WHEN k % 2 = 0 THEN timestamp_ms + 5 ELSE timestamp_ms END >= 1705000000000"""
)
def replay_buffer(spark, d):
    path = scratch(spark)
    k = F.col("k")
    state = F.struct(F.array(F.concat(F.lit("x"), k % 3), F.concat(F.lit("x"), k % 2)).alias("genres"))
    rows = events(spark, d).select(F.col("event_id").alias("requestId"), F.col("user_id").alias("user"), F.col("timestamp_ms").alias("timestamp"), F.when(k % 2 == 0, F.col("timestamp_ms") + 5).alias("feedbackTimestamp"), state.alias("state"))
    rows.write.json(path)
    got = files.read_replay(spark, path, 1_705_000_000_000)
    return got.select(F.col("requestId").alias("request"), "user", files.event_time().alias("t"), files.state_key(F.col("state.genres"), F.col("state.tags")).alias("state"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'item' AS movie_id, round(least(c_acctbal / 1000 * 5, 5.0), 1) AS rating, c_custkey AS timestamp FROM customer")
def replay_export(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("user"), F.lit("item").alias("action"), (F.col("c_acctbal") / 1000).alias("reward"), (F.col("c_custkey") * 1000 + 7).alias("timestamp"))
    return files.replay_ratings(rows).withColumnsRenamed({"userId": "user_id", "movieId": "movie_id"})


@query(f"WITH {EVENTS} SELECT event_id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y%m%d') AS day FROM ev WHERE timestamp BETWEEN 1704844800 AND 1705708799")
def dated_tables(spark, d):
    """A table a day, of which those of ten days are opened."""
    root = scratch(spark)
    rows = events(spark, d).select("event_id", F.date_format(F.to_date(F.timestamp_seconds("timestamp")), "yyyyMMdd").alias("day"))
    rows.withColumn("part", F.concat(F.lit("events_"), "day")).write.partitionBy("part").parquet(root)
    path, fs = spark._jvm.org.apache.hadoop.fs.Path, None
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(path(root)):
        name = s.getPath().getName()
        if name.startswith("part="):
            fs.rename(s.getPath(), path(f"{root}/{name.removeprefix('part=')}"))
    return files.dated_tables(spark, root, "events_", "20240110", "20240119").select("event_id", F.col("table_suffix").alias("day"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 > 0")
def keyed_lookup(spark, d):
    state = files.KeyedState(spark, scratch(spark))
    state.publish(table(spark, d, "customer").filter("c_custkey % 7 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), 1)
    return state.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "c_mktsegment")


@query(f"WITH {EVENTS} SELECT item_id, 2 * count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1")
def popularity_counts(spark, d):
    """Counts added twice; a batch that is sent again isn't added."""
    state = files.KeyedState(spark, scratch(spark))
    counts = events(spark, d).filter("event_type = 'click'").groupBy("item_id").agg(F.count("*").alias("n"))
    for version in (1, 1, 2):
        state.add_counts(counts, "item_id", "n", version)
    return state.read()


@query(f"WITH {_VALID} SELECT 'user-profile:v1:' || user_id AS key, evidence_count FROM pa")
def published_profiles(spark, d):
    state = files.KeyedState(spark, scratch(spark))
    rows = profiles.with_document(profiles.build_profiles(_profile_samples(spark, d), _CFG), _CFG, "run", "now")
    state.publish(rows.select(F.concat(F.lit("user-profile:v1:"), "user_id").alias("key"), "profile_json"), 1)
    return state.read().select("key", F.get_json_object("profile_json", "$.evidence_count").cast("long").alias("evidence_count"))


# --- messages

_SCHEMA = {
    "type": "record", "name": "Event",
    "fields": [
        {"name": "event_id", "type": "string"}, {"name": "user_id", "type": "string"}, {"name": "item_id", "type": ["null", "string"], "default": None}, {"name": "event_type", "type": "string"},
        {"name": "timestamp_ms", "type": "long"}, {"name": "rating", "type": ["null", "double"], "default": None},
    ],
}
_FIELDS = "event_id string, user_id string, item_id string, event_type string, timestamp_ms bigint, rating double"


def _messages(spark, d):
    """Events as binary messages; every seventh k is cut short, every eleventh has another marker."""
    codec = avro.Codec(_SCHEMA)

    @F.pandas_udf("binary")
    def encode(rows):
        import pandas as pd

        return pd.Series([codec.encode({k: None if v is None or v != v else v for k, v in r.items()}) for r in rows.to_dict("records")])

    ev = events(spark, d)
    raw = ev.select("k", encode(F.struct(*[f.split()[0] for f in _FIELDS.split(", ")])).alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").cast("long").alias("offset"))
    value = F.when(F.col("k") % 7 == 0, F.substring("value", 1, 20)).when(F.col("k") % 11 == 0, F.concat(F.lit(b"xx"), F.col("value"))).otherwise(F.col("value"))
    return raw.withColumn("value", value), codec


@query(f"WITH {EVENTS} SELECT event_id, user_id, item_id, event_type, timestamp_ms, rating FROM ev WHERE k % 7 > 0 AND k % 11 > 0")
def avro_roundtrip(spark, d):
    raw, codec = _messages(spark, d)
    return avro.decode_frame(raw, codec, T._parse_datatype_string(_FIELDS))[0].select(*[f.split()[0] for f in _FIELDS.split(", ")])


@query(f"WITH {EVENTS} SELECT CASE WHEN k % 7 = 0 THEN 'corrupt_payload' ELSE 'invalid_marker' END AS error_code, count(*) AS n FROM ev WHERE k % 7 = 0 OR k % 11 = 0 GROUP BY 1")
def avro_dead_letters(spark, d):
    raw, codec = _messages(spark, d)
    return avro.decode_frame(raw, codec, T._parse_datatype_string(_FIELDS))[1].groupBy("error_code").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT CAST(event_id AS BIGINT) AS kafka_offset FROM ev WHERE k % 7 > 0 AND k % 11 = 0")
def dead_letter_redrive(spark, d):
    """Dead letters whose marker has been put right go again; those cut short stay."""
    raw, codec = _messages(spark, d)
    dead = avro.decode_frame(raw, codec, T._parse_datatype_string(_FIELDS))[1]
    mended = F.when(F.col("error_code") == "invalid_marker", F.substring("raw_value", 3, 1 << 20)).otherwise(F.col("raw_value"))
    return replay.redrive(dead.withColumn("raw_value", mended), codec, T._parse_datatype_string(_FIELDS))[0].select("kafka_offset")


# --- commits and the engine


def _batches(spark, d, n=3):
    """Events dealt into batches by day; each batch has the first events of the one before once more."""
    ev = events(spark, d).withColumn("batch", F.expr(f"cast((timestamp div 86400) % {n} as int)"))
    return [ev.filter((F.col("batch") == i) | ((F.col("batch") == i - 1) & (F.col("k") < 10))).drop("batch") for i in range(n)]


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def parquet_commits(spark, d):
    """A batch committed by event type; committing it again changes nothing."""
    c = Commits(spark, scratch(spark))
    for _ in range(2):
        c.write("events/b=1", events(spark, d), ["event_type"])
    c.validate("events/b=1")
    return c.read("events/b=1").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT event_id FROM ev WHERE timestamp // 86400 BETWEEN 19732 AND 19741")
def archive_scan(spark, d):
    c = Commits(spark, scratch(spark))
    names = []
    for i, rows in enumerate(_batches(spark, d)):
        names.append(f"raw/batch={i:012d}")
        c.write(names[-1], rows.withColumn("date", F.to_date(F.timestamp_seconds("timestamp"))), ["date"])
    return replay.archive(c, names, dt.date(2024, 1, 10), dt.date(2024, 1, 20)).select("event_id").distinct()


@query(f"WITH {EVENTS} SELECT event_id, count(*) AS n FROM ev GROUP BY 1")
def archive_replay(spark, d):
    """Batches sent once in order, whatever is asked for again."""
    c = Commits(spark, scratch(spark))
    names, sent = [], Commits(spark, scratch(spark))
    for i, rows in enumerate(_batches(spark, d)):
        names.append(f"raw/batch={i:012d}")
        c.write(names[-1], rows.filter(F.expr(f"cast((timestamp div 86400) % 3 as int) = {i}")))
    at = []
    for _ in range(2):
        replay.replay(c, names, lambda df: sent.write(f"sent/b={len(at) + (at.append(1) or 0)}", df))
    return spark.read.parquet(f"{sent.root}/sent").groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT event_id, 1::BIGINT AS n FROM ev")
def durable_dedupe(spark, d):
    """Every event once, however often it comes; a batch that is tried again decides the same."""
    c = Commits(spark, scratch(spark))
    dedupe = DurableDedupe(c, "3 years")
    for i, rows in enumerate(_batches(spark, d)):
        dedupe.process(rows, i)
        c.write(f"new/b={i}", dedupe.process(rows, i).select("event_id"))
    return spark.read.parquet(f"{c.root}/new").groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT DISTINCT event_id FROM ev WHERE event_type <> 'signup'")
def engine_batches(spark, d):
    c = Commits(spark, scratch(spark))
    engine = Engine(c, [lambda df, _: df.filter("event_type <> 'signup'")], [parquet_sink(c, "kept")])
    for i, rows in enumerate(_batches(spark, d)):
        for _ in range(2):  # each batch is tried twice
            engine.batch(rows, i)
    return spark.read.parquet(f"{c.root}/kept").select("event_id").distinct()


@query(
    f"""WITH {EVENTS}, g AS (SELECT * FROM ev WHERE k % 7 > 0 AND k % 11 > 0) SELECT 'kept' AS part, count(*) AS n FROM g WHERE event_type <> 'signup' UNION ALL SELECT 'archived', count(*) FROM g
    UNION ALL SELECT 'dead', (SELECT count(*) FROM ev) - (SELECT count(*) FROM g)"""
)
def decoded_engine(spark, d):
    """Messages decoded, archived, freed of repeats and kept, in two batches that hold the same."""
    c = Commits(spark, scratch(spark))
    raw, codec = _messages(spark, d)
    decode = lambda df: avro.decode_frame(df, codec, T._parse_datatype_string(_FIELDS))
    engine = DecodedEngine(c, decode, DurableDedupe(c, "3 years"), [lambda df, _: df.filter("event_type <> 'signup'")], [parquet_sink(c, "kept")])
    for i in (0, 1):
        engine.batch(raw.select("value", "topic", "partition", "offset"), i)
    count = lambda path, name: spark.read.parquet(f"{c.root}/{path}").agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count("kept", "kept").unionByName(count("raw/valid/batch=000000000000", "archived")).unionByName(count("raw/dead/batch=000000000000", "dead"))


@query(f"WITH {EVENTS} SELECT DISTINCT event_id FROM ev")
def stream_dedupe(spark, d):
    """A stream of events, each twice, deduplicated within its watermark."""
    root = scratch(spark)
    ev = events(spark, d).select("event_id", F.timestamp_millis("timestamp_ms").alias("at"))
    ev.unionByName(ev).coalesce(1).write.parquet(f"{root}/in")
    stream = dedupe_within_watermark(spark.readStream.schema(ev.schema).parquet(f"{root}/in"), "at", "60 days")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ev.schema).parquet(f"{root}/out").select("event_id")


@query(
    f"""WITH {EVENTS}, s AS (SELECT request_id, user_id, coalesce(min(timestamp_ms) FILTER (WHERE event_type = 'impression'), min(timestamp_ms)) AS t, bool_or(k < 50 AND timestamp % 2 = 0) AS early FROM ev GROUP BY ALL)
    SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM ev JOIN s USING (request_id, user_id) WHERE early OR (SELECT max(timestamp_ms) FROM ev) >= t + 259200000"""
)
def late_feedback_batches(spark, d):
    """Events in two batches, held until their slates close, by event time or, for those of the first, by the clock: what has gone by the end went once."""
    ev = events(spark, d)
    c = Commits(spark, scratch(spark))
    late = LateFeedback(c, "3 days")
    newest = ev.agg(F.max("timestamp_ms")).first()[0]
    halves = [ev.filter("k < 50 AND timestamp % 2 = 0"), ev.filter("NOT (k < 50 AND timestamp % 2 = 0)"), ev.limit(0)]
    # when the first comes the clock stands at 0, so it holds all back
    for i, (rows, now) in enumerate(zip(halves, (0, newest, newest), strict=True)):
        c.write(f"due/b={i}", late.process(rows, i, now).select("event_id"))
    return spark.read.parquet(f"{c.root}/due").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS n FROM ev GROUP BY 1")
def ledger_counts(spark, d):
    """Counts of users that each batch adds to once, though each is sent twice and an old one once more."""
    ledger = Ledger(spark, scratch(spark), remember=2)
    rows = events(spark, d).withColumn("batch", F.expr("cast((timestamp div 86400) % 4 as int)"))

    def change(i):
        new = rows.filter(F.col("batch") == i).groupBy("user_id").agg(F.count("*").alias("n"))
        return lambda old: new if old is None else old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"))

    for i in (0, 0, 1, 2, 2, 3, 0):
        ledger.apply("counts", i, change(i))
    return ledger.read("counts")


@query(
    f"""WITH {EVENTS}, r AS (SELECT user_id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y%m%d') AS bucket, item_id, timestamp_ms, event_type, k % 2 AS half FROM ev),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY half DESC, timestamp_ms DESC, item_id DESC, event_type DESC) AS n FROM r)
    SELECT user_id, bucket, count(*) AS n, min(half) AS half FROM c WHERE n <= 3 GROUP BY 1, 2"""
)
def sequence_store(spark, d):
    """Sequences of two batches merged in the store, the newest three rows of a key kept."""
    ledger = Ledger(spark, scratch(spark))
    sink = sequence_sink("sequences", ledger, 3, Commits(spark, scratch(spark)))
    rows = events(spark, d).select("user_id", F.lit("behavior").alias("kind"), "item_id", F.col("timestamp_ms").alias("ts"), F.col("event_type").alias("action"), (F.col("k") % 2).cast("double").alias("rating"))
    for i in (0, 1, 1):
        sink.write(rows.filter(F.col("rating") == i), i)
    return ledger.read("sequences").select("user_id", "bucket", "n", F.array_min(F.transform(F.split("rating", ","), lambda x: x.cast("double"))).cast("long").alias("half"))


@query(
    f"""WITH {EVENTS}, c AS (SELECT user_id, CASE WHEN k % 5 > 0 THEN item_id END AS item_id, event_type, k FROM ev), r AS (SELECT user_id, count(*) AS n, CAST(sum(k % 5) AS DOUBLE) AS total FROM c WHERE event_type = 'click' AND item_id IS NOT NULL GROUP BY 1),
    w AS (SELECT DISTINCT user_id FROM c WHERE event_type = 'signup' AND (k % 3 > 0 OR k % 4 > 0))
    SELECT user_id, 2 * coalesce(n, 0) AS ratings, 2 * coalesce(total, 0) AS total, round(total / n, 6) AS mean FROM w FULL JOIN r USING (user_id)"""
)
def user_feature_upserts(spark, d):
    """Users' features after the same update came in two batches."""
    update = samples.user_feature_updates(samples.context_gate(_context(spark, d)).kept)
    got = samples.upsert_users(samples.upsert_users(None, update), update)
    return got.select("user_id", F.col("ratingCount").alias("ratings"), F.col("ratingSum").alias("total"), _r("avgRating").alias("mean"))


# --- gates, columns


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'not_behavioural' ELSE 'small_key' END AS reason FROM ev WHERE event_type = 'signup' OR k < 10")
def gate_rejected(spark, d):
    gate = Gate(events(spark, d), [("not_behavioural", F.col("event_type") != "signup"), ("small_key", F.col("k") >= 10)])
    return gate.rejected.select("event_id", F.col("rejection_reason").alias("reason"))


@query(f"WITH {EVENTS} SELECT event_id FROM ev WHERE event_type <> 'signup' AND k >= 10")
def gate_kept(spark, d):
    return Gate(events(spark, d), [("not_behavioural", F.col("event_type") != "signup"), ("small_key", F.col("k") >= 10)]).kept.select("event_id")


@query(f"WITH {EVENTS}, g AS (SELECT CASE WHEN k % 6 = 0 THEN 'separator_in_identifier' ELSE 'kept' END AS reason FROM ev) SELECT r.reason, count(g.reason) AS n FROM (VALUES ('kept'), ('separator_in_identifier')) r(reason) LEFT JOIN g USING (reason) GROUP BY 1")
def identifier_gate(spark, d):
    k = F.col("k")
    rows = events(spark, d).withColumns({"user_id": F.when(k % 6 == 0, F.concat("user_id", F.lit(","))).otherwise(F.col("user_id"))})
    return samples.identifier_gate(rows).counts()


@query(
    f"""WITH {EVENTS}, c AS (SELECT CASE WHEN (event_type = 'click' AND k % 5 > 0) OR (event_type = 'signup' AND (k % 3 > 0 OR k % 4 > 0)) OR (event_type = 'impression' AND k % 5 > 0) THEN 'kept' ELSE 'unclassifiable_shape' END AS reason FROM ev)
    SELECT r.reason, count(c.reason) AS n FROM (VALUES ('kept'), ('unclassifiable_shape')) r(reason) LEFT JOIN c USING (reason) GROUP BY 1"""
)
def context_gate(spark, d):
    return samples.context_gate(_context(spark, d)).counts()


@query(
    f"""WITH {SAMPLES} SELECT sample_id, CAST(to_timestamp(impression_ts) AT TIME ZONE 'UTC' AS DATE) AS date, coalesce(array_to_string(string_split(lower(p_name), ' '), '|'), '') AS genres FROM sm LEFT JOIN part ON 'item_' || p_partkey = item_id"""
)
def samples_with_date(spark, d):
    catalog = table(spark, d, "part").select(F.concat(F.lit("item_"), F.col("p_partkey").cast("string")).alias("item_id"), F.split(F.lower("p_name"), " ").alias("genres"))
    return samples.with_date(_samples(spark, d), catalog).select("sample_id", "date", F.array_join("genres", "|").alias("genres"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{\"k\":' || (props->>'$.k') || ',\"t\":\"' || event_type || '\"}' AS again FROM events")
def json_fields(spark, d):
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))).alias("again"))


@query("SELECT TRY_CAST(n_name AS INTEGER) AS name_number, CAST(n_nationkey AS DOUBLE) AS key_number, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def typed_columns(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name_number"), F.col("n_nationkey").cast("string").alias("key_number"), F.col("n_regionkey").alias("region"))
    return accounts.typed(rows, {"name_number": "int", "key_number": "double", "region": "string"})


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS rank FROM lineitem) SELECT l_orderkey, l_partkey, rank FROM l WHERE rank <= 2"""
)
def top_k_with_ties(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    out = measures.rank_within(rows, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")], 2)
    return out.select("l_orderkey", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, coalesce(lag(p_size) OVER (ORDER BY p_partkey), -1) AS before FROM part WHERE p_partkey % 2 = 0 OR p_size > 10")
def previous_of_key(spark, d):
    """The size of the part before, by ranges of the key: no window over all rows."""
    rows = table(spark, d, "part").filter("p_partkey % 2 = 0 OR p_size > 10").select("p_partkey", "p_size")
    dealt = cut(rows.repartitionByRange("p_partkey").withColumn("range", F.spark_partition_id()))
    lasts = dealt.groupBy("range").agg(F.max_by("p_size", "p_partkey").alias("last"))
    before = lasts.withColumn("carried", F.lag("last").over(Window.orderBy("range"))).select("range", "carried")  # one row a range
    within = F.lag("p_size").over(Window.partitionBy("range").orderBy("p_partkey"))
    return dealt.join(F.broadcast(before), "range").select("p_partkey", F.coalesce(within, "carried", F.lit(-1)).alias("before"))
