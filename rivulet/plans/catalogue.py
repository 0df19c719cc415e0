"""Registered queries over the driver's tables, one per operator, with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.columns import Gate, cosine, flag, held_out, ratio
from rivulet.operators import accounts, fitting, learning, measures, offpolicy, profiles, recall, reports, samples
from rivulet.plans.adapters import EVENTS, SAMPLES, STAR, events, star, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.build_samples(events(spark, sf_dir).filter("event_type <> 'signup'"))


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- events and samples


_FIELDS = (
    "sample_id, session_id, request_id, user_id, item_id, position, impression_ts, clicked, ordered, label, last_feedback_ts, feedback_delay_ms, model_version, policy_version, algorithm_version, rating, "
    "negative_feedback_reason, dwell_millis, completion_rate, published_at, new_release, filter_reason, unsafe_label, thumb, abandoned, surface, locale, timezone, device"
)


@query(f"WITH {SAMPLES} SELECT {_FIELDS}, feature FROM sm")
def samples_build(spark, d):
    return _samples(spark, d).select(*_FIELDS.split(", "), F.col("item_features")["k"].alias("feature"))


@query(
    f"""WITH {EVENTS}, g AS (SELECT CASE WHEN request_id IS NULL THEN 'null_request_id' WHEN user_id IS NULL THEN 'null_user_id' WHEN nullif(item_id, 'item_3') IS NULL THEN 'null_item_id'
      WHEN event_type IS NULL THEN 'null_event_type' WHEN nullif(timestamp % 100, 7) IS NULL THEN 'null_timestamp' ELSE 'kept' END AS reason FROM ev)
    SELECT r.reason, count(g.reason) AS n FROM (VALUES ('kept'), ('null_request_id'), ('null_user_id'), ('null_item_id'), ('null_event_type'), ('null_timestamp')) r(reason) LEFT JOIN g USING (reason) GROUP BY r.reason"""
)
def joiner_gate(spark, d):
    # no field of the table is null: some values stand for null here
    ev = events(spark, d).withColumns({"item_id": F.nullif("item_id", F.lit("item_3")), "timestamp": F.when(F.col("timestamp") % 100 != 7, F.col("timestamp"))})
    return samples.joiner_gate(ev).counts()


@query(f"WITH {SAMPLES} SELECT label, count(*) AS n FROM sm GROUP BY label")
def samples_label_hist(spark, d):
    return _samples(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EVENTS}, g AS (SELECT CASE WHEN NOT coalesce(event_type <> 'signup', false) THEN 'not_behavioural' WHEN NOT coalesce(k >= 10, false) THEN 'small_key' ELSE 'kept' END AS reason FROM ev)
    SELECT r.reason, count(g.reason) AS n FROM (VALUES ('kept'), ('not_behavioural'), ('small_key'), ('no_item')) r(reason) LEFT JOIN g USING (reason) GROUP BY r.reason"""
)
def gate_counts(spark, d):
    return Gate(events(spark, d), [("not_behavioural", F.col("event_type") != "signup"), ("small_key", F.col("k") >= 10), ("no_item", F.col("item_id").isNotNull())]).counts()


@query(f"WITH {EVENTS}, two AS (SELECT event_id, user_id FROM ev UNION ALL SELECT event_id, user_id FROM ev WHERE k < 50) SELECT DISTINCT event_id, user_id FROM two")
def dedupe_events(spark, d):
    ev = events(spark, d)
    return ev.unionByName(ev.filter("k < 50")).dropDuplicates(["event_id"]).select("event_id", "user_id")


@query(f"WITH {EVENTS} SELECT event_id, timestamp_ms FROM ev WHERE timestamp_ms >= (SELECT max(timestamp_ms) FROM ev) - 864000000")
def dedupe_horizon(spark, d):
    ev = events(spark, d).select("event_id", "timestamp_ms")
    newest = ev.agg(F.max("timestamp_ms").alias("newest"))
    return ev.crossJoin(F.broadcast(newest)).filter("timestamp_ms >= newest - 864000000").drop("newest")  # newest is one row


_CLOSE = "min(timestamp_ms) FILTER (WHERE event_type = 'impression')"


@query(
    f"""WITH {EVENTS}, s AS (SELECT request_id, user_id, coalesce({_CLOSE}, min(timestamp_ms)) AS t FROM ev GROUP BY ALL)
    SELECT ev.event_id, ev.request_id FROM ev JOIN s USING (request_id, user_id) WHERE (SELECT max(timestamp_ms) FROM ev) >= t + 259200000"""
)
def late_join_due(spark, d):
    from rivulet.streaming.engine import LateFeedback

    ev = events(spark, d)
    # the clock stands at the newest event, so event time alone decides
    newest = ev.agg(F.max("timestamp_ms")).first()[0]
    due, _ = LateFeedback(None, "3 days").split(ev, None, newest)
    return due.select("event_id", "request_id")


@query(f"WITH {EVENTS} SELECT event_id FROM ev WHERE (request_id, user_id) NOT IN (SELECT (request_id, user_id) FROM ev WHERE event_type = 'impression')")
def late_join_orphans(spark, d):
    from rivulet.streaming.engine import LateFeedback

    return LateFeedback.orphans(events(spark, d)).select("event_id")


@query(f"WITH {SAMPLES} SELECT sample_id, rating FROM sm WHERE rating IS NOT NULL")
def feedback_latest_nonnull(spark, d):
    return _samples(spark, d).filter("rating IS NOT NULL").select("sample_id", "rating")


_ITEM = (
    "position, item_id, clicked, ordered, label, last_feedback_ts, feedback_delay_ms, model_version, policy_version, algorithm_version, rating, negative_feedback_reason, dwell_millis, completion_rate, "
    "published_at, new_release, filter_reason, unsafe_label"
)


@query(
    f"""WITH {SAMPLES} SELECT concat_ws(':', request_id, user_id) AS slate_id, arg_min(session_id, (position, item_id)) AS session_id, min(impression_ts) AS request_ts, max(clicked) AS slate_clicked, max(ordered) AS slate_ordered,
    sum(label) AS slate_reward, CAST(count(*) AS INTEGER) AS slate_size, string_agg(item_id, ',' ORDER BY position, item_id) AS items FROM sm GROUP BY request_id, user_id"""
)
def slates_build(spark, d):
    out = samples.build_slates(_samples(spark, d))
    return out.select("slate_id", "session_id", "request_ts", "slate_clicked", "slate_ordered", "slate_reward", "slate_size", F.expr("array_join(transform(items, i -> i.item_id), ',')").alias("items"))


@query(f"WITH {SAMPLES} SELECT concat_ws(':', request_id, user_id) AS slate_id, {_ITEM}, feature FROM sm")
def slate_items(spark, d):
    out = samples.build_slates(_samples(spark, d)).select("slate_id", F.explode("items").alias("i"))
    return out.select("slate_id", *[f"i.{c}" for c in _ITEM.split(", ")], F.col("i.item_features")["k"].alias("feature"))


@query(f"WITH {SAMPLES} SELECT concat_ws(':', request_id, user_id) AS slate_id, item_id, CAST(row_number() OVER (PARTITION BY request_id, user_id ORDER BY position, item_id) - 1 AS INTEGER) AS place FROM sm")
def slate_item_positions(spark, d):
    return samples.build_slates(_samples(spark, d)).select("slate_id", F.posexplode("items").alias("place", "i")).select("slate_id", "i.item_id", "place")


@query(f"WITH {SAMPLES} SELECT user_id, request_id, item_id, CASE WHEN clicked = 1 THEN item_id END AS clicked_item_id, impression_ts AS ts FROM sm")
def recall_samples(spark, d):
    return samples.recall_samples(_samples(spark, d))


def _vectors(spark, d, name):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.select(F.col("id").alias("user_id"), "vector") if name == "user_id" else rows.select(F.concat(F.lit("item_"), "id").alias("item_id"), "vector")


@query(
    f"""WITH {SAMPLES}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT sample_id, coalesce(len(u.v), 0) AS user_dim, coalesce(len(i.v), 0) AS item_dim, round(coalesce(list_sum(u.v), 0), 6) + 0.0 AS user_sum, round(coalesce(list_sum(i.v), 0), 6) + 0.0 AS item_sum FROM sm
    LEFT JOIN e u ON CAST(u.vec_id AS VARCHAR) = sm.user_id LEFT JOIN e i ON 'item_' || i.vec_id = sm.item_id"""
)
def ranking_samples(spark, d):
    out = samples.ranking_samples(_samples(spark, d), _vectors(spark, d, "user_id"), _vectors(spark, d, "item_id"))
    total = lambda c: (_r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)) + F.lit(0.0)).alias(c.replace("vector", "sum"))
    return out.select("sample_id", F.size("user_vector").cast("long").alias("user_dim"), F.size("item_vector").cast("long").alias("item_dim"), total("user_vector"), total("item_vector"))


@query(f"WITH {SAMPLES} SELECT user_id || ':' || CASE WHEN trim(session_id) = '' THEN request_id ELSE session_id END AS query, item_id, label, position FROM sm")
def relevance_samples(spark, d):
    return samples.relevance_samples(_samples(spark, d))


@query(
    f"""WITH {SAMPLES}, s AS (SELECT concat_ws(':', request_id, user_id) AS slate_id, min(impression_ts) AS ts, max(clicked) AS c, max(ordered) AS o, sum(label) AS r, count(*) AS n FROM sm GROUP BY request_id, user_id),
    m AS (SELECT slate_id, 'clicks' AS metric, CAST(c AS DOUBLE) AS value FROM s WHERE c <> 0 UNION ALL SELECT slate_id, 'orders', o FROM s WHERE o <> 0 UNION ALL SELECT slate_id, 'reward', r FROM s WHERE r <> 0
      UNION ALL SELECT slate_id, 'items', n FROM s UNION ALL SELECT slate_id, 'large_slate', 1 FROM s WHERE n > 20
      UNION ALL SELECT slate_id, 'feedback_delay_s', last_feedback_ts - ts FROM sm JOIN s ON slate_id = concat_ws(':', request_id, user_id) WHERE last_feedback_ts IS NOT NULL)
    SELECT slate_id, metric, value FROM m"""
)
def metric_events(spark, d):
    return samples.metric_events(samples.build_slates(_samples(spark, d)))


@query(
    f"""WITH {EVENTS}, a AS (SELECT user_id, max(k) AS age FROM ev WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, count(*) AS ratings FROM ev WHERE event_type = 'order' AND k < 20 GROUP BY 1)
    SELECT user_id, age, ratings FROM a FULL JOIN b USING (user_id)"""
)
def context_user_merge(spark, d):
    ev = events(spark, d)
    return samples.merge_context(ev.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("k").alias("age")), ev.filter("event_type = 'order' AND k < 20").groupBy("user_id").agg(F.count("*").alias("ratings")))


@query(
    f"""WITH {EVENTS}, r AS (SELECT user_id, item_id, max(timestamp_ms) AS t FROM ev GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item_id DESC) AS n FROM r)
    SELECT user_id, string_agg(item_id, ',' ORDER BY n) AS recent FROM o WHERE n <= 5 GROUP BY 1"""
)
def context_recent_items(spark, d):
    last = events(spark, d).groupBy("user_id", "item_id").agg(F.max("timestamp_ms").alias("t"))
    rows = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "item_id")), asc=False).alias("r"))
    return rows.select("user_id", F.expr("array_join(transform(slice(r, 1, 5), x -> x.item_id), ',')").alias("recent"))


@query(f"WITH {EVENTS} SELECT item_id, count(*) AS clicks FROM ev WHERE event_type = 'click' GROUP BY 1")
def item_click_counts(spark, d):
    return events(spark, d).filter("event_type = 'click'").groupBy("item_id").agg(F.count("*").alias("clicks"))


_RATINGS = f"""{EVENTS}, ra AS (SELECT user_id, item_id, CAST(max(CASE event_type WHEN 'order' THEN 5 ELSE 4 END) AS DOUBLE) AS rating, max(timestamp) AS timestamp FROM ev WHERE event_type IN ('order', 'click') GROUP BY 1, 2)"""


def _ratings(spark, d):
    rows = events(spark, d).filter("event_type IN ('order', 'click')")
    return rows.groupBy(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId")).agg(F.max(F.when(F.col("event_type") == "order", 5.0).otherwise(4.0)).alias("rating"), F.max("timestamp").alias("timestamp"))


@query(f"WITH {_RATINGS} SELECT user_id, string_agg(item_id, ',' ORDER BY timestamp, item_id) AS items FROM ra WHERE rating >= 4.5 GROUP BY 1 HAVING count(*) >= 2")
def item_sequences(spark, d):
    return samples.item_sequences(_ratings(spark, d), least=4.5).select(F.col("userId").alias("user_id"), F.array_join("items", ",").alias("items"))


@query(f"WITH {_RATINGS} SELECT user_id, item_id, rating FROM ra")
def ratings_from_events(spark, d):
    return _ratings(spark, d).select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating")


def _sequence_rows(spark, d):
    return events(spark, d).select("user_id", F.lit("behavior").alias("kind"), "item_id", F.col("timestamp_ms").alias("ts"), F.col("event_type").alias("action"), F.lit(None).cast("double").alias("rating"))


_CHUNKS = f"""{EVENTS}, ch AS (SELECT user_id, 'behavior' AS kind, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y%m%d') AS bucket, string_agg(item_id, ',' ORDER BY timestamp_ms, item_id, event_type) AS item_id,
  string_agg(CAST(timestamp_ms AS VARCHAR), ',' ORDER BY timestamp_ms) AS ts, string_agg(event_type, ',' ORDER BY timestamp_ms, item_id, event_type) AS action, repeat(',', count(*) - 1) AS rating, repeat(',', count(*) - 1) AS genres, repeat(',', count(*) - 1) AS release_year, count(*) AS n FROM ev GROUP BY ALL)"""


@query(f"WITH {_CHUNKS} SELECT user_id, kind, bucket, item_id, ts, action, rating, genres, release_year, n FROM ch")
def seq_chunks(spark, d):
    return samples.to_chunks(_sequence_rows(spark, d))


@query(f"WITH {EVENTS} SELECT user_id, item_id, CAST(timestamp_ms AS VARCHAR) AS ts, event_type AS action FROM ev")
def seq_explode_roundtrip(spark, d):
    return samples.explode_chunks(samples.to_chunks(_sequence_rows(spark, d))).select("user_id", "item_id", "ts", "action")


@query(f"WITH {EVENTS}, b AS (SELECT user_id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y%m%d') AS bucket, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, bucket, least(2 * n, 3) AS n FROM b")
def seq_merge_cap(spark, d):
    chunks = samples.to_chunks(_sequence_rows(spark, d))
    return samples.merge_chunks(chunks, chunks, 3).select("user_id", "bucket", "n")


# --- profiles


_REFERENCE = 1_706_745_600
_CFG = profiles.ProfileConfig(reference=_REFERENCE)


def _profile_samples(spark, d):
    k = F.expr("cast(substring(item_id, 6) as int)")
    genres = F.array(F.concat(F.lit(" Genre_"), k % 3), F.concat(F.lit("genre_"), k % 4), F.lit(""))
    rows = _samples(spark, d).withColumn("rating", F.when(k % 5 == 0, F.lit(0.5)).when(k % 2 == 0, 1.0 + k / 2))
    return rows.withColumn("genres", genres).withColumn("tags", F.array(F.concat(F.lit("Tag "), k % 2)))


#: Profiles' samples: lower-cased distinct genres, one tag, ratings outside 1 to 5 rejected, 30 days before the reference, a half-life of 7 days.
_VALID = f"""{SAMPLES}, k0 AS (SELECT * EXCLUDE (rating, k), k, CASE WHEN k % 5 = 0 THEN 0.5::DOUBLE WHEN k % 2 = 0 THEN 1.0::DOUBLE + k / 2 END AS rating FROM (SELECT *, CAST(substr(item_id, 6) AS INTEGER) AS k FROM sm)),
  pg AS (SELECT *, CASE WHEN coalesce(user_id, '') = '' THEN 'missing_user' WHEN impression_ts IS NULL THEN 'invalid_timestamp' WHEN rating < 1 OR rating > 5 THEN 'invalid_behavior'
    WHEN impression_ts < {_REFERENCE} - 2592000 OR impression_ts >= {_REFERENCE} + 1 THEN 'outside_source_window' ELSE 'kept' END AS reason FROM k0),
  pv AS (SELECT *, list_distinct(['genre_' || (k % 3), 'genre_' || (k % 4)]) AS genres, 'tag ' || (k % 2) AS tag,
    (CASE WHEN rating >= 3 THEN (rating - 3) / 2 WHEN rating < 3 THEN (rating - 3) / 2 WHEN ordered = 1 THEN 3.0 WHEN clicked = 1 THEN 1.0 ELSE -0.1 END)::DOUBLE * pow(0.5, greatest(0, {_REFERENCE} - impression_ts)::DOUBLE / 604800.0::DOUBLE) AS w,
    CASE WHEN published_at IS NOT NULL THEN published_at >= {_REFERENCE} - 31536000 ELSE coalesce(new_release, false) END AS recent FROM pg WHERE reason = 'kept'),
  pa AS (SELECT user_id, count(*) AS evidence_count, CAST(sum(clicked) AS BIGINT) AS clicks, CAST(sum(ordered) AS BIGINT) AS orders, CAST(sum(clicked) AS DOUBLE) / count(*) AS engagement_rate,
    CAST(sum(ordered) AS DOUBLE) / count(*) AS conversion_rate, avg(rating) AS average_rating, CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 20 THEN 'medium' ELSE 'high' END AS activity_level FROM pv GROUP BY 1),
  pe AS (SELECT user_id, w, unnest(genres) AS value FROM pv), pp AS (SELECT user_id, value, sum(w) AS weight, count(*) AS evidence_count, greatest(-1, least(1, sum(w) / (count(*) + 5.0::DOUBLE))) AS score FROM pe GROUP BY 1, 2),
  pw AS (SELECT user_id, value, sum(w) AS w FROM pe WHERE w > 0 GROUP BY 1, 2), ps AS (SELECT user_id, w / sum(w) OVER (PARTITION BY user_id) AS share FROM pw),
  ph AS (SELECT user_id, 1 - sum(share * share) AS genre_diversity, max(share) AS preference_concentration FROM ps GROUP BY 1),
  pr AS (SELECT user_id, sum(CASE WHEN recent THEN w ELSE 0 END) / sum(w) AS recent_release_affinity FROM pv WHERE w > 0 GROUP BY 1)"""


@query(
    f"""WITH {_VALID} SELECT r.reason, count(pg.reason) AS n FROM (VALUES ('kept'), ('missing_user'), ('invalid_timestamp'), ('invalid_behavior'), ('outside_source_window')) r(reason)
    LEFT JOIN pg USING (reason) GROUP BY r.reason"""
)
def profile_gate(spark, d):
    return profiles.profile_gate(_profile_samples(spark, d), _CFG).counts()


@query(f"WITH {_VALID} SELECT user_id, evidence_count, clicks, orders, engagement_rate, conversion_rate, round(average_rating, 6) AS average_rating, activity_level FROM pa")
def profile_activity(spark, d):
    return profiles.activity(profiles.valid(_profile_samples(spark, d), _CFG), _CFG).drop("impressions").withColumn("average_rating", _r("average_rating"))


@query(f"WITH {_VALID} SELECT user_id, value, evidence_count, round(score, 6) + 0.0 AS score FROM pp")
def profile_preferences(spark, d):
    return profiles.preferences(profiles.valid(_profile_samples(spark, d), _CFG), _CFG).select("user_id", "value", "evidence_count", (_r("score") + F.lit(0.0)).alias("score"))


@query(f"WITH {_VALID}, s AS (SELECT user_id, tag AS value, greatest(-1, least(1, sum(w) / (count(*) + 5.0::DOUBLE))) AS score FROM pv GROUP BY 1, 2) SELECT user_id, string_agg(value, ',' ORDER BY round(score, 9) DESC, value) AS tags FROM s GROUP BY 1")
def profile_tags(spark, d):
    table_ = profiles.preferences(profiles.valid(_profile_samples(spark, d), _CFG), _CFG, "tags").withColumn("score", _r("score", 9))
    return profiles.top_preferences(table_, _CFG.most_tags, "tags").select("user_id", F.expr("array_join(transform(tags, t -> t.value), ',')").alias("tags"))


@query(f"WITH {_VALID} SELECT user_id, round(genre_diversity, 6) + 0.0 AS genre_diversity, round(preference_concentration, 6) AS preference_concentration FROM ph")
def profile_shape(spark, d):
    out = profiles.shape(profiles.valid(_profile_samples(spark, d), _CFG), _CFG)
    return out.select("user_id", (_r("genre_diversity") + F.lit(0.0)).alias("genre_diversity"), _r("preference_concentration").alias("preference_concentration"))


@query(f"WITH {_VALID} SELECT user_id, round(recent_release_affinity, 6) + 0.0 AS recent_release_affinity FROM pr")
def profile_recency(spark, d):
    return profiles.recency(profiles.valid(_profile_samples(spark, d), _CFG), _CFG).withColumn("recent_release_affinity", _r("recent_release_affinity") + F.lit(0.0))


@query(
    f"""WITH {_VALID}, f AS (SELECT * FROM pa LEFT JOIN ph USING (user_id) LEFT JOIN pr USING (user_id) LEFT JOIN (SELECT user_id, max(score) AS best FROM pp WHERE score > 0 GROUP BY 1) USING (user_id)),
    t AS (SELECT user_id, 'new_or_unknown' AS type, 1.0::DOUBLE AS confidence FROM f WHERE evidence_count < 5
      UNION ALL SELECT user_id, 'genre_enthusiast', (best - 0.6) / 0.4 FROM f WHERE evidence_count >= 5 AND best >= 0.6
      UNION ALL SELECT user_id, 'genre_explorer', least((genre_diversity - 0.6) / 0.4, (0.5 - preference_concentration) / 0.5) FROM f WHERE evidence_count >= 5 AND genre_diversity >= 0.6 AND preference_concentration <= 0.5
      UNION ALL SELECT user_id, 'focused_viewer', (preference_concentration - 0.7) / 0.3 FROM f WHERE evidence_count >= 5 AND preference_concentration >= 0.7
      UNION ALL SELECT user_id, 'recent_release_seeker', (recent_release_affinity - 0.6) / 0.4 FROM f WHERE evidence_count >= 5 AND recent_release_affinity >= 0.6
      UNION ALL SELECT user_id, 'high_intent_engager', least((engagement_rate - 0.4) / 0.6, (conversion_rate - 0.1) / 0.9) FROM f WHERE evidence_count >= 5 AND engagement_rate >= 0.4 AND conversion_rate >= 0.1
      UNION ALL SELECT user_id, 'casual_browser', least((0.1 - engagement_rate) / 0.1, (0.02 - conversion_rate) / 0.02) FROM f WHERE evidence_count >= 5 AND engagement_rate <= 0.1 AND conversion_rate <= 0.02)
    SELECT user_id, type, round(greatest(0, least(1, confidence)), 6) + 0.0 AS confidence FROM t"""
)
def profile_personas(spark, d):
    out = profiles.build_profiles(_profile_samples(spark, d), _CFG).select("user_id", F.explode("personas").alias("p"))
    return out.select("user_id", "p.type", (_r("p.confidence") + F.lit(0.0)).alias("confidence"))


@query(
    f"""WITH {_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, value) AS i FROM pp)
    SELECT pa.user_id, 1 AS profile_version, pa.evidence_count, string_agg(r.value || ':' || r.evidence_count, ',' ORDER BY i) AS genres, activity_level, '2024-01-02T00:00:00Z' AS start FROM pa JOIN r USING (user_id) WHERE i <= 10 GROUP BY ALL"""
)
def profile_documents(spark, d):
    got = profiles.with_document(profiles.build_profiles(_profile_samples(spark, d), _CFG), _CFG, "run", "2024-02-01T00:00:00Z")
    kind = "profile_version int, evidence_count bigint, source_window struct<start string>, behavioral_features struct<activity_level string>, preferences struct<genres: array<struct<value: string, score: double, evidence_count: bigint>>>"
    doc = got.select("user_id", F.from_json("profile_json", kind).alias("d"))
    listed = F.expr("array_join(transform(array_sort(transform(d.preferences.genres, g -> struct(-round(g.score, 9) AS o, g.value AS v, g.evidence_count AS n))), g -> concat(g.v, ':', g.n)), ',')")
    return doc.select("user_id", "d.profile_version", "d.evidence_count", listed.alias("genres"), "d.behavioral_features.activity_level", "d.source_window.start")


@query(
    f"""WITH {_RATINGS}, v AS (SELECT user_id, unnest(range(len(e.embedding))) AS i, unnest(CAST(e.embedding AS DOUBLE[])) AS x FROM ra JOIN embeddings e ON 'item_' || e.vec_id = ra.item_id)
    SELECT user_id, CAST(i AS INTEGER) AS i, round(avg(x), 6) + 0.0 AS x FROM v GROUP BY ALL"""
)
def user_vectors_mean(spark, d):
    rows = _ratings(spark, d).select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"))
    return measures.user_vectors(rows, _vectors(spark, d, "item_id")).select("user_id", F.posexplode("vector").alias("i", "x")).select("user_id", "i", (_r("x") + F.lit(0.0)).alias("x"))


def _nearest(users: str) -> str:
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id, list_cosine_similarity(u.v, i.v) AS score FROM v u, v i WHERE {users}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s)
    SELECT user_id, item_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


def _top_k(spark, d, users):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    out = measures.top_k_cosine(rows.filter(users).withColumnRenamed("vec_id", "user_id"), rows.withColumnRenamed("vec_id", "item_id"), 10)
    return out.select("user_id", "item_id", "rank", _r("score").alias("score"))


@query(_nearest("u.vec_id % 100 = 0"))
def topk_cosine(spark, d):
    """A search: every vector whose id is divisible by 100 against all vectors."""
    return _top_k(spark, d, "vec_id % 100 = 0")


@query(_nearest("true"))
def topk_cosine_all(spark, d):
    return _top_k(spark, d, "true")


# --- reports


def _engaged(by: str, select: str = "") -> str:
    return f"WITH {STAR} SELECT {select or by}, count(*) AS impressions, CAST(sum(clicked) AS BIGINT) AS clicks, CAST(sum(ordered) AS BIGINT) AS orders, CAST(sum(clicked) AS DOUBLE) / count(*) AS ctr FROM st GROUP BY {by}"


@query(_engaged("date"))
def ctr_daily(spark, d):
    return measures.engagement(star(spark, d, "date clicked ordered"), ["date"])


@query(f"WITH {EVENTS} SELECT hour, count(*) AS events, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS clicks FROM (SELECT CAST(timestamp // 3600 % 24 AS INTEGER) AS hour, event_type FROM ev) GROUP BY 1")
def ctr_by_hour(spark, d):
    hour = F.expr("cast((timestamp div 3600) % 24 as int)")
    return events(spark, d).groupBy(hour.alias("hour")).agg(F.count("*").alias("events"), F.sum(flag(F.col("event_type") == "click")).alias("clicks"))


@query(_engaged("1, 2", "CAST(dayofweek(date) + 1 AS INTEGER) AS dow, strftime(date, '%a') AS day"))
def ctr_by_dow(spark, d):
    return measures.engagement(star(spark, d, "date clicked ordered").select("*", F.dayofweek("date").alias("dow"), F.date_format("date", "E").alias("day")), ["dow", "day"])


_SESSION = f"""{SAMPLES}, sb AS (SELECT * EXCLUDE (session_id), CASE WHEN item_id = 'item_7' THEN '' ELSE session_id END AS session_id FROM sm), se AS (SELECT session_id, user_id, count(DISTINCT request_id) AS slates, count(*) AS impressions,
  CAST(sum(clicked) AS BIGINT) AS clicks, CAST(sum(ordered) AS BIGINT) AS orders, round(CAST(sum(clicked) AS DOUBLE) / count(*), 4) AS ctr FROM sb WHERE session_id <> '' GROUP BY 1, 2)"""


def _sessions(spark, d):
    # one item's samples stand for those without a session
    rows = _samples(spark, d).withColumn("session_id", F.when(F.col("item_id") == "item_7", "").otherwise(F.col("session_id")))
    return reports.sessions(rows)


@query(f"WITH {_SESSION} SELECT * FROM se")
def session_report(spark, d):
    return _sessions(spark, d)


@query(
    f"""WITH {_SESSION} SELECT count(*) AS sessions, count(DISTINCT user_id) AS users, round(CAST(count(*) AS DOUBLE) / count(DISTINCT user_id), 3) AS sessions_per_user, round(CAST(sum(slates) AS DOUBLE) / count(*), 3) AS slates_per_session,
    round(CAST(sum(impressions) AS DOUBLE) / count(*), 2) AS impressions_per_session, round(CAST(sum(clicks) AS DOUBLE) / count(*), 3) AS clicks_per_session, round(avg(ctr), 4) AS mean_session_ctr FROM se"""
)
def session_summary(spark, d):
    return reports.session_summary(_sessions(spark, d))


@query(f"WITH {STAR} SELECT query_text, count(*) AS impressions, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions, CAST(sum(clicked) AS DOUBLE) / count(*) AS ctr FROM st GROUP BY 1 ORDER BY impressions DESC, query_text LIMIT 20")
def top_queries(spark, d):
    out = star(spark, d, "query_text user_id session_id clicked").groupBy("query_text").agg(F.count("*").alias("impressions"), F.countDistinct("user_id").alias("users"), F.countDistinct("session_id").alias("sessions"), ratio(F.sum("clicked"), F.count("*")).alias("ctr"))
    return out.orderBy(F.desc("impressions"), "query_text").limit(20)


@query(f"WITH {STAR} SELECT CASE WHEN length(query_text) <= 10 THEN 'short' ELSE 'long' END AS length, count(DISTINCT query_text) AS queries, count(*) AS impressions FROM st GROUP BY 1")
def query_length(spark, d):
    return star(spark, d, "query_text").groupBy(F.when(F.length("query_text") <= 10, "short").otherwise("long").alias("length")).agg(F.countDistinct("query_text").alias("queries"), F.count("*").alias("impressions"))


_KEYWORDS = f"{STAR}, kw AS (SELECT keyword, segment, count(*) AS impressions, count(DISTINCT item_id) AS items, CAST(sum(clicked) AS BIGINT) AS clicks FROM (SELECT unnest(genres) AS keyword, segment, item_id, clicked FROM st) GROUP BY 1, 2)"


def _keywords(spark, d):
    rows = star(spark, d, "segment item_id clicked genres").select("segment", "item_id", "clicked", F.explode("genres").alias("keyword"))
    return rows.groupBy("keyword", "segment").agg(F.count("*").alias("impressions"), F.countDistinct("item_id").alias("items"), F.sum("clicked").alias("clicks"))


@query(f"WITH {_KEYWORDS} SELECT * FROM kw")
def keyword_dist(spark, d):
    return _keywords(spark, d)


@query(f"WITH {_KEYWORDS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY impressions DESC, keyword) AS INTEGER) AS rank FROM kw) SELECT segment, keyword, impressions, rank FROM r WHERE rank <= 10")
def keyword_rank(spark, d):
    return measures.rank_within(_keywords(spark, d), ["segment"], [F.desc("impressions"), F.col("keyword")], 10).select("segment", "keyword", "impressions", "rank")


def _category(expr: str) -> str:
    return f"""WITH {STAR}, i AS (SELECT item_id, {expr} AS category, count(*) AS n, sum(clicked) AS c, sum(ordered) AS o FROM st GROUP BY 1, 2), g AS (SELECT category, count(*) AS items, CAST(sum(n) AS BIGINT) AS impressions, CAST(sum(c) AS BIGINT) AS clicks FROM i GROUP BY 1)
    SELECT *, CAST(clicks AS DOUBLE) / impressions AS ctr, CAST(clicks AS DOUBLE) / items AS clicks_per_item, round((CAST(clicks AS DOUBLE) / impressions / ((SELECT CAST(sum(clicks) AS DOUBLE) / sum(impressions) FROM g)) - 1) * 100, 6) AS lift FROM g"""


def _by_category(spark, d, column):
    per = star(spark, d).groupBy("item_id", column.alias("category")).agg(F.count("*").alias("n"), F.sum("clicked").alias("c"))
    out = per.groupBy("category").agg(F.count("*").alias("items"), F.sum("n").alias("impressions"), F.sum("c").alias("clicks"))
    out = out.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions"))).withColumn("clicks_per_item", ratio(F.col("clicks"), F.col("items")))
    return measures.lift(out, "ctr", "clicks", "impressions").withColumn("lift", _r("lift"))


@query(_category("genres[1]"))
def category_l1(spark, d):
    return _by_category(spark, d, F.col("genres")[0])


@query(_category("brand"))
def category_l2(spark, d):
    return _by_category(spark, d, F.col("brand"))


@query(_category("genres[1] || ' ' || (year // 10 * 10)"))
def category_l3(spark, d):
    return _by_category(spark, d, F.concat(F.col("genres")[0], F.lit(" "), F.expr("year div 10 * 10")))


@query(_engaged("device"))
def segment_device(spark, d):
    return measures.engagement(star(spark, d, "device clicked ordered"), ["device"])


@query(f"WITH {STAR}, u AS (SELECT user_id, geo, count(*) AS n, sum(clicked) AS c, sum(score) AS s FROM st GROUP BY 1, 2) SELECT geo, count(*) AS users, CAST(sum(c) AS DOUBLE) / sum(n) AS ctr, round(sum(s) / sum(n), 6) AS weighted FROM u GROUP BY 1")
def segment_geo_weighted(spark, d):
    per = star(spark, d, "user_id geo clicked score").groupBy("user_id", "geo").agg(F.count("*").alias("n"), F.sum("clicked").alias("c"), F.sum("score").alias("s"))
    return per.groupBy("geo").agg(F.count("*").alias("users"), ratio(F.sum("c"), F.sum("n")).alias("ctr"), _r(F.sum("s") / F.sum("n")).alias("weighted"))


@query(f"WITH {STAR} SELECT CASE label WHEN 2 THEN 'ordered' WHEN 1 THEN 'clicked' ELSE 'shown' END AS state, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM st) AS share, min(label) AS score FROM st GROUP BY 1")
def relevance_state(spark, d):
    rows = star(spark, d, "label").groupBy(F.when(F.col("label") == 2, "ordered").when(F.col("label") == 1, "clicked").otherwise("shown").alias("state")).agg(F.count("*").alias("n"), F.min("label").alias("score"))
    return rows.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))


@query(f"WITH {STAR} SELECT genre, count(*) AS n, sum(label) / count(*) AS score FROM (SELECT unnest(genres) AS genre, label FROM st) GROUP BY 1")
def relevance_by_genre(spark, d):
    return star(spark, d, "genres label").select(F.explode("genres").alias("genre"), "label").groupBy("genre").agg(F.count("*").alias("n"), (F.sum("label") / F.count("*")).alias("score"))


@query(f"WITH {STAR} SELECT date, count(*) AS n FROM st WHERE date > (SELECT max(date) FROM st) - 30 GROUP BY 1")
def lookback_window(spark, d):
    return measures.lookback(star(spark, d, "date"), 30).groupBy("date").agg(F.count("*").alias("n"))


# --- tables and SQL


@query("SELECT c_mktsegment, count(*) FILTER (WHERE r_name = 'ASIA') AS asia, count(*) FILTER (WHERE r_name = 'EUROPE') AS europe FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def pivot_counts(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    out = rows.groupBy("c_mktsegment").pivot("r_name", ["ASIA", "EUROPE"]).agg(F.count(F.lit(1)))
    return out.select("c_mktsegment", F.coalesce("ASIA", F.lit(0)).alias("asia"), F.coalesce("EUROPE", F.lit(0)).alias("europe"))


@query("""SELECT o_orderpriority, """ + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}_n, min(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS {s}_min, max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS {s}_max, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 4) AS {s}_avg" for s in "OF") + " FROM orders GROUP BY 1")
def pivot_multi_agg(spark, d):
    p = F.col("o_totalprice")
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F"]).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("min"), F.max(p).alias("max"), F.round(F.avg(p), 4).alias("avg"))
    return out.fillna(0, ["O_n", "F_n"])


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def _sql(name: str, tables: str, text: str, oracle: str | None = None):
    def run(spark, d):
        for t in tables.split():
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    query(oracle or text)(run)


_BINS = "CASE WHEN l_discount > 0.09 THEN '0.09+' WHEN l_discount > 0.05 THEN '0.05-0.09' WHEN l_discount > 0.01 THEN '0.01-0.05' ELSE 'low' END"
_sql("sql_projection", "customer", "SELECT c_custkey, c_name, c_acctbal * 2 AS doubled, c_mktsegment = 'BUILDING' AS building FROM customer WHERE c_acctbal > 0")
_sql("sql_constants", "", "SELECT 1 AS one, 'a' AS letter, 2.5 * 2 = 5 AS five")
_sql("sql_having", "customer", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 10")
_sql("sql_multi_agg", "customer", "SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey")
_sql("sql_count_distinct", "lineitem", "SELECT l_shipdate, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_shipdate")
_sql("confidence_bins", "lineitem", f"SELECT l_returnflag, {_BINS} AS bin, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag, {_BINS}")
_sql("confidence_detail", "lineitem", "SELECT l_returnflag, l_linestatus, l_discount FROM lineitem GROUP BY l_returnflag, l_linestatus, l_discount")
_sql("bins_one_source", "lineitem orders", f"SELECT {_BINS} AS bin, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' GROUP BY o_orderkey) o ON l_orderkey = o.o_orderkey GROUP BY {_BINS}")
_sql("bins_other_source", "lineitem orders", f"SELECT {_BINS} AS bin, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1-%' GROUP BY o_orderkey) o ON l_orderkey = o.o_orderkey GROUP BY {_BINS}")
_sql("bins_appeals", "lineitem orders", f"SELECT {_BINS} AS bin, l_returnflag, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderkey) o ON l_orderkey = o.o_orderkey GROUP BY {_BINS}, l_returnflag")
_sql("bins_source_appeals", "lineitem orders", f"SELECT {_BINS} AS bin, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderkey) a ON l_orderkey = a.o_orderkey JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '2-%' GROUP BY o_orderkey) b ON l_orderkey = b.o_orderkey GROUP BY {_BINS}")
_sql("like_filters", "part", "SELECT p_type, count(*) AS n FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE '%b%' OR p_type LIKE 'S%' GROUP BY p_type")
_sql("semi_join", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
_sql("anti_join", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql(
    "theta_prefix_join", "part", "SELECT p_partkey, b.brand FROM part LEFT JOIN (SELECT DISTINCT p_brand AS brand FROM part) b ON startswith(part.p_brand, substring(b.brand, 1, 7)) AND b.brand <> part.p_brand",
    "SELECT p_partkey, b.brand FROM part LEFT JOIN (SELECT DISTINCT p_brand AS brand FROM part) b ON starts_with(part.p_brand, substring(b.brand, 1, 7)) AND b.brand <> part.p_brand",
)
_sql("outer_joins_all", "customer orders", "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
_sql("union_all_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer")
_sql("intersect_except", "customer supplier", "SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
_sql(
    "acquisition_activity", "customer supplier orders",
    "SELECT platform, k, o_orderstatus, count(*) AS n FROM (SELECT 'a' AS platform, c_custkey AS k FROM customer UNION ALL SELECT 'b', s_suppkey FROM supplier) u "
    "JOIN (SELECT * FROM orders WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') o ON o_custkey = k GROUP BY platform, k, o_orderstatus",
)
_sql("cartesian", "nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_sql(
    "sample_by_hash", "customer", "SELECT c_custkey FROM customer WHERE CAST(conv(substr(md5(CAST(c_custkey AS STRING)), 1, 4), 16, 10) AS INT) < 16384",
    "SELECT c_custkey FROM customer WHERE CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4) AS INTEGER) < 16384",
)


_DEVICES = ["F", "O", "P"]


@query("SELECT o_orderpriority AS device, o_totalprice > 150000 AS suspended, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{x}') AS {x}" for x in _DEVICES) + " FROM orders GROUP BY 1, 2")
def device_report(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("device"), (F.col("o_totalprice") > 150000).alias("suspended"), "o_orderstatus")
    return accounts.device_report(rows, "o_orderstatus", _DEVICES)


@query("SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE 'other' END AS geo, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def top_value_bucketing(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.when(F.col("r_name").isin("ASIA", "EUROPE"), F.col("r_name")).otherwise("other").alias("geo")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {EVENTS}, a AS (SELECT user_id, timestamp // 86400 AS day, count(*) AS dau FROM ev GROUP BY 1, 2), f AS (SELECT user_id, min(day) AS f FROM a GROUP BY 1)
    SELECT user_id, CAST(coalesce(sum(dau) FILTER (WHERE day = f + 1), 0) AS BIGINT) AS d1, CAST(coalesce(sum(dau) FILTER (WHERE day = f + 2), 0) AS BIGINT) AS d2,
    CAST(coalesce(sum(dau) FILTER (WHERE day NOT IN (f + 1, f + 2)), 0) AS BIGINT) AS l7, coalesce(sum(dau) FILTER (WHERE day NOT IN (f + 1, f + 2)), 0) > 0 AS wau FROM a JOIN f USING (user_id) GROUP BY 1"""
)
def retention_d1_d2_l7(spark, d):
    daily = events(spark, d).groupBy("user_id", F.expr("timestamp div 86400").alias("day")).agg(F.count("*").alias("dau"))
    rows = daily.withColumn("age", F.col("day") - F.min("day").over(Window.partitionBy("user_id")))
    total = lambda c: F.sum(F.when(c, F.col("dau")).otherwise(0))
    age = F.col("age")
    out = rows.groupBy("user_id").agg(total(age == 1).alias("d1"), total(age == 2).alias("d2"), total((age != 1) & (age != 2)).alias("l7"))
    return out.withColumn("wau", F.col("l7") > 0)


# --- measurements and evaluation


_AUC = f"""{STAR}, r AS (SELECT segment, clicked, score, rank() OVER (PARTITION BY segment ORDER BY score) + (count(*) OVER (PARTITION BY segment, score) - 1) / 2.0 AS rk FROM st)"""


@query(f"WITH {_AUC} SELECT segment, CAST(sum(clicked) AS BIGINT) AS positives, count(*) AS rows, round((sum(rk) FILTER (WHERE clicked = 1) - sum(clicked) * (sum(clicked) + 1) / 2.0) / (sum(clicked) * (count(*) - sum(clicked))), 9) AS auc FROM r GROUP BY 1")
def auc_signals(spark, d):
    return measures.auc(star(spark, d, "segment score clicked"), "score", F.col("clicked") == 1, ["segment"]).withColumn("auc", _r("auc", 9))


@query(
    f"""WITH {STAR}, m AS (SELECT segment, avg(score) AS m, stddev_pop(score) AS s FROM st GROUP BY 1), p AS (SELECT st.segment, clicked, 1 / (1 + exp(-(score - m) / s)) AS p FROM st JOIN m USING (segment))
    SELECT segment, round(avg(-CASE WHEN clicked = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS logloss FROM p GROUP BY 1"""
)
def logloss_signals(spark, d):
    return measures.logloss(star(spark, d, "segment score clicked"), "score", F.col("clicked") == 1, ["segment"]).withColumn("logloss", _r("logloss"))


_NDCG = f"""{STAR}, o AS (SELECT request_id AS slate_id, label, row_number() OVER (PARTITION BY request_id ORDER BY position, item_id, tie, label) AS i, row_number() OVER (PARTITION BY request_id ORDER BY label DESC) AS b FROM st),
  n AS (SELECT slate_id, sum((pow(2, label) - 1) / (ln(i + 1) / ln(2))) FILTER (WHERE i <= 10) AS got, sum((pow(2, label) - 1) / (ln(b + 1) / ln(2))) FILTER (WHERE b <= 10) AS best, min(i) FILTER (WHERE label > 0) AS f FROM o GROUP BY 1)"""


def _label_slates(spark, d):
    rows = star(spark, d, "request_id position item_id tie label").groupBy(F.col("request_id").alias("slate_id")).agg(F.sort_array(F.collect_list(F.struct("position", "item_id", "tie", "label"))).alias("i"))
    return rows.select("slate_id", F.expr("transform(i, x -> x.label)").alias("labels"))


@query(f"WITH {_NDCG} SELECT slate_id, round(CASE WHEN best > 0 THEN got / best END, 6) AS ndcg, coalesce(1.0 / f, 0.0)::DOUBLE AS rr FROM n")
def ndcg_mrr(spark, d):
    return measures.ndcg(_label_slates(spark, d), 10).withColumn("ndcg", _r("ndcg"))


@query(f"WITH {STAR}, s AS (SELECT user_id, request_id, max(clicked) AS hit FROM st WHERE position <= 2 GROUP BY 1, 2), u AS (SELECT user_id, avg(hit) AS recall, max(hit) AS any_hit FROM s GROUP BY 1) SELECT round(avg(recall), 6) AS recall, round(avg(any_hit), 6) AS hit_rate, count(*) AS users FROM u")
def hit_rate_users(spark, d):
    s = star(spark, d, "user_id request_id clicked position").filter("position <= 2").groupBy("user_id", "request_id").agg(F.max("clicked").alias("hit"))
    u = s.groupBy("user_id").agg(F.avg("hit").alias("recall"), F.max("hit").alias("any_hit"))
    return u.agg(_r(F.avg("recall")).alias("recall"), _r(F.avg("any_hit")).alias("hit_rate"), F.count("*").alias("users"))


_BM25 = """dt AS (SELECT p_partkey AS doc, string_split(lower(p_name), ' ') AS terms FROM part), qs AS (SELECT DISTINCT p_partkey AS query, unnest(string_split(lower(p_name), ' ')) AS term FROM part WHERE p_partkey % 100 = 0),
  po AS (SELECT doc, len(terms) AS len, unnest(terms) AS term FROM dt), tf AS (SELECT doc, len, term, count(*) AS tf FROM po GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), g AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM dt),
  sc AS (SELECT query, doc, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM tf JOIN qs USING (term) JOIN df USING (term), g GROUP BY 1, 2)"""


def _bm25(spark, d, digits=None):
    """Searches with every part whose key is divisible by 100 against all parts."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.split(F.lower("p_name"), " ").alias("terms"))
    return measures.bm25(parts, parts.filter("doc % 100 = 0").select(F.col("doc").alias("query"), F.explode(F.array_distinct("terms")).alias("term")), digits=digits)


@query(f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score FROM sc")
def bm25_scores(spark, d):
    return _bm25(spark, d, 6)


_RRF = f"""{STAR}, i AS (SELECT segment, item_id, count(*) AS n, CAST(sum(clicked) AS BIGINT) AS c FROM st GROUP BY 1, 2), a AS (SELECT segment, item_id, row_number() OVER (PARTITION BY segment ORDER BY n DESC, item_id) AS r FROM i), b AS (SELECT segment, item_id, row_number() OVER (PARTITION BY segment ORDER BY c DESC, item_id) AS r FROM i),
  f AS (SELECT segment, item_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM a WHERE r <= 20 UNION ALL SELECT * FROM b WHERE r <= 20) GROUP BY 1, 2)"""


@query(f"WITH {_RRF} SELECT segment, item_id, round(score, 9) AS score FROM f")
def rrf_fusion(spark, d):
    i = star(spark, d, "segment item_id clicked").groupBy("segment", "item_id").agg(F.count("*").alias("n"), F.sum("clicked").alias("c"))
    lists = [measures.rank_within(i, ["segment"], [F.desc(c), F.col("item_id")], 20) for c in ("n", "c")]
    return measures.rrf(lists, ["segment", "item_id"]).withColumn("score", _r("score", 9))


@query(f"WITH {STAR}, g AS (SELECT request_id, unnest(genres) AS genre FROM st), n AS (SELECT request_id, genre, count(*) AS n FROM g GROUP BY 1, 2), p AS (SELECT request_id, n / sum(n) OVER (PARTITION BY request_id) AS p FROM n) SELECT request_id, count(*) AS values, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1")
def genre_entropy(spark, d):
    return measures.entropy(star(spark, d, "request_id genres").select("request_id", F.explode("genres").alias("genre")), "request_id", "genre").withColumn("entropy", _r("entropy"))


@query(
    f"""WITH {STAR}, o AS (SELECT request_id, item_id, position, tie, label, list_distinct(genres) AS g, row_number() OVER (PARTITION BY request_id ORDER BY position, item_id, tie, label) AS i FROM st)
    SELECT a.request_id, round(avg(CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g)))), 6) AS similarity FROM o a JOIN o b ON a.request_id = b.request_id AND a.i < b.i GROUP BY 1"""
)
def intra_list_jaccard(spark, d):
    rows = star(spark, d, "request_id position item_id tie label genres").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("position", "item_id", "tie", "label", F.array_distinct("genres").alias("g")))).alias("xs"))
    pairs = rows.select("request_id", "xs", F.posexplode("xs").alias("i", "a")).select("request_id", "a", F.explode(F.expr("slice(xs, i + 2, size(xs))")).alias("b"))
    return pairs.groupBy("request_id").agg(_r(F.avg(F.size(F.array_intersect("a.g", "b.g")).cast("double") / F.size(F.array_union("a.g", "b.g")))).alias("similarity"))


@query(f"WITH {STAR}, c AS (SELECT item_id, count(*) AS n FROM st GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n, item_id) AS i FROM c) SELECT round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 9) AS gini FROM r")
def exposure_gini(spark, d):
    return measures.gini(star(spark, d, "item_id").groupBy("item_id").agg(F.count("*").alias("n"))).select(_r("gini", 9).alias("gini"))


@query(f"WITH {STAR}, c AS (SELECT item_id, count(*) AS n FROM st GROUP BY 1), q AS (SELECT quantile_cont(n, 0.8) AS cut FROM c) SELECT CAST(sum(n) FILTER (WHERE n < cut) AS DOUBLE) / sum(n) AS share FROM c, q")
def long_tail_share(spark, d):
    c = star(spark, d, "item_id").groupBy("item_id").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.percentile("n", 0.8).alias("cut")))).agg(ratio(F.sum(F.when(F.col("n") < F.col("cut"), F.col("n"))), F.sum("n")).alias("share"))  # cut is one row


@query(f"WITH {EVENTS}, r AS (SELECT row_number() OVER (PARTITION BY user_id, item_id ORDER BY timestamp_ms, event_id) AS n FROM ev) SELECT CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*) AS repeat_rate FROM r")
def repeat_rate(spark, d):
    # every event of a pair but its first is a repeat: counts are enough
    n = events(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    return n.agg(ratio(F.sum(F.col("n") - 1), F.sum("n")).alias("repeat_rate"))


@query(
    f"""WITH {STAR}, i AS (SELECT segment, item_id, sum(clicked) AS c, count(*) AS n FROM st GROUP BY 1, 2), p AS (SELECT segment, CAST(sum(c) AS DOUBLE) / sum(n) AS p FROM i GROUP BY 1)
    SELECT i.segment, CAST(sum(n) AS BIGINT) AS rows, count(*) AS clusters, any_value(p) AS rate, round(sqrt(sum(pow(c - p * n, 2)) / pow(sum(n), 2) * count(*) / (count(*) - 1)), 9) AS se FROM i JOIN p USING (segment) GROUP BY 1"""
)
def ctr_gap_clustered(spark, d):
    return measures.clustered_rate(star(spark, d, "segment item_id clicked"), "item_id", "clicked", ["segment"]).withColumn("se", _r("se", 9))


@query(f"WITH {EVENTS}, b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM ev) SELECT least((timestamp - lo) * 24 // greatest(hi - lo, 1), 23) AS bucket, count(*) AS n, count(rating) AS rated, round(avg(rating), 6) AS rating FROM ev, b GROUP BY 1")
def satisfaction_series(spark, d):
    ev = events(spark, d)
    rows = ev.crossJoin(F.broadcast(ev.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))))  # one row
    return rows.groupBy(F.expr("least((timestamp - lo) * 24 div greatest(hi - lo, 1), 23)").alias("bucket")).agg(F.count("*").alias("n"), F.count("rating").alias("rated"), _r(F.avg("rating")).alias("rating"))


@query(f"WITH {EVENTS} SELECT floor(rating * 2) / 2 AS bin, count(*) AS n FROM ev WHERE rating IS NOT NULL GROUP BY 1")
def rating_histogram(spark, d):
    return events(spark, d).filter("rating IS NOT NULL").groupBy((F.floor(F.col("rating") * 2) / 2).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT DISTINCT request_id, list_sum(list_transform(string_split(md5(request_id), ''), lambda x: strpos('0123456789abcdef', x) - 1)) % 5 = 0 AS test FROM ev")
def md5_split(spark, d):
    return events(spark, d).select("request_id").distinct().withColumn("test", held_out(F.col("request_id")))


_GAPS = f"""{EVENTS}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) > 86400 THEN 1 ELSE 0 END AS new FROM ev), ss AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS BIGINT) AS session FROM g)"""


def _gaps(spark, d):
    return measures.sessions(events(spark, d).withColumn("ts", F.col("timestamp")), 86400, ["event_id"])


@query(f"WITH {_GAPS} SELECT event_id, user_id, session FROM ss")
def session_gaps(spark, d):
    return _gaps(spark, d).select("event_id", "user_id", "session")


@query(f"WITH {_GAPS}, t AS (SELECT event_id, item_id AS state, lead(item_id) OVER (PARTITION BY user_id, session ORDER BY timestamp, event_id) AS next_state FROM ss) SELECT *, next_state IS NULL AS terminal FROM t")
def transitions_lead(spark, d):
    return measures.transitions(_gaps(spark, d).withColumn("state", F.col("item_id")), ["ts", "event_id"]).select("event_id", "state", "next_state", "terminal")


@query(f"WITH {SAMPLES} SELECT a.request_id, a.item_id AS chosen, b.item_id AS rejected FROM sm a JOIN sm b USING (request_id) WHERE a.clicked = 1 AND b.clicked = 0")
def preference_pairs(spark, d):
    return measures.preference_pairs(_samples(spark, d))


@query(f"WITH {SAMPLES} SELECT count(*) AS pairs, round(avg(CASE WHEN a.position > b.position THEN 1 WHEN a.position = b.position THEN 0.5 ELSE 0 END), 9) AS auc FROM sm a JOIN sm b USING (request_id) WHERE a.clicked = 1 AND b.clicked = 0")
def pairwise_auc(spark, d):
    s = _samples(spark, d)
    pairs = s.filter("clicked = 1").select("request_id", F.col("position").alias("p")).join(s.filter("clicked = 0").select("request_id", F.col("position").alias("q")), "request_id")
    return pairs.agg(F.count("*").alias("pairs"), _r(F.avg(F.when(F.col("p") > F.col("q"), 1.0).when(F.col("p") == F.col("q"), 0.5).otherwise(0.0)), 9).alias("auc"))


@query(
    f"""WITH {EVENTS}, q AS (SELECT CAST(floor(quantile_cont(timestamp, 0.9)) AS BIGINT) AS cut FROM ev), tr AS (SELECT ev.* FROM ev, q WHERE timestamp <= cut), te AS (SELECT ev.* FROM ev, q WHERE timestamp > cut),
    tg AS (SELECT user_id, arg_min(item_id, (timestamp_ms, event_id)) AS target FROM te GROUP BY 1), pop AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM tr GROUP BY 1)
    SELECT count(*) AS targets, CAST(count(*) FILTER (WHERE rank <= 5) AS DOUBLE) / count(*) AS hit5, round(sum(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END) / count(*), 9) AS mrr10 FROM tg LEFT JOIN pop ON target = item_id"""
)
def next_item_baselines(spark, d):
    ev = events(spark, d)
    ev = ev.crossJoin(F.broadcast(ev.agg(F.floor(F.percentile("timestamp", 0.9)).alias("cut"))))  # one row
    target = ev.filter("timestamp > cut").groupBy("user_id").agg(F.min_by("item_id", F.struct("timestamp_ms", "event_id")).alias("item_id"))
    popular = ev.filter("timestamp <= cut").groupBy("item_id").agg(F.count("*").alias("n"))
    # no rank beyond 10 counts, so a top-k comes before the window
    popular = popular.orderBy(F.desc("n"), "item_id").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")))
    rows = target.join(popular, "item_id", "left")
    return rows.agg(F.count("*").alias("targets"), ratio(F.sum(flag(F.col("rank") <= 5)), F.count("*")).alias("hit5"), _r(F.sum(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)) / F.count("*"), 9).alias("mrr10"))


@query(f"WITH {STAR}, b AS (SELECT request_id, arg_max(label, (score, item_id, tie, label)) AS r FROM st GROUP BY 1) SELECT avg(r) AS value, count(*) AS n FROM b")
def policy_picks(spark, d):
    best = star(spark, d, "request_id label score item_id tie").groupBy("request_id").agg(F.max_by("label", F.struct("score", "item_id", "tie", "label")).alias("r"))
    return best.agg(F.avg("r").alias("value"), F.count("*").alias("n"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("x").alias("y"))
    return v.join(w, "vec_id").select(F.col("vec_id").alias("a"), "b", _r(cosine(F.col("x"), F.col("y"))).alias("cosine"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def conversation_sequences(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", "turns", F.expr("array_join(transform(r, x -> x.role), '>')").alias("roles"))


@query()
def tabular_q_values(spark, d):
    steps = measures.transitions(_gaps(spark, d).withColumn("state", F.col("item_id")), ["ts", "event_id"])
    steps = steps.select("state", F.col("event_type").alias("action"), F.when(F.col("event_type") == "order", 1.0).otherwise(0.0).alias("reward"), "next_state", "terminal")
    return learning.tabular_q(steps, sweeps=20, tolerance=1e-3).select("state", "action", _r("q").alias("q"))


@query()
def als_embeddings(spark, d):
    users, _ = learning.als_vectors(_ratings(spark, d))
    return users.select("user_id", F.posexplode("vector").alias("i", "x"))


@query("SELECT CAST(10 AS BIGINT) * 1024 * 86400 * 7 * 3 AS bytes")
def topic_capacity(spark, d):
    n = learning.topic_capacity(10, 1024, 7, 3, 1.0)
    return spark.range(1).select(F.lit(n).cast("long").alias("bytes"))


_OPE = f"""{STAR}, sc AS (SELECT request_id, 'logging' AS policy, avg(label) AS r FROM st GROUP BY 1 UNION ALL SELECT request_id, 'score', arg_max(label, (score, item_id, label)) FROM st GROUP BY 1
    UNION ALL SELECT request_id, 'price', arg_max(label, (price, item_id, label)) FROM st GROUP BY 1)"""


def _policy_scores(spark, d):
    actions = F.collect_list(F.struct(F.col("item_id").alias("item"), "score", "price", "label"))
    events_ = star(spark, d, "request_id label score price item_id").groupBy("request_id").agg(F.avg("label").alias("reward"), actions.alias("actions"))
    return offpolicy.policy_scores(events_, {"score": lambda a: a["score"], "price": lambda a: a["price"]}, lambda a: a["label"])


@query(f"WITH {_OPE} SELECT policy, count(*) AS n, round(avg(r), 6) AS value FROM sc GROUP BY 1")
def ope_values(spark, d):
    return _policy_scores(spark, d).groupBy("policy").agg(F.count("*").alias("n"), _r(F.avg("r")).alias("value"))


@query(
    f"""WITH {_OPE}, g AS (SELECT CAST(floor(CAST('0x' || substr(md5(request_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * {offpolicy.GROUPS}) AS BIGINT) AS g, policy, sum(r) AS s, count(*) AS n FROM sc GROUP BY 1, 2),
    u AS (SELECT g.*, i, CAST('0x' || substr(md5('7:' || g || ':' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM g, range(1, {offpolicy.REPLICATES + 1}) k(i)),
    w AS (SELECT *, list_sum(list_transform([{', '.join(map(repr, offpolicy.POISSON))}], lambda c: CAST(u >= c::DOUBLE AS INTEGER))) AS w FROM u),
    v AS (SELECT i, policy, CAST(sum(s * w) AS DOUBLE) / CAST(sum(n * w) AS DOUBLE) AS value FROM w GROUP BY 1, 2 HAVING sum(n * w) > 0),
    l AS (SELECT v.*, CASE WHEN b.value <> 0 THEN v.value / b.value - 1 END AS lift FROM v LEFT JOIN v b ON b.i = v.i AND b.policy = 'logging'),
    b AS (SELECT policy, quantile_cont(value, 0.025) AS vl, quantile_cont(value, 0.975) AS vh, quantile_cont(lift, 0.025) AS ll, quantile_cont(lift, 0.975) AS lh FROM l GROUP BY 1),
    p AS (SELECT policy, CAST(sum(n) AS BIGINT) AS n, sum(s) / sum(n) AS value FROM g GROUP BY 1)
    SELECT p.policy, p.n, round(p.value, 6) AS value, round(p.value / o.value - 1, 6) + 0.0 AS lift, round(vl, 6) AS value_low, round(vh, 6) AS value_high, round(ll, 6) AS lift_low, round(lh, 6) AS lift_high
    FROM p JOIN b USING (policy), p o WHERE o.policy = 'logging'"""
)
def ope_bootstrap(spark, d):
    got = offpolicy.bootstrap(_policy_scores(spark, d))
    return got.select("policy", "n", *[(_r(c) + 0.0).alias(c) for c in ("value", "lift", "value_low", "value_high", "lift_low", "lift_high")])


_PAIRS = f"{SAMPLES}, pr AS (SELECT a.position * 0.5::DOUBLE AS c, b.position * 0.5::DOUBLE AS r, a.position * 0.1::DOUBLE AS cr, b.position * 0.1::DOUBLE AS rr FROM sm a JOIN sm b USING (request_id) WHERE a.clicked = 1 AND b.clicked = 0)"


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, round(avg(ln(1 + exp(-(c - r - cr + rr)))), 6) AS loss, round(avg(CASE WHEN c > r THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr")
def preference_loss(spark, d):
    s = _samples(spark, d)
    side = lambda name: [(F.col("position") * 0.5).alias(f"{name}_score"), (F.col("position") * 0.1).alias(f"{name}_ref")]
    pairs = s.filter("clicked = 1").select("request_id", *side("chosen")).join(s.filter("clicked = 0").select("request_id", *side("rejected")), "request_id")
    return fitting.preference_loss(pairs).select("pairs", _r("loss").alias("loss"), _r("accuracy").alias("accuracy"))


_RESPONSES = f"""{STAR}, o AS (SELECT request_id, lower(trim(min(segment))) AS sub, min(geo) AS land, count(*) AS n, count(*) FILTER (WHERE status = 'O') AS ads FROM st GROUP BY 1),
    b AS (SELECT CASE WHEN sub IN ('building', 'machinery') THEN sub ELSE 'other' END AS subscription, CASE WHEN land IN ('ASIA', 'EUROPE') THEN lower(land) ELSE 'other' END AS land, ads, n - ads AS rest FROM o),
    m AS (SELECT 'total' AS type, NULL AS stage, subscription, NULL AS country, NULL AS blender, 1 AS value FROM b UNION ALL SELECT 'total', NULL, subscription, land, NULL, 1 FROM b
      UNION ALL SELECT 'items', NULL, subscription, NULL, 'default', rest FROM b UNION ALL SELECT 'ads', NULL, subscription, NULL, 'default', ads FROM b
      UNION ALL SELECT 'empty_ads', 'response', subscription, NULL, 'default', CAST(ads = 0 AS INTEGER) FROM b UNION ALL SELECT 'empty_items', 'response', subscription, NULL, 'default', CAST(rest = 0 AS INTEGER) FROM b
      UNION ALL SELECT 'sufficient_ads', 'response', subscription, NULL, 'default', CAST(ads >= 5 AS INTEGER) FROM b UNION ALL SELECT 'sufficient_items', 'response', subscription, NULL, 'default', CAST(rest >= 20 AS INTEGER) FROM b
      UNION ALL SELECT 'feedback_delay_ms', NULL, CASE WHEN lower(trim(segment)) IN ('building', 'machinery') THEN lower(trim(segment)) ELSE 'other' END, CASE WHEN geo IN ('ASIA', 'EUROPE') THEN lower(geo) ELSE 'other' END, NULL, position - 2 FROM st WHERE position >= 2)"""


@query(f"WITH {_RESPONSES} SELECT type, stage, subscription, country, blender, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM m WHERE value > 0 OR type = 'feedback_delay_ms' GROUP BY ALL")
def response_metrics(spark, d):
    item = F.struct(F.create_map(F.lit("type"), F.when(F.col("status") == "O", "Ads").otherwise("film")).alias("item_features"), (F.col("position") - 2).alias("feedback_delay_ms"))
    slates = star(spark, d, "request_id status position segment geo").groupBy("request_id").agg(F.collect_list(item).alias("items"), F.create_map(F.lit("subscription"), F.min("segment"), F.lit("country"), F.min("geo")).alias("user_features"))
    slates = slates.withColumn("context_features", F.create_map().cast("map<string,string>"))
    got = samples.response_metrics(slates, ("BUILDING", "MACHINERY"), ("ASIA", "EUROPE"))
    return got.groupBy("type", "stage", "subscription", "country", "blender").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query(
    f"""WITH {STAR}, p AS (SELECT sum(clicked) / CAST(count(*) AS DOUBLE) AS p0 FROM st), c AS (SELECT segment, geo, brand, sum(clicked) AS c, count(*) AS n FROM st GROUP BY 1, 2, 3),
    g AS (SELECT segment, geo, CAST(sum(n) AS BIGINT) AS impressions, CAST(sum(c) AS BIGINT) AS clicks, sum(c) / CAST(sum(n) AS DOUBLE) AS rate, sum((c - p0 * n) ** 2) AS s, count(*) AS m, any_value(p0) AS p0 FROM c, p GROUP BY 1, 2)
    SELECT segment, geo, impressions, clicks, round(rate, 6) AS rate, CASE WHEN m > 1 AND s > 1e-12 AND p0 > 0 AND p0 < 1 THEN round((rate - p0) / sqrt(s / (impressions::DOUBLE * impressions) * m / (m - 1)), 6) END AS z FROM g"""
)
def grid_z(spark, d):
    return measures.grid(star(spark, d, "segment geo brand clicked"), "segment", "geo", "brand", "clicked").withColumns({"rate": _r("rate"), "z": _r("z")})


@query(
    """WITH m AS (SELECT string_split(lower(p_name), ' ') AS g FROM part), s AS (SELECT * FROM m WHERE len(g) > 1)
    SELECT count(*) AS items, round(avg(CASE WHEN g = list_sort(g) THEN 1.0 ELSE 0.0 END), 6) AS sorted_share, round(avg(1.0::DOUBLE / factorial(least(len(g), 20)::INTEGER)::DOUBLE), 6) AS chance_share FROM s"""
)
def genre_order(spark, d):
    got = measures.sorted_share(table(spark, d, "part").select(F.split(F.lower("p_name"), " ").alias("genres")))
    return got.select("items", _r("sorted_share").alias("sorted_share"), _r("chance_share").alias("chance_share"))


@query(
    f"""WITH {STAR}, g AS (SELECT segment AS grp, request_id, position, item_id, label, row_number() OVER (PARTITION BY segment, request_id ORDER BY position, item_id, label) AS i,
      row_number() OVER (PARTITION BY segment, request_id ORDER BY label DESC) AS j FROM st),
    s AS (SELECT grp, request_id, sum(CASE WHEN i <= 10 THEN (2.0::DOUBLE ** label - 1) / log2(i + 1) ELSE 0 END) AS got, sum(CASE WHEN j <= 10 THEN (2.0::DOUBLE ** label - 1) / log2(j + 1) ELSE 0 END) AS best FROM g GROUP BY 1, 2)
    SELECT grp, count(*) FILTER (WHERE best > 0) AS slates, round(avg(got / best) FILTER (WHERE best > 0), 6) AS ndcg FROM s GROUP BY 1"""
)
def fairness_ndcg(spark, d):
    return measures.group_ndcg(star(spark, d, "segment request_id position item_id label"), "segment").withColumn("ndcg", _r("ndcg"))


@query(
    f"""WITH {SAMPLES}, u AS (SELECT 'rating' AS signal, rating::DOUBLE AS v FROM sm UNION ALL SELECT 'abandoned', abandoned FROM sm UNION ALL SELECT 'feedback_delay_ms', feedback_delay_ms FROM sm)
    SELECT signal, count(v) AS n, round(CAST(count(v) AS DOUBLE) / count(*), 6) AS coverage, round(avg(v), 6) AS mean FROM u GROUP BY 1"""
)
def satisfaction_means(spark, d):
    return measures.means(_samples(spark, d), ["rating", "abandoned", "feedback_delay_ms"]).withColumns({"coverage": _r("coverage"), "mean": _r("mean")})


_SPLIT = f"""{EVENTS}, q AS (SELECT CAST(floor(quantile_cont(timestamp, 0.9)) AS BIGINT) AS cut FROM ev), tr AS (SELECT ev.* FROM ev, q WHERE timestamp <= cut), te AS (SELECT ev.* FROM ev, q WHERE timestamp > cut),
    tg AS (SELECT user_id, arg_min(item_id, (timestamp_ms, event_id)) AS item_id FROM te GROUP BY 1)"""


@query(
    f"""WITH {_SPLIT}, l AS (SELECT user_id, item_id, max((timestamp_ms, event_id)) AS latest FROM tr GROUP BY 1, 2), r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, item_id) AS rank FROM l),
    j AS (SELECT rank FROM tg LEFT JOIN (SELECT * FROM r WHERE rank <= 20) USING (user_id, item_id))
    SELECT count(*) AS targets, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS hit20,
      round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg10 FROM j"""
)
def next_item_repeat_last(spark, d):
    ev = events(spark, d)
    ev = ev.crossJoin(F.broadcast(ev.agg(F.floor(F.percentile("timestamp", 0.9)).alias("cut"))))  # one row
    target = ev.filter("timestamp > cut").groupBy("user_id").agg(F.min_by("item_id", F.struct("timestamp_ms", "event_id")).alias("item_id"))
    got = measures.ranking_metrics(target, measures.repeat_last(ev.filter("timestamp <= cut"), 20))
    return got.select("targets", *[_r(c).alias(c) for c in ("hit5", "hit10", "hit20", "mrr10", "ndcg10")])


@query()
def loo_recall(spark, d):
    items = table(spark, d, "benchmark")
    docs = items.select(F.col("item_id").cast("string").alias("doc"), F.split(F.lower("text"), r"\W+").alias("terms"))
    n = F.broadcast(items.agg(F.count("*").alias("items")))  # one row
    clicks = events(spark, d).filter("event_type IN ('click', 'order')").crossJoin(n).select("user_id", F.expr("CAST((k * 7 + CAST(user_id AS BIGINT)) % items AS STRING)").alias("item_id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return recall.leave_one_out(clicks, docs, vectors).select("method", "k", _r("recall").alias("recall"), _r("hit_rate").alias("hit_rate"), "users", "instances")


from rivulet.plans import io_queries, report_queries  # noqa: E402, F401  (they add their queries to QUERIES)
