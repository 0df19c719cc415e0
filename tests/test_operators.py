"""Semantics of samples, sequences, gates and measures on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions.columns import Gate, cosine, cutoff_ms, held_out, interval_seconds
from rivulet.operators import learning, measures, samples

EVENT = "event_id string, request_id string, session_id string, user_id string, item_id string, event_type string, timestamp bigint, timestamp_ms bigint, position int, rating double"


def ev(spark, *rows):
    return spark.createDataFrame([(str(i), "r", "s", "u", item, kind, t, t * 1000, pos, rating) for i, (item, kind, t, pos, rating) in enumerate(rows)], EVENT)


def test_labels(spark):
    df = ev(spark, ("a", "impression", 1, 0, None), ("a", "click", 2, None, None), ("b", "exposure", 1, 1, None), ("b", "purchase", 5, None, None), ("c", "impression", 1, 2, None), ("d", "click", 1, 3, None))
    got = {r["item_id"]: (r["clicked"], r["ordered"], r["label"], r["feedback_delay_ms"]) for r in samples.build_samples(df).collect()}
    assert got == {"a": (1, 0, 1.0, 1000), "b": (0, 1, 2.0, 4000), "c": (0, 0, 0.0, None)}


def test_latest_value_that_is_not_null(spark):
    df = ev(spark, ("a", "impression", 1, 0, None), ("a", "click", 2, None, 3.0), ("a", "thumb_up", 3, None, 4.0), ("a", "abandon", 9, None, None))
    r = samples.build_samples(df).first()
    assert (r["rating"], r["last_feedback_ts"], r["thumb"], r["abandoned"]) == (4.0, 2, 1, 1)


FULL = EVENT + ", model_version string, new_release boolean, device string, item_features map<string,string>"


def test_two_impressions(spark):
    """Position and time are the largest, what was measured is the last impression's, the thumb is the latest, seconds stand in for missing milliseconds."""
    rows = [
        ("3", "r", None, "u", "a", " Impression ", 9, None, 2, None, "m2", None, None, {"x": "late"}),
        ("1", "r", "s", "u", "a", "exposure", 1, 1250, 5, None, "m1", True, "tv", {"x": "early"}),
        ("4", "r", "s", "u", "a", "thumb_up", 10, 10_000, None, None, None, None, None, None),
        ("5", "r", "s", "u", "a", "click", 12, None, None, 3.0, None, None, "phone", None),
        ("6", "r", "s", "u", "a", "thumb_down", 13, 13_000, None, None, None, None, None, None),
        ("7", "r", "s", "u", "b", "impression", 4, 4000, None, None, None, None, None, None),
        ("8", "r", "s", "u", "c", "click", 4, 4000, 1, None, None, None, None, None),
    ]
    got = {r["item_id"]: r.asDict() for r in samples.build_samples(spark.createDataFrame(rows, FULL)).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"} and (a["position"], a["impression_ts"], a["feedback_delay_ms"], a["last_feedback_ts"]) == (5, 9, 3000, 12)
    assert (a["model_version"], a["new_release"], a["device"], a["item_features"], a["session_id"], a["thumb"], a["rating"]) == ("m2", None, "tv", {"x": "early"}, "s", -1, 3.0)
    assert (b["position"], b["thumb"], b["feedback_delay_ms"], b["item_features"], b["abandoned"], b["label"]) == (None, None, None, {}, 0, 0.0)
    slate = samples.build_slates(samples.build_samples(spark.createDataFrame(rows, FULL))).first()
    assert [i["item_id"] for i in slate["items"]] == ["a", "b"] and slate["items"][0].asDict().keys() == set(samples.ITEM) and len(samples.ITEM) == 19
    assert (slate["slate_id"], slate["session_id"], slate["slate_size"], slate["slate_reward"]) == ("r:u", "s", 2, 1.0)


def test_gates_of_jobs(spark):
    joined = samples.joiner_gate(spark.createDataFrame([("r", "u", "i", "click", 5), (None, None, "i", "click", 5), ("r", "u", "i", None, None)], "request_id string, user_id string, item_id string, event_type string, timestamp bigint"))
    assert {r["reason"]: r["n"] for r in joined.counts().collect()} == {"kept": 1, "null_request_id": 1, "null_user_id": 0, "null_item_id": 0, "null_event_type": 1, "null_timestamp": 0}
    rows = [("1", "u", "search", None, 1, "q", "words"), ("2", "u", "search", None, 1, "q", " "), ("3", None, "click", None, 1, None, None), ("4", "u", "click", " ", 1, None, None), ("5", "u", "result_view", "i", 1, "q", None), ("6", "u", "order", None, 1, None, None)]
    events = spark.createDataFrame(rows, "event_id string, user_id string, event_type string, item_id string, timestamp_ms bigint, query_id string, query_text string")
    gate = samples.behaviour_gate(events)
    assert {r["reason"]: r["n"] for r in gate.counts().filter("n > 0").collect()} == {"kept": 1, "missing_search_query": 1, "null_user_id": 1, "missing_behavior_item": 1, "missing_result_identity": 1}
    assert [(r["item_id"], r["kind"]) for r in samples.behaviour_sequence(gate.kept).collect()] == [("", "behavior")] and samples.click_sequence(events).count() == 0 + 1
    chunkable = spark.createDataFrame([("u,1", "i"), ("u", "i|2"), ("u", "i"), ("u", None)], "user_id string, item_id string")
    assert samples.identifier_gate(chunkable).rejected.count() == 2


def test_context_updates_and_upserts(spark):
    events = spark.createDataFrame(
        [("u", "i", "rating", 5, 4.0, None, None), ("u", "j", "Rating ", 6, 2.0, None, None), ("u", None, "profile", 7, None, 30, None), ("u", "i", "film", 8, None, None, "T"), ("u", None, "x", 9, None, None, None)],
        "user_id string, item_id string, event_type string, timestamp bigint, rating double, age int, title string",
    )
    gate = samples.context_gate(events)
    assert {r["reason"]: r["n"] for r in gate.counts().collect()} == {"kept": 4, "unclassifiable_shape": 1}
    update = samples.user_feature_updates(gate.kept)
    once = samples.upsert_users(None, update)
    twice = samples.upsert_users(once, update).first()
    assert (twice["ratingCount"], twice["ratingSum"], twice["avgRating"], twice["recentlyRatedMovieIds"], twice["age"], twice["lastUpdatedTs"]) == (4, 12.0, 3.0, ["j", "i"], 30, 7)
    film = samples.movie_feature_updates(gate.kept)
    newer = spark.createDataFrame([("i", None, None, 1999, 20)], film.schema)
    assert samples.upsert_movies(film, newer).first()[:] == ("i", "T", None, 1999, 20)


def test_gate_counts_zeros_and_first_reason(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    gate = Gate(df, [("no_a", F.col("a").isNotNull()), ("no_b", F.col("b").isNotNull()), ("never", F.lit(True))])
    assert {r["reason"]: r["n"] for r in gate.counts().collect()} == {"kept": 1, "no_a": 1, "no_b": 1, "never": 0}
    assert gate.kept.collect()[0]["a"] == 3
    with pytest.raises(ValueError):
        Gate(df, [])


def test_intervals():
    assert interval_seconds("1 day 2 hours") == 93600
    for bad in ("1 month", "soon", "1 day soon"):
        with pytest.raises(ValueError):
            interval_seconds(bad)
    march = 1_711_843_200_123  # 2024-03-31
    assert cutoff_ms(march, "1 month") == 1_709_164_800_123 and cutoff_ms(march, "interval 1 year 2 hours") == 1_680_220_800_123 - 7_200_000 and cutoff_ms(march, "90 seconds") == march - 90_000


def test_md5_split(spark):
    import hashlib

    ids = [f"r{i}" for i in range(60)]
    got = {r["x"]: r["t"] for r in spark.createDataFrame([(i,) for i in ids], "x string").select("x", held_out(F.col("x")).alias("t")).collect()}
    assert got == {i: int(hashlib.md5(i.encode()).hexdigest(), 16) % 5 == 0 for i in ids}


def test_chunks_round_trip_ragged_and_empty(spark):
    rows = spark.createDataFrame(
        [("u", "k", "a", 86_400_000, "cl,ick", None, ["x|y", "z"], 1999), ("u", "k", None, 86_400_001, "view", 2.0, None, None), ("u", "k", "b,c", 86_400_002, "view", 2.0, None, None)],
        "user_id string, kind string, item_id string, ts bigint, action string, rating double, genres array<string>, release_year int",
    )
    chunk = samples.to_chunks(rows)
    r = chunk.first()
    assert (r["item_id"], r["action"], r["rating"], r["genres"], r["release_year"], r["bucket"], r["n"]) == ("a,", "click,view", ",2.0", "xy|z,", "1999,", "19700102", 2)
    assert [x["action"] for x in samples.explode_chunks(chunk).orderBy("i").collect()] == ["click", "view"]
    ragged = spark.createDataFrame([("u", "k", "b", "x,y,z", "1,2", "p,q,r", ",,", ",,", ",,", 3), ("u", "k", "c", "", "", "", "", "", "", 0), ("u", "k", "d", "", "", "", "", "", "", 1)], chunk.schema)
    assert {r["bucket"]: r["count"] for r in samples.explode_chunks(ragged).groupBy("bucket").count().collect()} == {"b": 2, "d": 1}


def test_top_k_over_blocks_and_widths(spark):
    r = np.random.default_rng(3)
    vec = lambda n: [float(x) for x in r.integers(-3, 4, n)]
    items = [(i, vec(int(r.integers(1, 6)))) for i in range(60)]
    users = [(i, vec(int(r.integers(1, 6)))) for i in range(25)]
    got = measures.top_k_cosine(spark.createDataFrame(users, "user_id int, vector array<double>"), spark.createDataFrame(items, "item_id int, vector array<double>"), 5, block=8)

    def cos(a, b):
        n = min(len(a), len(b))
        a, b = np.array(a[:n]), np.array(b[:n])
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / scale) if scale else 0.0

    found = {}
    for x in got.collect():
        found.setdefault(x["user_id"], {})[x["rank"]] = (x["item_id"], x["score"])
    for u, v in users:
        best = sorted((round(-cos(v, w), 9), i) for i, w in items)[:5]
        assert [round(-found[u][k][1], 9) for k in range(1, 6)] == [b[0] for b in best]


def test_profile_document(spark):
    """A reader with one click on a recent release, as the contract's golden document has it."""
    import json

    from rivulet.operators import profiles

    cfg = profiles.ProfileConfig(reference=1000)
    rows = spark.createDataFrame([("s", "r", "fixture-user", "i", 1000, 1, 0, [" Sci-Fi ", "sci-fi"], ["space"], 900)], "sample_id string, request_id string, user_id string, item_id string, impression_ts bigint, clicked int, ordered int, genres array<string>, tags array<string>, published_at bigint")
    got = json.loads(profiles.with_document(profiles.build_profiles(rows, cfg), cfg, "fixture-run", "1970-01-01T00:16:40Z").first()["profile_json"])
    assert got == {
        "user_id": "fixture-user", "profile_version": 1, "run_id": "fixture-run", "generated_at": "1970-01-01T00:16:40Z", "source_window": {"start": "1969-12-02T00:16:40Z", "end": "1970-01-01T00:16:41Z"}, "evidence_count": 1,
        "preferences": {"genres": [{"value": "sci-fi", "score": 1 / 6, "evidence_count": 1}], "tags": [{"value": "space", "score": 1 / 6, "evidence_count": 1}]},
        "behavioral_features": {"engagement_rate": 1.0, "conversion_rate": 0.0, "genre_diversity": 0.0, "preference_concentration": 1.0, "recent_release_affinity": 1.0, "average_rating": None, "activity_level": "low"},
        "personas": [{"type": "new_or_unknown", "label": "New or unknown", "confidence": 1.0, "evidence": {"evidence_count": 1.0, "minimum_evidence": 5.0}}],
    }


def test_personas(spark):
    from rivulet.operators import profiles

    cfg = profiles.ProfileConfig(reference=1000)
    kinds = "evidence_count bigint, impressions bigint, clicks bigint, orders bigint, engagement_rate double, conversion_rate double, genre_diversity double, preference_concentration double, recent_release_affinity double, " + f"genre_preferences {profiles.PREFERENCE}"
    rows = [
        (9, 9, 5, 2, 0.5, 0.2, 0.1, 0.85, 0.8, [("sci-fi_x", 0.8, 7), ("a", 0.8, 2), ("b", -0.1, 1)]),
        (9, 9, 0, 0, 0.0, 0.0, 0.8, 0.25, None, []),
        (4, 4, 4, 4, 1.0, 1.0, 0.9, 0.9, 0.9, []),
    ]
    got = [[(p["type"], p["label"], round(p["confidence"], 6)) for p in r["p"]] for r in spark.createDataFrame(rows, kinds).select(profiles.personas(cfg).alias("p")).collect()]
    assert got == [
        [("genre_enthusiast", "A enthusiast", 0.5), ("focused_viewer", "Focused viewer", 0.5), ("recent_release_seeker", "Recent release seeker", 0.5), ("high_intent_engager", "High-intent engager", round(0.1 / 0.9, 6))],
        [("genre_explorer", "Genre explorer", 0.5), ("casual_browser", "Casual browser", 1.0)],
        [("new_or_unknown", "New or unknown", 1.0)],
    ]


def test_unavailable_measurements(spark):
    from rivulet.operators import governance

    bare = spark.createDataFrame([("i", 1)], "item_id string, clicked int")
    r = governance.safety(bare).first()
    assert r["status"] == "unavailable" and r["filter_decisions"] is None and r["unsafe_exposure_rate"] is None
    assert governance.freshness(bare, 0).first()["status"] == "unavailable"
    flags = spark.createDataFrame([("i", 1, True), ("j", 0, False), ("k", 1, None)], "item_id string, clicked int, new_release boolean")
    r = governance.freshness(flags, 0).first()
    assert (r["freshness_source"], r["fresh_share"], r["age_at_exposure_coverage"], r["mean_content_age_days"], round(r["freshness_coverage"], 6)) == ("boolean_new_release", 0.5, None, None, 0.666667)
    assert governance.fairness(bare, 1).count() == 0


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int")
    assert measures.auc(df, "s", F.col("y") == 1).first()["auc"] == 0.5
    assert measures.auc(df.filter("y = 1"), "s", F.col("y") == 1).first()["auc"] is None
    assert abs(measures.logloss(df, "s", F.col("y") == 1).first()["logloss"] - 0.693147) < 1e-5


def test_cosines(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = r.select(cosine(F.col("a"), F.col("b"), True).alias("t"), cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert (got["t"], got["z"]) == (1.0, 0.0)


def test_policy_gradient_prefers_the_rewarded_item():
    x, r, p = np.eye(3), [1.0, 0.0, 0.0], [1 / 3] * 3
    w = learning.grpo_step(np.zeros(3), [(x, r, p)])
    assert w.argmax() == 0
    assert learning.group_advantage([1.0]) is None and learning.group_advantage([2.0, 2.0]) is None
    assert (learning.grpo_step(np.zeros(3), [(x * np.nan, r, p)]) == 0).all()


def test_tabular_q(spark):
    steps = spark.createDataFrame([("a", "go", 0.0, "b", False), ("b", "go", 1.0, None, True)], "state string, action string, reward double, next_state string, terminal boolean")
    q = {r["state"]: r["q"] for r in learning.tabular_q(steps, sweeps=60).collect()}
    assert abs(q["b"] - 1) < 1e-6 and abs(q["a"] - 0.9) < 1e-6


def test_replayed_rewards_round_by_tenths(spark):
    from rivulet.sources import files

    rewards = [0.69, -0.69, 0.09, 0.93, 0.688, 0.0, 7.0]
    rows = spark.createDataFrame([(str(i), "a", r, 1007) for i, r in enumerate(rewards)], "user string, action string, reward double, timestamp bigint")
    got = {int(r["userId"]): (r["rating"], r["timestamp"]) for r in files.replay_ratings(rows).collect()}
    assert [got[i] for i in range(len(rewards))] == [(x, 1) for x in (3.5, -3.5, 0.5, 4.7, 3.4, 0.0, 5.0)]
    times = [9_007_199_254_740_999_007, -1, -1000]
    rows = spark.createDataFrame([("u", "a", 0.0, t) for t in times], "user string, action string, reward double, timestamp bigint")
    assert sorted(r["timestamp"] for r in files.replay_ratings(rows).collect()) == sorted(t // 1000 for t in times)


def test_personas_at_their_thresholds(spark):
    from rivulet.operators import profiles

    cfg = profiles.ProfileConfig(reference=1000)
    kinds = "evidence_count bigint, impressions bigint, clicks bigint, orders bigint, engagement_rate double, conversion_rate double, genre_diversity double, preference_concentration double, recent_release_affinity double, " + f"genre_preferences {profiles.PREFERENCE}"
    up, down = 1e-15, -1e-15
    rows = [(9, 9, 5, 2, 0.4 + x, 0.1 + x, 0.6 + x, 0.5 - x, 0.6 + x, [("a", 0.6 + x, 7)]) for x in (up, 0.0, down, -1e-9)]
    rows += [(9, 9, 0, 0, 0.1 + x, 0.02 + x, 0.1, 0.7 - x, None, []) for x in (up, 0.0, down)]
    got = [sorted((p["type"], round(abs(p["confidence"]), 6)) for p in r["p"]) for r in spark.createDataFrame(rows, kinds).select(profiles.personas(cfg).alias("p")).collect()]
    fit = [(t, 0.0) for t in ("genre_enthusiast", "genre_explorer", "high_intent_engager", "recent_release_seeker")]
    assert got == [fit] * 3 + [[]] + [[("casual_browser", 0.0), ("focused_viewer", 0.0)]] * 3


def test_genres_that_halve_all_weight_make_an_explorer(spark):
    from rivulet.operators import profiles

    # every event has genre a, so that its share is a half, whatever the order of the sums
    cfg = profiles.ProfileConfig(reference=2_000_000)
    rows = [(f"s{u}-{i}", f"u{u}", f"i{i}", 2_000_000 - (7_919 * (u + 1) * (i + 3)) % 600_000, True, ["a", "bcdefg"[i % 6]]) for u in range(40) for i in range(13)]
    df = spark.createDataFrame(rows, "sample_id string, user_id string, item_id string, impression_ts bigint, clicked boolean, genres array<string>")
    got = profiles.build_profiles(df, cfg).select("user_id", F.transform("personas", lambda p: p["type"]).alias("t")).collect()
    assert len(got) == 40 and all("genre_explorer" in r["t"] for r in got)
