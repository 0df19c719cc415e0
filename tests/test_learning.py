"""Fitting, policies, monitors, replay and documents on small inputs whose answers are known."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.config import PolicyConfig, StreamConfig
from rivulet.functions.columns import Gate
from rivulet.operators import dashboard, fitting, learning, measures, offpolicy, samples
from rivulet.sources.replay import replay_paced
from rivulet.sources.simulate import simulate_slates
from rivulet.streaming import monitor
from rivulet.streaming.engine import Commits
from rivulet.streaming.learner import PolicyLearner, slate_rows


def test_logistic_on_driver_and_executors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) * [1, 5] + [0, 3]
    y = (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    want, bias = learning.logistic(x, y, steps=8)
    for rows in (fitting.DRIVER_ROWS, 0):
        w, b = fitting.fit_logistic(df, steps=8, driver_rows=rows)
        assert np.allclose(w, want) and math.isclose(b, bias, rel_tol=1e-9)
    with pytest.raises(ValueError):
        fitting.fit_logistic(df.limit(0))


def test_mlp_gradient():
    net, rng = fitting.Mlp(3, 4), np.random.default_rng(2)
    p, x, slope = net.start(5), rng.normal(size=(6, 3)), rng.normal(size=6)
    got = net.pull(p, x, slope)
    for i in range(len(p)):
        e = np.zeros(len(p))
        e[i] = 1e-6
        assert math.isclose(got[i], (slope @ net.value(p + e, x) - slope @ net.value(p - e, x)) / 2e-6, abs_tol=1e-5)


def test_fitted_q(spark):
    rows = [([1.0, 0.0], 0.0, [[0.0, 1.0], [1.0, 1.0]]), ([0.0, 1.0], 1.0, []), ([1.0, 1.0], 0.0, [])] * 5
    df = spark.createDataFrame(rows, "x array<double>, reward double, next array<array<double>>")
    q = fitting.fitted_q(df, iterations=20, epochs=60)
    assert np.allclose(q.value([[1, 0], [0, 1], [1, 1]]), [0.9, 1.0, 0.0], atol=0.05)
    near, far = (fitting.fitted_q(df, iterations=2, epochs=2, driver_rows=n) for n in (100, 0))
    assert np.allclose(near.p, far.p)
    got = q.score(spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id int, x array<double>")).collect()
    assert abs(got[0]["score"] - 1) < 0.05 and got[1]["score"] is None


def test_preferences(spark):
    rng = np.random.default_rng(3)
    pairs = [(sorted([a, b])[1:], sorted([a, b])[:1], 0.0, 0.0) for a, b in rng.normal(size=(40, 2)).tolist()]
    df = spark.createDataFrame(pairs, "chosen array<double>, rejected array<double>, chosen_ref double, rejected_ref double")
    s = fitting.fit_preferences(df, epochs=150)
    assert (s.value([p[0] for p in pairs]) > s.value([p[1] for p in pairs])).mean() > 0.95
    scored = spark.createDataFrame([(2.0, 1.0, 0.5, 0.0), (1.0, 1.0, 0.0, 0.0)], "chosen_score double, rejected_score double, chosen_ref double, rejected_ref double")
    r = fitting.preference_loss(scored).first()
    assert r["accuracy"] == 0.5 and math.isclose(r["loss"], (math.log1p(math.exp(-0.5)) + math.log(2)) / 2)
    empty = fitting.preference_loss(scored.limit(0)).first()
    assert empty["pairs"] == 0 and empty["loss"] is None and empty["accuracy"] is None


def test_policies_and_bounds(spark):
    rows = [(f"r{i}", float(i % 2), [("a", 1.0, 0.2), ("b", 2.0, 0.8)] if i else []) for i in range(400)]
    ev = spark.createDataFrame(rows, "request_id string, reward double, actions array<struct<item string, s double, e double>>")
    scores = offpolicy.policy_scores(ev, {"best": lambda a: a["s"], "tie": lambda a: F.lit(1.0)}, lambda a: a["e"]).cache()
    got = {r["policy"]: r for r in offpolicy.bootstrap(scores, replicates=200, groups=128).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"logging": 400, "best": 399, "tie": 399}
    assert math.isclose(got["best"]["value"], 0.8) and math.isclose(got["best"]["value_low"], 0.8) and math.isclose(got["tie"]["value_high"], 0.8)
    log = got["logging"]
    assert log["lift"] == log["lift_low"] == log["lift_high"] == 0.0
    # the deviation of a mean of 400 coins is 0.025
    assert 0.07 < log["value_high"] - log["value_low"] < 0.13 and log["value_low"] < 0.5 < log["value_high"]
    again = {r["policy"]: r for r in offpolicy.bootstrap(scores, replicates=200, groups=128).collect()}
    assert again == got
    assert offpolicy.bootstrap(scores.limit(0)).count() == 0
    est = spark.range(1).select(offpolicy.reward_model([2.0, -1.0], 0.5)(F.array(F.lit(1.0), F.lit(0.5))).alias("p")).first()["p"]
    assert math.isclose(est, 1 / (1 + math.exp(-2)))


def test_config():
    env = {"GRPO_LEARNING_RATE": "-1", "GRPO_KL_BETA": "0", "GRPO_INNER_EPOCHS": "x", "GRPO_TEMPERATURE": "inf", "GRPO_CLIP_EPSILON": "0.3"}
    assert PolicyConfig.from_env(env) == PolicyConfig(kl_beta=0.0, clip_epsilon=0.3)
    assert StreamConfig.from_env({"STREAM_FAIL_ON_DATA_LOSS": " False ", "STREAM_WATERMARK": " "}) == StreamConfig(fail_on_data_loss=False)


SLATE = "slate_id string, items array<struct<item_id string, label double, item_features map<string,string>>>"


def slates(spark, *rows):
    pack = lambda x, s: {"grpo_x": x, "prediction_score": s}
    return spark.createDataFrame([(k, [(str(i), r, pack(x, s)) for i, (r, x, s) in enumerate(items)]) for k, items in rows], SLATE)


def test_policy_learner(spark, tmp_path):
    good = [(1.0, "v2:1,0", "0.1"), (0.0, "v2:0,1", "0.1")]
    df = slates(spark, ("a", good), ("flat", [(0.0, "v2:1,0", "0"), (0.0, "v2:0,1", "0")]), ("old", [(1.0, "v1:1,0", "0"), (0.0, "v2:0,1", "0")]), ("wide", [(1.0, "v2:1,0,3", "0"), (0.0, "v2:0,1", "0")]),
                ("none", [(1.0, None, "0"), (0.0, "v2:0,1", "0")]), ("word", [(1.0, "v2:x,0", "0"), (0.0, "v2:0,1", "0")]), ("one", good[:1]))
    assert [r["slate_id"] for r in slate_rows(df, 2).collect()] == ["a"]
    learner = PolicyLearner(spark, str(tmp_path), 2)
    assert learner.batch(df, 3) and not learner.batch(df, 3)
    w = learner.weights()
    assert w[0] > 0 > w[1] and np.allclose(w.sum(), 0)
    assert np.allclose(learner.step(df), learner.step(df, driver_rows=0))
    assert learner.step(df.filter("slate_id = 'flat'")) is None
    assert not learner.batch(df.limit(0), 4) and np.array_equal(learner.weights(), w)


def test_monitors(spark):
    spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count().collect()
    costs = monitor.stage_costs(spark)
    assert costs and any(c.shuffle_write > 0 for c in costs) and not costs[-1].failed
    loud, quiet = [], []
    last = monitor.report_stages(spark, notable=loud.append, quiet=quiet.append)
    assert quiet and monitor.stage_costs(spark, last) == []
    assert monitor.human_bytes(1536) == "1.5K" and monitor.human_bytes(12) == "12B" and monitor.BatchMetrics.line("q", 3, 1.5, 20) == "batch query=q rows=3 rps=1.5 ms=20"
    tally = monitor.FailureTally(1)
    for key in ((1, 0), (1, 0), (2, 0)):
        tally.record(*key)
    assert tally.drain(2, 0) == 0 and tally.drain(1, 0) == 2 and len(tally) == 0


def test_paced_replay(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    rows = [(f"e{i:03d}", 1000 - i) for i in range(100)]
    commits.write("raw/one", spark.createDataFrame(rows[:70], "event_id string, timestamp_ms bigint"))
    commits.write("raw/two", spark.createDataFrame(rows[70:], "event_id string, timestamp_ms bigint"))
    now, sent, fail = [0.0], [], [3]

    def send(df):
        if len(sent) == fail[0]:
            fail[0] = -1
            raise OSError("down")
        sent.append([r["event_id"] for r in df.orderBy("timestamp_ms").collect()])

    pace = dict(rows_per_second=10.0, rows=20, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    with pytest.raises(OSError):
        replay_paced(commits, ["raw/one", "raw/two"], send, **pace)
    left = 100 - sum(map(len, sent))
    began = now[0]
    assert replay_paced(commits, ["raw/one", "raw/two"], send, **pace) == left
    assert math.isclose(now[0] - began, (left - len(sent[-1])) / 10)
    assert [e for s in sent for e in s] == [e for e, _ in rows[:70][::-1] + rows[70:][::-1]]
    assert replay_paced(commits, ["raw/one", "raw/two"], send, **pace) == 0


def test_dashboard(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.7)], "k int, v double")
    doc = json.loads(dashboard.document({"a": dashboard.Section(df, ["k"], 2, lambda rows: f"{len(rows)} rows"), "b": dashboard.Section(df.limit(0), ["k"]), "c": None}, {"a": [0], "c": {"p99": 3}}))
    assert doc == {"a": {"status": "ok", "rows": [{"k": 1, "v": 0.5}, {"k": 2, "v": None}], "truncated": True, "headline": "2 rows"}, "b": {"status": "missing"}, "c": {"status": "live", "rows": {"p99": 3}}}


def test_simulated_effects(spark):
    df = simulate_slates(spark, 4000, base=0.1).cache()
    assert df.filter("event_type = 'impression'").count() == 40_000 and df.select("event_id").distinct().count() == df.count()
    family = F.substring_index("item_id", "_", -1).cast("int") % 4 == F.substring_index("user_id", "_", -1).cast("int") % 4
    rate = {(r["f"]): r["c"] / r["n"] for r in df.groupBy(family.alias("f")).agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "impression").alias("n")).collect()}
    assert 2.6 < rate[True] / rate[False] < 3.4
    assert df.exceptAll(simulate_slates(spark, 4000, base=0.1, partitions=3)).count() == 0
    with pytest.raises(ValueError):
        simulate_slates(spark, 1, size=9, items=3)


def test_response_metrics_of_odd_slates(spark):
    schema = "items array<struct<item_features map<string,string>, feedback_delay_ms bigint>>, user_features map<string,string>, context_features map<string,string>, kafka_ingest_lag_ms bigint"
    rows = [(None, None, None, None), ([({"product_type": "Sponsored"}, 0), (None, -5)], {"subscription_level": " Gold ", "country": "us"}, {"ads_blender_type": "x"}, 0)]
    got = {tuple(r) for r in samples.response_metrics(spark.createDataFrame(rows, schema), ("gold",)).collect()}
    blank = {("total", None, "other", None, None, 1), ("total", None, "other", "unknown", None, 1), ("empty_ads", "response", "other", None, "default", 1), ("empty_items", "response", "other", None, "default", 1)}
    full = {("total", None, "gold", None, None, 1), ("total", None, "gold", "us", None, 1), ("items", None, "gold", None, "x", 1), ("ads", None, "gold", None, "x", 1), ("feedback_delay_ms", None, "gold", "us", None, 0), ("kafka_ingest_lag_ms", None, "gold", "us", None, 0)}
    assert got == blank | full


def test_baselines(spark):
    seen = spark.createDataFrame([("u", "a", 1, "1"), ("u", "b", 2, "2"), ("u", "a", 3, "3"), ("v", "c", 1, "4"), ("w", "x", 1, "5")], "user_id string, item_id string, timestamp_ms bigint, event_id string")
    last = measures.repeat_last(seen, 1)
    assert {(r["user_id"], r["item_id"]) for r in last.collect()} == {("u", "a"), ("v", "c"), ("w", "x")}
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "item_id string, vector array<double>")
    near = {(r["user_id"], r["item_id"]): r["rank"] for r in measures.neighbours(seen, items, 2).collect()}
    assert near == {("u", "a"): 1, ("u", "b"): 2, ("v", "c"): 1, ("v", "b"): 2}
    targets = spark.createDataFrame([("u", "b"), ("v", "c"), ("w", "a")], "user_id string, item_id string")
    m = measures.ranking_metrics(targets, measures.neighbours(seen, items, 2)).first()
    assert m["targets"] == 3 and math.isclose(m["hit5"], 2 / 3) and math.isclose(m["mrr10"], 0.5) and math.isclose(m["ndcg10"], (1 + 1 / math.log2(3)) / 3)


def test_ctr_evaluation_and_drops(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, f"g{i % 2}") for i in range(40)], "clicked int, g string")
    model = learning.ctr_model(df, ["g"], 64)
    m = learning.evaluate_ctr(model, df)
    assert m["auc"] == 1.0 and m["pr_auc"] == 1.0 and m["rows"] == 40 and m["positives"] == 20 and m["logloss"] < 0.5
    assert learning.evaluate_ctr(model, df.filter("clicked = 1"))["auc"] is None
    out = {}
    learning.save_model(model, m | {"odd": float("nan")}, str(tmp_path), out.__setitem__)
    assert json.loads(out[f"{tmp_path}/metrics.json"])["odd"] is None
    lines = []
    gate = Gate(df, [("no_click", F.col("clicked") == 1), ("never", F.lit(True))])
    assert monitor.report_drops("g", gate, lines.append) == {"kept": 20, "no_click": 20, "never": 0} and lines == ["drops gate=g kept=20 no_click=20 never=0"]
    stream = spark.readStream.format("rate").load()
    assert monitor.report_drops("s", Gate(stream, [("x", F.lit(True))]), warn=lines.append) == {} and len(lines) == 2


def test_full_ctr_model_reads_maps_and_terms(spark):
    rows = [(i % 2, {"tier": "gold" if i % 2 else "base"}, None, f"i{i % 5}", i % 3, ["drama"] if i % 2 else ["war"], None) for i in range(120)]
    df = spark.createDataFrame(rows, "clicked int, user_features map<string,string>, device string, item_id string, position int, genres array<string>, tags array<string>")
    ready = learning.ctr_rows(df)
    assert ready.first()["cf_device"] == "NA" and ready.first()["tags"] == []
    got = learning.evaluate_ctr(learning.full_ctr_model(ready, 1 << 10, 1 << 6), ready)
    assert got["rows"] == 120 and got["auc"] > 0.99
