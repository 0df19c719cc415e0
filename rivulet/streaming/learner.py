"""A policy that learns from slates, batch after batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import PolicyConfig
from rivulet.operators.fitting import Rows
from rivulet.operators.learning import softmax
from rivulet.sources.files import KeyedState


def slate_rows(slates: DataFrame, dim: int, version: str = "v2", features: str = "grpo_x", score: str = "prediction_score", least_engaged: int = 1) -> DataFrame:
    """(slate_id, items): an array [reward, logged score, features...] an item, for slates that can teach something.

    A slate counts if it has two items or more, rewards that differ, and
    `least_engaged` items with a reward; and if each item carries a packed
    vector of that version and width and a logged score. The rest is dropped in
    Spark, before anything reaches Python.
    """
    prefix = f"{version}:"
    own = F.col("i.item_features")
    packed = own[features]
    numbers = F.when(F.startswith(packed, F.lit(prefix)), F.transform(F.split(F.substr(packed, F.lit(len(prefix) + 1)), ","), lambda x: x.try_cast("double")))
    items = slates.select("slate_id", F.explode("items").alias("i")).select("slate_id", F.col("i.label").alias("r"), own[score].try_cast("double").alias("s"), numbers.alias("x"))
    good = F.col("r").isNotNull() & F.col("s").isNotNull() & F.col("x").isNotNull() & (F.size("x") == dim) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    rows = items.groupBy("slate_id").agg(
        F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(F.col("r") > 0).alias("engaged"), F.min("r").alias("lo"), F.max("r").alias("hi"),
        F.sort_array(F.collect_list(F.when(good, F.concat(F.array(F.col("r").cast("double"), "s"), "x")))).alias("items"),
    )
    return rows.filter((F.col("n") >= 2) & (F.col("good") == F.col("n")) & (F.col("engaged") >= least_engaged) & (F.col("lo") < F.col("hi"))).select("slate_id", "items")


def policy_gradient(w: np.ndarray, start: np.ndarray, flat: np.ndarray, counts: np.ndarray, cfg: PolicyConfig) -> np.ndarray:
    """The sum over slates of the gradient to go along, followed by the number of slates.

    The surrogate is clipped against the policy the batch began with (start); the
    KL penalty holds to the policy that served.
    """
    total, used, at = np.zeros(len(w)), 0, 0
    for n in counts.tolist():
        block, at = flat[at : at + n], at + n
        r, x = block[:, 0], block[:, 2:]
        if r.std() < 1e-8:
            continue
        a = (r - r.mean()) / r.std()
        p, old, logged = (softmax(v / cfg.temperature) for v in (x @ w, x @ start, block[:, 1]))
        ratio = p / old
        open_ = np.where(a >= 0, ratio < 1 + cfg.clip_epsilon, ratio > 1 - cfg.clip_epsilon)
        centred = (x - p @ x) / cfg.temperature
        total += ((a * open_ * ratio)[:, None] * centred).mean(axis=0)
        total -= cfg.kl_beta * ((p * (np.log(p) - np.log(np.maximum(logged, 1e-300))))[:, None] * centred).sum(axis=0)
        used += 1
    return np.append(total, used)


class PolicyLearner:
    """Weights in a keyed state; a batch moves them once, whatever is retried. A step that isn't finite leaves them."""

    def __init__(self, spark: SparkSession, root: str, dim: int, cfg: PolicyConfig | None = None):
        self.spark, self.dim, self.cfg = spark, dim, cfg or PolicyConfig()
        self.state = KeyedState(spark, root)

    def weights(self) -> np.ndarray:
        got = self.state.read()
        w = np.zeros(self.dim)
        for r in got.collect() if got is not None else []:
            if r["d"] < self.dim:
                w[r["d"]] = r["w"]
        return w

    def step(self, slates: DataFrame, driver_rows: int = 10_000) -> np.ndarray | None:
        """Weights after the slates; None without a slate that teaches, or if a number isn't finite."""
        rows = Rows(slate_rows(slates, self.dim), ["items"], driver_rows)
        if not rows.n:
            return None
        start, cfg = self.weights(), self.cfg
        w = start
        for _ in range(cfg.inner_epochs):
            got = rows.sum(lambda a, w=w: policy_gradient(w, start, *a["items"], cfg))
            if not got[-1]:
                return None
            w = w + cfg.learning_rate * got[:-1] / got[-1]
        return w if np.isfinite(w).all() else None

    def batch(self, slates: DataFrame, batch_id: int) -> bool:
        """For foreachBatch. False if the weights stay as they are."""
        w = self.step(slates)
        if w is None:
            return False
        return self.state.publish(self.spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "d int, w double").coalesce(1), batch_id)
