"""Values of policies from logged events, with intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distribution function of a Poisson variable of mean 1, at 0 to 8.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020)
GROUPS, REPLICATES = 4096, 1000


def reward_model(weights, bias: float) -> Callable[[Column], Column]:
    """A fitted logistic model as a column of an array of features."""
    w = F.array(*[F.lit(float(x)) for x in weights])

    def estimate(x: Column) -> Column:
        z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))

    return estimate


def _known(score: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: score(a).isNotNull()


def _ranked(score: Callable[[Column], Column], estimate: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.struct(score(a).cast("double").alias("s"), a["item"].alias("item"), estimate(a).cast("double").alias("r"))


def policy_scores(events: DataFrame, policies: dict[str, Callable[[Column], Column]], estimate: Callable[[Column], Column], reward: str = "reward") -> DataFrame:
    """(request_id, policy, r): the logged reward under `logging`, and the estimate of the action that each policy picks.

    events: request_id, the reward, actions array<struct<item, ...>>. Ties go to
    the larger item; a policy that scores no action of an event has no row there.
    Every action is looked at once, within its event: nothing is shuffled.
    """
    picks = [F.struct(F.lit("logging").alias("policy"), F.col(reward).cast("double").alias("r"))]
    for name, score in policies.items():
        scored = F.filter("actions", _known(score))
        picks.append(F.struct(F.lit(name).alias("policy"), F.array_max(F.transform(scored, _ranked(score, estimate)))["r"].alias("r")))
    return events.select("request_id", F.inline(F.array(*picks))).filter("r IS NOT NULL")


def _unit(text: Column) -> Column:
    """A number from 0 to 1 that MD5 gives a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bootstrap(scores: DataFrame, replicates: int = REPLICATES, groups: int = GROUPS, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(policy, n, value, lift, and the bounds of both) of policy_scores, bounds by a Poisson bootstrap over events.

    Events are dealt by a hash of their id into `groups`, added up in one pass;
    replicates weigh groups, so their cost doesn't grow with the events. Groups
    are events drawn at random: of their number depends just how well the
    spread is known (about 1 in sqrt(2 * groups)). Weights come from MD5, so
    reruns agree. Bounds hold for the reward model as it is.
    """
    by = F.floor(_unit(F.col("request_id").cast("string")) * groups).cast("long")
    sums = scores.groupBy(by.alias("g"), "policy").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    u = F.col("u")
    draws = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.withColumn("u", _unit(F.concat_ws(":", F.lit(str(seed)), F.col("g").cast("string"), F.col("replicate").cast("string"))))
    weight = sum(((u >= c).cast("int") for c in POISSON), F.lit(0))
    got = draws.groupBy("replicate", "policy").agg(F.sum(F.col("s") * weight).alias("s"), F.sum(F.col("n") * weight).alias("n")).filter("n > 0").select("replicate", "policy", (F.col("s") / F.col("n")).alias("value"))
    base = got.filter("policy = 'logging'").select("replicate", F.col("value").alias("base"))
    ends = [(1 - level) / 2, (1 + level) / 2]
    bounds = got.join(base, "replicate", "left").groupBy("policy").agg(
        F.percentile("value", F.array(*[F.lit(e) for e in ends])).alias("v"), F.percentile(F.try_divide("value", "base") - 1, F.array(*[F.lit(e) for e in ends])).alias("l")
    )
    point = sums.groupBy("policy").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("value"))
    logged = point.filter("policy = 'logging'").select(F.col("value").alias("base"))
    # one row
    point = point.join(F.broadcast(logged), how="left")
    return point.join(bounds, "policy", "left").select(
        "policy", "n", "value", (F.try_divide("value", "base") - 1).alias("lift"), F.col("v")[0].alias("value_low"), F.col("v")[1].alias("value_high"), F.col("l")[0].alias("lift_low"), F.col("l")[1].alias("lift_high")
    )
