"""Offline evaluation of a policy's weights on held-out slates, and the split of timelines for next-item tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.columns import held_out


def majority_schema(rows: DataFrame) -> tuple[str, int] | None:
    """The (version, width) of features that most rows agree on; of equally many, the least. None if no row has features.

    rows: version, x (array of doubles, null where it couldn't be read).
    """
    found = rows.filter(F.col("x").isNotNull() & F.col("version").isNotNull()).groupBy("version", F.size("x").alias("width")).agg(F.count("*").alias("n"))
    best = found.orderBy(F.desc("n"), "version", "width").limit(1).collect()
    return (best[0]["version"], best[0]["width"]) if best else None


def scored_rows(rows: DataFrame, weights: Sequence[float], version: str) -> tuple[DataFrame, DataFrame]:
    """(scored, counts) of held-out rows (request_id, version, x, prediction_score, label).

    The schema of the majority must be that of the weights: features of another
    layout would give a number that means nothing. Rows without features, score or
    label, of another schema, or with a label below 0 or not a number are dropped
    and counted, never filled in. counts: (usable, dropped).
    """
    schema = majority_schema(rows)
    if schema != (version, len(weights)):
        raise ValueError(f"the rows have features {schema}, the weights {(version, len(weights))}")
    label, score = F.col("label").cast("double"), F.col("prediction_score").cast("double")
    fits = (F.col("version") == version) & (F.size("x") == len(weights)) & score.isNotNull() & (label >= 0) & ~F.isnan(label)
    tested = rows.filter(held_out(F.col("request_id"))).withColumn("fits", F.coalesce(fits, F.lit(False)))
    policy = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    counts = tested.agg(F.count_if("fits").alias("usable"), F.count_if(~F.col("fits")).alias("dropped"))
    return tested.filter("fits").select("request_id", policy.alias("policy_score"), score.alias("prediction_score"), label.alias("label")), counts


def _concordant(rows: DataFrame, score: str) -> DataFrame:
    """(request_id, name): pairs of a positive and a negative in which the positive has the higher score, ties half.

    From counts per score and one running sum in each slate: no pair is made.
    """
    per = rows.groupBy("request_id", score).agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("request_id").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("c", F.col("p") * (below + F.col("q") / 2)).groupBy("request_id").agg(F.sum("c").alias(score))


def pairwise_auc(scored: DataFrame, scores: Sequence[str] = ("policy_score", "prediction_score")) -> DataFrame:
    """One row: slates, those with a positive and a negative, pairs, and of each score the share of pairs in the right order.

    All scores are held against the same pairs, and pairs are averaged, not slates.
    """
    slates = scored.groupBy("request_id").agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    for s in scores:
        slates = slates.join(_concordant(scored, s), "request_id")
    pairs = F.sum(F.col("p") * F.col("q"))
    return slates.agg(
        F.count("*").alias("slates"), F.count_if((F.col("p") > 0) & (F.col("q") > 0)).alias("usable_slates"), F.coalesce(pairs, F.lit(0)).alias("pairs"),
        *[F.try_divide(F.sum(s), pairs).alias(s.replace("score", "auc")) for s in scores],
    )


#: Why a reader has no place in the test of the next item, in the order in which reasons are looked for.
DROPPED = ("no_history", "no_target")


def split_timelines(events: DataFrame, share: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, targets, readers): events up to the cutoff, each reader's first after it, and each reader's reason for being left out, if any.

    The cutoff is the quantile of all timestamps, cut to a whole second. A reader
    needs a history and a target: no_history, no_target.
    """
    cutoff = events.agg(F.floor(F.percentile("timestamp", share)).alias("cut"))
    rows = events.crossJoin(F.broadcast(cutoff))  # one row
    before = F.col("timestamp") <= F.col("cut")
    per = rows.groupBy("user_id").agg(F.count_if(before).alias("history"), F.count_if(~before).alias("after"), F.min_by("item_id", F.when(~before, F.struct("timestamp_ms", "event_id"))).alias("item_id"))
    reason: Column = F.when(F.col("history") == 0, DROPPED[0]).when(F.col("after") == 0, DROPPED[1])
    readers = per.select("user_id", reason.alias("reason"), "item_id")
    return rows.filter(before).drop("cut"), readers.filter("reason IS NULL").select("user_id", "item_id"), readers.select("user_id", "reason")
