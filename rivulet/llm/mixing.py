"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the training stream changes over time t in [0, 1]: its
weight schedule runs in a straight line from a start to an end. The integral
of the schedule, scaled so that it ends at the source's target, is the demand
for the source's words up to t. Documents of a source stand in a seeded order,
once or twice over; the demand at which a document is due, put through the
inverse of the integral, is its position in training. Sorting by position
(a range partitioning) gives the mixed stream.

Cumulative sizes come from a prefix sum in two steps: sums per source and hash
bucket, a running sum over the buckets, then a running sum inside each bucket.
A source may so hold most rows and no task gets more than one bucket of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import WORD, cut, private

#: Weights of the sources by rank, repeating.
WEIGHTS = (3, 1, 2)
#: Words asked for, as a share of all words there are.
BUDGET = 1.5
#: A source gives no more than so many times its size.
MOST = 2
#: Schedules by rank, repeating: how a source's weight at the end of training compares with its start. 1: constant.
TILTS = (1.0, 2.0, 0.5)
#: Rows of one source meant for one hash bucket.
BUCKET_ROWS = 250


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, tilts: Sequence[float] = TILTS) -> DataFrame:
    """Per source (columns source, source_size): rank, weight, tilt and target.

    One row a source comes in and goes out; the rank and the level need an order
    over all sources, so this table is one task's work. A source of weight w gets
    min(most * size, level * w), with the one level at which all targets add up
    to budget times all sizes: what sharing out the excess by weight, again and
    again, ends at.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).select("*", pick(weights, "long").alias("weight"), pick(tilts, "double").alias("tilt"))
    # the sources that reach their cap first come first; level_k is the level if just the first k were capped
    first = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, whole = first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("all_size"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    ).withColumn("level_k", (F.col("all_size") * F.lit(float(budget)) - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level_k") * F.col("weight") <= F.col("source_size") * most, F.col("level_k"))
    last = F.first(fits, ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cap = (F.col("source_size") * most).cast("double")
    return filled.withColumn("level", last).select(
        "source", "source_size", "rank", "weight", "tilt", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target")
    )


def invert(demand: Column, target: Column, tilt: Column) -> Column:
    """Time at which a source has been asked for `demand` words.

    The weight runs from 1 to tilt, so the demand up to t is
    target * (t + (tilt - 1) t^2 / 2) / ((1 + tilt) / 2).
    """
    asked = demand / target * (1 + tilt) / 2
    return F.when(F.abs(tilt - 1) < 1e-9, asked).otherwise((F.sqrt(F.greatest(1 + 2 * (tilt - 1) * asked, F.lit(0.0))) - 1) / (tilt - 1))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    tilts: Sequence[float] = TILTS,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, copies, taken, positions.

    copies of 0, 1 or up to `most` say how often the stream has the document,
    taken the words of these, positions (array of doubles in [0, 1], ascending)
    when. A copy is taken if half of it or more lies within the target, so a
    source's taken words miss its target by half a document at most. Null is a
    source of its own, ranked last. Documents without words are never taken.
    Rows with equal keys are separate documents, in the order of their sizes. A
    table without rows, or without any word, gives no copies.
    """
    return _plan(docs, {}, weights, budget, most, tilts, seed, key, text, source)


def _plan(
    docs: DataFrame,
    marks: dict[str, Column],
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    tilts: Sequence[float] = TILTS,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """plan_mix with further columns of each row at the end."""
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), *[c.alias(n) for n, c in marks.items()]))
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    # the top 31 of the order's 60 bits, scaled: buckets are ranges of the order, so the sums don't depend on their number
    rows = rows.withColumn("at", order).withColumn("bucket", F.floor((F.shiftright("at", 29) * F.lit(buckets)) / F.lit(2**31)).cast("int"))
    part = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(part.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, most, tilts)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)))
    part = part.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source", "bucket_size")
    part = cut(part).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "bucket").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    # the sums of a bucket stand on a row of their own ahead of its documents, and run down to them: no join
    head = part.select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.col("s").alias("source"), F.lit(None).cast("long").alias("size"), F.lit(-1).cast("long").alias("at"), F.col("b").alias("bucket"), F.struct("ahead", "source_size", "target", "tilt").alias("of"), *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in marks])
    run = rows.withColumn("of", F.lit(None).cast(head.schema["of"].dataType)).unionByName(head)
    run = run.withColumn("of", F.first("of", ignorenulls=True).over(within)).withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("of.ahead"))
    run = run.filter(F.col("size").isNotNull()).select("key", "source", "size", "start", "of.*", *marks)
    due = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda r: (F.col("start") + r * F.col("source_size")).cast("double"))
    taken = F.filter(due, lambda d: (F.col("size") > 0) & (d + F.col("size") / 2 <= F.col("target")))
    return run.withColumn("due", taken).select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        F.size("due").alias("copies"),
        (F.col("size") * F.size("due")).alias("taken"),
        F.transform("due", lambda d: F.least(invert(d, F.col("target"), F.col("tilt")), F.lit(1.0))).alias("positions"),
        *marks,
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **plan) -> DataFrame:
    """The mixed stream: docs, each row as often as taken, range-sorted by position.

    Keys may be null or repeat: a plan's row goes to a row with its key, source
    and text, and the rows that share all three are numbered, so that each has
    copies of its own. The columns of docs stay as they are.
    """
    p = private(docs)
    same, at, planned, n = [f"{p}key", f"{p}source", f"{p}text"], f"{p}at", f"{p}planned", f"{p}n"
    rows = docs.select(
        *docs.columns, F.col(key).alias(same[0]), F.col(source).cast("string").alias(same[1]), F.xxhash64(text).alias(same[2]),
        F.lit(None).cast("array<double>").alias(at), F.lit(False).alias(planned),
    )
    asked = _plan(docs, {same[2]: F.xxhash64(text)}, key=key, text=text, source=source, **plan).filter("copies > 0")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]
    asked = asked.select(*empty, F.col(key).alias(same[0]), F.col(source).alias(same[1]), same[2], F.col("positions").alias(at), F.lit(True).alias(planned))
    # one exchange serves both windows
    both = rows.unionByName(asked).repartition(*same)
    both = both.withColumn(n, F.row_number().over(Window.partitionBy(*same, planned).orderBy(at)))
    both = both.withColumn(at, F.max(at).over(Window.partitionBy(*same, n)))
    stream = both.filter(~F.col(planned)).select(*docs.columns, F.explode(at).alias(at))
    return stream.repartitionByRange(at, key).sortWithinPartitions(at, key).select(*docs.columns)


def sql(weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, tilts: Sequence[float] = TILTS, seed: int = 7) -> str:
    """The plan of documents in DuckDB's SQL, with the first position, for most = 2."""
    if most != 2:
        raise ValueError("written for two copies at most")
    first = "ORDER BY source_size / weight, rank"
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
    w AS (SELECT *, {list(weights)}[rank % {len(weights)} + 1] AS weight, CAST({list(tilts)}[rank % {len(tilts)} + 1] AS DOUBLE) AS tilt FROM s),
    f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(coalesce(sum(source_size * 2) OVER ({first} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
        CAST(sum(weight) OVER () - coalesce(sum(weight) OVER ({first} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open FROM w),
    k AS (SELECT *, (all_size * CAST({budget} AS DOUBLE) - capped) / open AS level_k FROM f),
    v AS (SELECT arg_min(level_k, (source_size / weight, rank)) FILTER (WHERE level_k * weight <= source_size * 2) AS level FROM k),
    t AS (SELECT source, source_size, tilt, coalesce(least(CAST(source_size * 2 AS DOUBLE), level * weight), CAST(source_size * 2 AS DOUBLE)) AS target FROM k, v),
    o AS (SELECT doc_id, size, source_size, target, tilt, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, CASE WHEN size > 0 THEN CAST(start + size / 2 <= target AS BIGINT) + CAST(start + source_size + size / 2 <= target AS BIGINT) ELSE 0 END AS copies, CAST(start AS DOUBLE) / target * (1 + tilt) / 2 AS asked FROM o)
    SELECT doc_id, size, source_size, target, size * copies AS taken,
        CASE WHEN copies > 0 THEN least(CASE WHEN abs(tilt - 1) < 1e-9 THEN asked ELSE (sqrt(greatest(1 + 2 * (tilt - 1) * asked, 0.0)) - 1) / (tilt - 1) END, 1.0) END AS position FROM c"""
