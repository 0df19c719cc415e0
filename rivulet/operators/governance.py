"""Measurements of freshness, safety, fairness and spread. What was not observed is null, never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.samples import with_columns

# Reasons for which a candidate is filtered; others count as unknown.
REASONS = ("expired", "muted_product_type", "muted_genre", "muted_keyword", "muted_title", "unknown")
# What readers are grouped by.
DIMENSIONS = ("age_band", "gender", "occupation", "geo", "device", "country", "subscription")
# Lower (not in the band, but 0 is) and upper age in days of the bands of content age.
AGES = (("0-7 d", 0, 7), ("8-30 d", 7, 30), ("31-90 d", 30, 90), ("91-365 d", 90, 365), ("> 1 y", 365, None))


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _text(value: Column) -> Column:
    """Trimmed text, null where it is blank."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def safety(samples: DataFrame, policy: str = "catalog-filter-v1") -> DataFrame:
    """One row: candidates, filter decisions by reason, and the share of unsafe ones among those with a label.

    Without any filter_reason the counts of reasons are null; with neither
    reasons nor labels (or without rows) status is unavailable.
    """
    rows = with_columns(samples, {"filter_reason": "string", "unsafe_label": "boolean"})
    reason = _text(F.col("filter_reason"))
    reason = F.when(reason.isNotNull(), F.when(reason.isin(*REASONS[:-1]), reason).otherwise(REASONS[-1]))
    rows = rows.select(reason.alias("reason"), F.col("unsafe_label").cast("boolean").alias("unsafe"))
    got = rows.agg(
        F.count("*").alias("evaluated_candidates"), F.count("reason").alias("seen"), F.count("unsafe").alias("labels"), F.count_if("unsafe").alias("bad"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS],
    )
    seen = lambda c: F.when(F.col("seen") > 0, c)
    return got.select(
        F.when((F.col("seen") > 0) | (F.col("labels") > 0), "available").otherwise("unavailable").alias("status"), F.lit(policy).alias("policy_version"), "evaluated_candidates",
        seen(F.col("seen")).alias("filter_decisions"), seen(_share(F.col("seen"), F.col("evaluated_candidates"))).alias("filter_decision_rate"), *[seen(F.col(f"n_{r}")).alias(r) for r in REASONS],
        seen(_share(F.col(f"n_{REASONS[-1]}"), F.col("evaluated_candidates"))).alias("unknown_share"),
        _share(F.col("bad"), F.col("labels")).alias("unsafe_exposure_rate"), _share(F.col("labels"), F.col("evaluated_candidates")).alias("unsafe_label_coverage"),
    )


def observed_ages(samples: DataFrame, now: int, window: int = 30) -> DataFrame:
    """(item_id, fresh, age in days or null, exposed, clicked) of samples that tell how old their item was.

    If any sample has published_at, that decides: the age is counted to the
    impression (to `now` where its time is missing or out of range), never below
    0. Otherwise new_release decides and there is no age.
    """
    rows = with_columns(samples, {"published_at": "bigint", "new_release": "boolean", "impression_ts": "bigint", "clicked": "int", "item_id": "string"})
    any_time = rows.agg(F.coalesce(F.max(F.col("published_at").isNotNull()), F.lit(False)).alias("timed"))
    shown = F.when((F.col("impression_ts") >= 0) & (F.col("impression_ts") < 10**11), F.col("impression_ts"))
    age = F.greatest(F.lit(0.0), (F.coalesce(shown, F.lit(now)) - F.col("published_at")) / F.lit(86400.0))
    known = F.when(F.col("timed"), F.col("published_at").isNotNull()).otherwise(F.col("new_release").isNotNull())
    rows = rows.crossJoin(F.broadcast(any_time)).filter(known)  # one row
    return rows.select(
        _text(F.col("item_id")).alias("item_id"), F.when(F.col("timed"), age <= window).otherwise(F.col("new_release")).alias("fresh"), F.when(F.col("timed"), age).alias("age"),
        F.when(F.col("timed"), shown.isNotNull()).otherwise(False).alias("exposed"), F.col("clicked").cast("double").alias("clicked"), "timed",
    )


def _clustered(rows: DataFrame, by: list[str], pivot: Column | None = None) -> DataFrame:
    """(by, mean, se): mean click-through and its standard error over items; null with fewer than two items.

    pivot: a column of rows, one value a group, to which items are compared instead of the mean.
    """
    per = rows.filter("item_id IS NOT NULL AND clicked IS NOT NULL").groupBy(*by, "item_id").agg(F.sum("clicked").alias("c"), F.count("*").cast("double").alias("n"), *([F.max(pivot).alias("pivot")] if pivot is not None else []))
    whole = per.withColumn("mean", F.sum("c").over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by)))
    centre = F.col("mean") if pivot is None else F.col("pivot")
    out = whole.groupBy(*by, "mean").agg(F.sum(F.pow(F.col("c") - centre * F.col("n"), F.lit(2.0))).alias("s"), F.sum("n").alias("n"), F.count("*").alias("m"))
    se = F.sqrt(F.col("s") / (F.col("n") * F.col("n")) * F.col("m") / (F.col("m") - 1))
    return out.filter("m > 1").select(*by, "mean", se.alias("se"))


def freshness(samples: DataFrame, now: int, window: int = 30) -> DataFrame:
    """One row: how much of what was shown is fresh, by which source, and how its click-through differs."""
    seen = observed_ages(samples, now, window)
    item = seen.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.max("fresh").alias("f")).agg(F.avg(F.col("f").cast("double")).alias("fresh_item_share"))
    total = samples.agg(F.count("*").alias("all"))
    got = seen.agg(
        F.max("timed").alias("timed"), F.count("*").alias("n"), F.count_if("fresh").alias("f"), F.count_if("exposed").alias("e"), F.avg("age").alias("mean_content_age_days"), F.percentile("age", 0.5).alias("median_content_age_days"),
        F.avg(F.when(F.col("fresh"), F.col("clicked"))).alias("fresh_ctr"), F.avg(F.when(~F.col("fresh"), F.col("clicked"))).alias("established_ctr"),
    )
    both = _clustered(seen, ["fresh"]).agg(
        F.max(F.when(F.col("fresh"), F.col("mean"))).alias("a"), F.max(F.when(F.col("fresh"), F.col("se"))).alias("x"),
        F.max(F.when(~F.col("fresh"), F.col("mean"))).alias("b"), F.max(F.when(~F.col("fresh"), F.col("se"))).alias("y"),
    )
    rows = got.crossJoin(item).crossJoin(total).crossJoin(both)  # one row each
    se = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    apart = lambda c: F.when(se > 0, c)
    share = _share(F.col("f"), F.col("n"))
    return rows.select(
        F.when(F.col("n") == 0, "unavailable").otherwise("available").alias("status"), F.when(F.col("timed"), "published_at").when(~F.col("timed"), "boolean_new_release").alias("freshness_source"),
        share.alias("fresh_share"), _share(F.col("n"), F.col("all")).alias("freshness_coverage"), F.when(F.col("timed"), _share(F.col("e"), F.col("n"))).alias("age_at_exposure_coverage"),
        "mean_content_age_days", "median_content_age_days", "fresh_ctr", "established_ctr", apart(F.col("a") - F.col("b")).alias("fresh_ctr_diff"), apart(se).alias("fresh_ctr_diff_se"),
        apart((F.col("a") - F.col("b")) / se).alias("fresh_ctr_diff_z"), "fresh_item_share", F.when(F.col("fresh_item_share") > 0, share / F.col("fresh_item_share")).alias("fresh_exposure_lift"),
    )


def age_bands(samples: DataFrame, now: int) -> DataFrame:
    """(band, exposures, exposure_share, items, item_share, ctr, z) of each band of content age, bands without rows too.

    z holds the band's click-through against that of all aged rows, by a standard
    error over items.
    """
    seen = observed_ages(samples, now).filter("age IS NOT NULL")
    # the bands are in order: the first whose end isn't passed
    where = F.lit(AGES[-1][0])
    for label, _, high in reversed(AGES[:-1]):
        where = F.when(F.col("age") <= high, label).otherwise(where)
    base = seen.agg(F.avg("clicked").alias("p0"), F.count("*").alias("all"))
    rows = seen.withColumn("band", where).crossJoin(F.broadcast(base))  # one row
    item = rows.groupBy("band", "item_id").agg(F.count("*").alias("n"), F.sum("clicked").alias("c"), F.count("clicked").alias("k"))
    per = item.groupBy("band").agg(F.sum("n").alias("exposures"), F.count("item_id").alias("items"), _share(F.sum("c"), F.sum("k")).alias("ctr"))
    z = _clustered(rows, ["band"], F.col("p0")).withColumnRenamed("mean", "m")
    every = seen.filter("item_id IS NOT NULL").select("item_id").distinct().agg(F.count("*").alias("every"))
    names = samples.sparkSession.createDataFrame([(a[0],) for a in AGES], "band string")
    out = names.join(per, "band", "left").join(z, "band", "left").crossJoin(F.broadcast(base)).crossJoin(F.broadcast(every))  # one row each
    return out.select(
        "band", F.coalesce("exposures", F.lit(0)).alias("exposures"), _share(F.coalesce("exposures", F.lit(0)), F.col("all")).alias("exposure_share"), F.coalesce("items", F.lit(0)).alias("items"),
        _share(F.coalesce("items", F.lit(0)), F.col("every")).alias("item_share"), "ctr", F.when(F.col("se") > 0, (F.col("m") - F.col("p0")) / F.col("se")).alias("z"),
    )


KEYS = ("ctr", "order_rate", "mean_reward")


def _outcomes(rows: DataFrame, by: list[str]) -> DataFrame:
    mean = lambda c, name: F.avg(F.col(c).cast("double")).alias(name)
    return rows.groupBy(*by).agg(F.count("*").alias("support"), mean("clicked", "ctr"), mean("ordered", "order_rate"), mean("reward", "mean_reward"))


def fairness(samples: DataFrame, least: int = 100, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(dimension, group, support, exposure_share, outcomes and their gaps from all, gaps and ratios of the dimension, what was suppressed).

    Groups under `least` samples are suppressed: counted, but not shown and in no
    gap. Blank values are the group unknown; dimensions that samples lack give no
    rows. A ratio is the smallest outcome by the largest; gaps and ratios need two groups.
    """
    if least <= 0:
        raise ValueError("least must be positive")
    there = [c for c in dict.fromkeys(dimensions) if c in DIMENSIONS and c in samples.columns]
    rows = with_columns(samples, {"clicked": "int", "ordered": "int", "reward": "double"})
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(_text(F.col(c)), F.lit("unknown")).alias("group")) for c in there]) if there else F.array().cast("array<struct<dimension:string,group:string>>")
    each = _outcomes(rows.select("clicked", "ordered", "reward", F.inline(pairs)), ["dimension", "group"])
    whole = _outcomes(rows, []).select(F.col("support").alias("all"), *[F.col(c).alias(f"overall_{c}") for c in KEYS])
    w = Window.partitionBy("dimension")
    small = F.col("support") < least
    out = each.withColumns({"suppressed_group_count": F.count_if(small).over(w), "suppressed_candidate_count": F.coalesce(F.sum(F.when(small, F.col("support"))).over(w), F.lit(0))}).filter(~small)
    spread = {}
    for c in KEYS:
        several = F.count(c).over(w) >= 2
        spread[f"{c}_max_min_gap"] = F.when(several, F.max(c).over(w) - F.min(c).over(w))
        spread[f"{c}_disparity_ratio"] = F.when(several & (F.max(c).over(w) > 0), F.min(c).over(w) / F.max(c).over(w))
    out = out.withColumns(spread).crossJoin(F.broadcast(whole))  # one row
    return out.withColumn("exposure_share", _share(F.col("support"), F.col("all"))).withColumns({f"{c}_absolute_gap_from_overall": F.abs(F.col(c) - F.col(f"overall_{c}")) for c in KEYS}).drop("all")


def spread(exposures: DataFrame, catalog_size: int | None = None) -> DataFrame:
    """One row over (user_id, item_id) exposures: items served, coverage, Gini, the top decile's share, repeats.

    catalog_size: items there are; those never served count as zeros. Ranks come
    from counts of counts, so one task sees one row per different count.
    """
    item = exposures.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.count("*").alias("c"))
    counts = item.groupBy("c").agg(F.count("*").alias("k"))
    pad = F.greatest(F.lit(catalog_size or 0).cast("long") - F.sum("k").over(Window.partitionBy()), F.lit(0))
    up = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"pad": pad, "below": F.coalesce(F.sum("k").over(up), F.lit(0)), "n": F.sum("k").over(Window.partitionBy())}).withColumn("m", F.col("n") + F.col("pad"))
    lo, m, k, c = F.col("below") + F.col("pad"), F.col("m"), F.col("k"), F.col("c")
    # the places lo + 1 to lo + k have the count c: the sum of 2 i - m - 1 over them is k (2 lo + k - m)
    top = F.floor(m / 10)
    in_top = F.greatest(F.lit(0), F.least(k, lo + k - (m - top)))
    got = placed.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum(c * k).alias("total"), F.sum((k * (2 * lo + k - m) * c).cast("double")).alias("g"), F.sum(in_top * c).alias("t"))
    users = exposures.filter("user_id IS NOT NULL AND item_id IS NOT NULL").groupBy("user_id", "item_id").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.count("*").alias("d"), F.sum("c").alias("s"))
    size = F.lit(float(catalog_size or 0))
    per = users.agg(
        F.percentile("d", 0.5).alias("median_items_per_user"), (1 - _share(F.sum("d"), F.sum("s"))).alias("user_repeat_rate"),
        (1 - _share(F.sum(size * (1 - F.pow(1 - 1 / F.greatest(size, F.lit(1.0)), F.col("s")))), F.sum("s"))).alias("uniform"),
    )
    known = F.lit(bool(catalog_size))
    return got.crossJoin(per).select(  # one row each
        F.col("n").alias("items_served"), F.when(known & (F.col("n") <= size), F.col("n") / size).alias("catalog_coverage"), (F.col("g") / (F.col("m").cast("double") * F.col("total"))).alias("exposure_gini"),
        F.when(F.col("m") >= 10, _share(F.col("t"), F.col("total"))).alias("top_decile_exposure_share"), "median_items_per_user", "user_repeat_rate", F.when(known, F.col("uniform")).alias("user_repeat_rate_uniform"),
    )


#: Signals of satisfaction: a column of samples, the name of its mean and of the share of samples that have it.
SIGNALS = (
    ("clicked", "ctr", "ctr_coverage"), ("ordered", "order_rate", "order_coverage"), ("reward", "mean_reward", "reward_coverage"), ("rating", "mean_rating", "rating_coverage"),
    ("dwell_millis", "mean_dwell_millis", "dwell_coverage"), ("completion_rate", "mean_completion_rate", "completion_coverage"),
)


def satisfaction(samples: DataFrame) -> DataFrame:
    """One row: the mean of each signal and how many samples have it, negative feedback (null without any), users and items."""
    rows = with_columns(samples, {c: "double" for c, _, _ in SIGNALS} | {"negative_feedback_reason": "string", "user_id": "string", "item_id": "string"})
    n = F.count("*")
    negative = F.count("negative_feedback_reason")
    got = [x for c, mean, share in SIGNALS for x in (F.avg(F.col(c).cast("double")).alias(mean), _share(F.count(c), n).alias(share))]
    rate = _share(negative, n)
    out = rows.agg(*got, F.when(negative > 0, rate).alias("negative_feedback_rate"), rate.alias("negative_feedback_coverage"), F.count("rating").alias("rated_samples"))
    # different users and items, from one row each
    users, items = (rows.filter(F.col(c).isNotNull()).select(c).distinct().agg(F.count("*").alias(f"{c[:4]}s")) for c in ("user_id", "item_id"))
    return out.crossJoin(users).crossJoin(items)  # one row each


def slate_diversity(items: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Per slate, of items (slate_id, item_id, genres, popularity): different genres, their normalised entropy, the mean distance
    (1 - Jaccard) of its items' genres, the share of items less popular than cutoff, and how many have genres or a popularity.

    Pairs are made within a slate only. Without genres, or popularities, the figures are null.
    """
    rows = items.select("slate_id", F.array_distinct("genres").alias("g"), F.coalesce("genres", F.array().cast("array<string>")).alias("all"), "popularity")
    per = rows.groupBy("slate_id").agg(
        F.count("*").alias("n"), F.flatten(F.collect_list("all")).alias("flat"), F.collect_list(F.when(F.size("g") > 0, F.col("g"))).alias("sets"),
        F.count("popularity").alias("p"), F.count_if(F.col("popularity") < F.lit(cutoff)).alias("tail"),
    )
    kinds = F.array_distinct("flat")
    shares = F.transform(kinds, lambda k: F.size(F.filter("flat", lambda x: x == k)) / F.size("flat"))
    entropy = -F.aggregate(shares, F.lit(0.0), lambda a, x: a + x * F.log(x)) / F.log(F.size(kinds))
    apart = lambda a, b: 1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    later = lambda i: F.slice("sets", i + 2, F.size("sets"))
    distances = F.flatten(F.transform("sets", lambda a, i: F.transform(later(i), lambda b: apart(a, b))))
    some = F.size("flat") > 0
    return per.select(
        "slate_id", F.when(some, F.size(kinds)).alias("unique_genres"), F.when(some, F.when(F.size(kinds) > 1, entropy).otherwise(0.0)).alias("genre_entropy"),
        F.when(F.size("sets") > 1, F.aggregate(distances, F.lit(0.0), lambda a, x: a + x) / F.size(distances)).alias("genre_distance"),
        F.when(F.lit(cutoff is not None), _share(F.col("tail"), F.col("p"))).alias("long_tail_share"),
        _share(F.size("sets"), F.col("n")).alias("genre_coverage"), _share(F.col("p"), F.col("n")).alias("popularity_coverage"),
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin_start, count) of ten bins of values between 0 and 1, empty ones too; 1 is in the last."""
    spot = F.least(F.floor(F.round(F.col(column) * 10, 9)), F.lit(9)).cast("int")
    found = df.filter(F.col(column).isNotNull()).groupBy(spot.alias("b")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(10).select(F.col("id").cast("int").alias("b"))
    return bins.join(F.broadcast(found), "b", "left").select((F.col("b") / 10).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("count"))


def genre_exposure(items: DataFrame) -> DataFrame:
    """(genre, exposure_share, served_share): a genre's part of all that was shown, and of the different items shown."""
    each = items.select("item_id", F.explode("genres").alias("genre")).groupBy("item_id", "genre").agg(F.count("*").alias("n"))
    first = items.groupBy("item_id").agg(F.count("*").alias("shown"))
    per = each.join(first, "item_id").groupBy("genre").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("shown")).alias("d"))
    w = Window.partitionBy()  # one row a genre
    return per.select("genre", (F.col("n") / F.sum("n").over(w)).alias("exposure_share"), (F.col("d") / F.sum("d").over(w)).alias("served_share"))
