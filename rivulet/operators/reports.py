"""Reports of engagement by session, category, keyword, reader segment and relevance state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.derive import age_band, levels, primary_genre, secondary_genre, zip_region


def _rate(a: str, b: str, digits: int) -> Column:
    return F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), digits)


def sessions(samples: DataFrame) -> DataFrame:
    """One row per (session, user) with its engagement; rows without a session don't count."""
    # one row a request first, so that counting requests needs no second copy of the rows
    per = samples.filter(F.col("session_id") != "").groupBy("session_id", "user_id", "request_id").agg(F.count("*").alias("n"), F.sum("clicked").alias("c"), F.sum("ordered").alias("o"))
    out = per.groupBy("session_id", "user_id").agg(F.count("request_id").alias("slates"), F.sum("n").alias("impressions"), F.sum("c").alias("clicks"), F.sum("o").alias("orders"))
    return out.withColumn("ctr", _rate("clicks", "impressions", 4))


def session_summary(rows: DataFrame) -> DataFrame:
    """One row over the rows of sessions(): how many, and what an average one holds; 0 where there are none."""
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("slates", "impressions", "clicks", "ctr")])
    got = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), F.count("*").alias("users"), *[F.sum(c).cast("double").alias(c) for c in ("slates", "impressions", "clicks", "ctr")])
    mean = lambda c, by, digits, name: F.round(F.coalesce(F.try_divide(F.col(c), F.col(by).cast("double")), F.lit(0.0)), digits).alias(name)
    return got.select(
        F.col("sessions").cast("long").alias("sessions"), "users", mean("sessions", "users", 3, "sessions_per_user"), mean("slates", "sessions", 3, "slates_per_session"),
        mean("impressions", "sessions", 2, "impressions_per_session"), mean("clicks", "sessions", 3, "clicks_per_session"), mean("ctr", "sessions", 4, "mean_session_ctr"),
    )


def with_keywords(samples: DataFrame) -> DataFrame:
    """samples (genres array, release_year if there is one) with keyword, subkeyword and the levels l1 to l3."""
    year = F.col("release_year") if "release_year" in samples.columns else F.lit(None)
    genres = F.filter("genres", lambda g: F.length(F.trim(g)) > 0)
    return samples.withColumns({"keyword": primary_genre(genres), "subkeyword": secondary_genre(genres)} | levels(genres, year))


def keyword_distribution(rows: DataFrame, by: str) -> DataFrame:
    """Impressions, different items and clicks of each value of `by`; counted an item at a time, so no row is copied."""
    per = rows.groupBy(by, "item_id").agg(F.count("*").alias("n"), F.sum("clicked").alias("c"))
    return per.groupBy(by).agg(F.sum("n").alias("movie_impressions"), F.count("item_id").alias("distinct_movies"), F.sum("c").alias("query_clicks"))


def top_keywords(rows: DataFrame, level: str, most: int = 10) -> DataFrame:
    """The genres with the most impressions in each category of a level, with their clicks and rank."""
    per = rows.select(level, "clicked", F.explode("genres").alias("keyword")).groupBy(level, "keyword").agg(F.count("*").alias("movie_impressions"), F.sum("clicked").alias("query_clicks"))
    rank = F.row_number().over(Window.partitionBy(level).orderBy(F.desc("movie_impressions"), "keyword"))
    return per.withColumn("rank", rank).filter(F.col("rank") <= most)


def top_of_levels(rows: DataFrame, most: int = 10) -> DataFrame:
    """(level, category, keyword, ..., rank): for each level the ranks of its first categories, `most` rows of each level in all."""
    found = [top_keywords(rows, c, most).withColumnRenamed(c, "category").select(F.lit(c).alias("level"), "*") for c in ("l1", "l2", "l3")]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    # `most` rows a level are the first by (category, rank)
    place = F.row_number().over(Window.partitionBy("level").orderBy("category", "rank"))
    return every.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def per_item(samples: DataFrame) -> DataFrame:
    return samples.groupBy("item_id").agg(F.count("*").alias("impressions"), F.sum("clicked").alias("clicks"), F.sum("ordered").alias("orders"))


def per_user(samples: DataFrame) -> DataFrame:
    return samples.groupBy("user_id").agg(F.count("*").alias("impressions"), F.sum("clicked").alias("clicks"), F.sum("ordered").alias("orders"))


def overall_rate(samples: DataFrame) -> DataFrame:
    """One row, base: the click-through of all samples, to four digits."""
    return samples.agg(F.round(F.avg(F.col("clicked").cast("double")), 4).alias("base"))


def _rates(grouped: DataFrame, base: DataFrame, per: str, name: str, digits: int) -> DataFrame:
    """Rounded rates of groups, and by how many percent the click-through is above base (one row)."""
    rows = grouped.crossJoin(F.broadcast(base))  # base is one row
    rows = rows.withColumns({"ctr": _rate("clicks", "impressions", 4), "order_rate": _rate("orders", "impressions", 4), name: _rate("clicks", per, digits)})
    return rows.withColumn("ctr_lift_pct", F.round(F.try_divide(F.col("ctr") - F.col("base"), F.col("base")) * 100, 1)).drop("base")


def category_metrics(samples: DataFrame, features: DataFrame, level: str) -> DataFrame:
    """Engagement by a category of items. features: (item_id, level); items without features don't count."""
    base = overall_rate(samples)
    joined = per_item(samples).join(features.select("item_id", level), "item_id")
    grouped = joined.groupBy(level).agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "orders")], F.count("*").alias("items"))
    return _rates(grouped, base, "items", "clicks_per_item", 2)


def device_metrics(samples: DataFrame) -> DataFrame:
    """Engagement by device: the column, else the context's platform, else its device."""
    typed = F.col("device") if "device" in samples.columns else F.lit(None).cast("string")
    older = F.coalesce(F.col("context_features")["platform"], F.col("context_features")["device"]) if "context_features" in samples.columns else F.lit(None).cast("string")
    per = samples.groupBy(F.coalesce(typed, older).alias("device"), "user_id").agg(F.count("*").alias("n"), F.sum("clicked").alias("c"), F.sum("ordered").alias("o"))
    grouped = per.groupBy("device").agg(F.sum("n").alias("impressions"), F.sum("c").alias("clicks"), F.sum("o").alias("orders"), F.count("user_id").alias("users"))
    return _rates(grouped, overall_rate(samples), "users", "clicks_per_user", 3)


def demographics(users: DataFrame) -> DataFrame:
    """What is known of readers (user_id, gender, occupation, age, zip_code, avg_rating, rating_count) in bands."""
    return users.select(
        "user_id", "gender", "occupation", age_band(F.col("age")).alias("age_band"), zip_region(F.col("zip_code")).alias("geo"),
        F.col("avg_rating").cast("string").try_cast("double").alias("user_avg_rating"), F.col("rating_count").cast("string").try_cast("long").alias("user_rating_count"),
    )


def demographic_metrics(samples: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Engagement by a column of demographics(), and the mean rating weighed by each reader's number of ratings."""
    joined = per_user(samples).join(known, "user_id")
    grouped = joined.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in ("impressions", "clicks", "orders")], F.count("*").alias("users"),
        F.sum(F.col("user_avg_rating") * F.col("user_rating_count")).alias("total"), F.sum("user_rating_count").alias("n"),
    )
    out = _rates(grouped, overall_rate(samples), "users", "clicks_per_user", 3)
    return out.withColumn("avg_rating", F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n"), 3))).drop("total", "n")


#: Queries up to so many characters are short.
SHORT = 10


def with_query(samples: DataFrame) -> DataFrame:
    """samples with query (the genres in a row, unknown without any), its length and whether it is short."""
    combined = F.concat_ws(" ", "genres")
    rows = samples.withColumn("query", F.when(combined == "", "unknown").otherwise(combined))
    size = F.length("query")
    return rows.withColumns({"query_len": size, "query_length": F.when(size <= SHORT, f"short (<={SHORT})").otherwise(f"long (>{SHORT})")})


def query_engagement(rows: DataFrame, by: list[str]) -> DataFrame:
    """Engagement of with_query() rows by some columns: impressions, users, sessions, different queries, clicks, orders and rates.

    Rows are first brought together by user, session and query, so that counting
    different ones copies no sample.
    """
    per = rows.groupBy(*by, "user_id", "session_id", *[c for c in ("query",) if c not in by]).agg(F.count("*").alias("n"), F.sum("clicked").alias("c"), F.sum("ordered").alias("o"), F.sum("label").alias("r"))
    out = per.groupBy(*by).agg(
        F.sum("n").alias("impressions"), F.countDistinct("user_id").alias("users"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("query").alias("distinct_queries"),
        F.sum("c").alias("clicks"), F.sum("o").alias("orders"), F.sum("r").alias("r"),
    )
    return out.withColumns({"ctr": _rate("clicks", "impressions", 4), "cvr": _rate("orders", "impressions", 4), "avg_rating": _rate("r", "impressions", 4)}).drop("r")


#: Relevance states by label, from 0.
STATES = ("impression_only", "clicked", "ordered")


def relevance_state(label: Column) -> Column:
    return F.when(label >= 2.0, STATES[2]).when(label >= 1.0, STATES[1]).otherwise(STATES[0])


def state_distribution(samples: DataFrame) -> DataFrame:
    """(relevance_state, score, impressions, proportion) of samples."""
    rows = samples.groupBy(relevance_state(F.col("label")).alias("relevance_state")).agg(F.min("label").alias("score"), F.count("*").alias("impressions"))
    return rows.withColumn("proportion", F.round(F.col("impressions").cast("double") / F.sum("impressions").over(Window.partitionBy()), 4))  # at most three rows


def relevance_breakdown(samples: DataFrame, by: str) -> DataFrame:
    """Impressions, mean label and the share of each state, by query (the genres in a row) or by genre."""
    if by == "genre":
        rows = samples.select(F.explode("genres").alias("genre"), "label")
    else:
        combined = F.concat_ws(" ", "genres")
        rows = samples.select(F.when(combined == "", "unknown").otherwise(combined).alias(by), "label")
    state = relevance_state(F.col("label"))
    share = lambda s: F.round(F.avg(F.when(state == s, 1.0).otherwise(0.0)), 4).alias(f"{s}_share")
    return rows.groupBy(by).agg(F.count("*").alias("impressions"), F.round(F.avg("label"), 4).alias("mean_score"), *[share(s) for s in STATES])


def split_by_date(df: DataFrame, days: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows before the newest `days` dates (one at least), the rows of these, and how many they are; rows without a date are in neither.

    The counts are found with the dates, in one pass; `days` rows come to the driver.
    """
    newest = df.filter(F.col("date").isNotNull()).groupBy(F.col("date").cast("string").alias("d")).agg(F.count("*").alias("n"))
    held = newest.orderBy(F.desc("d")).limit(max(1, days)).collect()
    out = F.col("date").cast("string").isin([r["d"] for r in held])
    return df.filter(~out), df.filter(out), sum(r["n"] for r in held)


def filled_from_catalog(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """samples with the catalog's genres where they have none, and its release_year if they have no such column."""
    kept = catalog.select("item_id", F.col("genres").alias("catalog_genres"), *([] if "release_year" in samples.columns else ["release_year"]))
    out = samples.join(kept, "item_id", "left")
    none = F.coalesce(F.size("genres"), F.lit(0)) <= 0
    return out.withColumn("genres", F.when(none, F.coalesce("catalog_genres", F.array().cast("array<string>"))).otherwise(F.col("genres"))).drop("catalog_genres")
