"""Training samples and the datasets made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.columns import ENGAGEMENT, FEEDBACK, IMPRESSIONS, ORDERS, THUMBS, Gate, flag, utc_date

KEYS = ["request_id", "user_id", "item_id"]

#: What an impression says about the models that chose it and about its item; all from one impression, the last.
MEASURED = {
    "model_version": "string", "policy_version": "string", "algorithm_version": "string", "published_at": "bigint",
    "new_release": "boolean", "filter_reason": "string", "unsafe_label": "boolean",
}
#: What a reader answers with; each the latest value that isn't null.
ANSWERS = {"rating": "double", "negative_feedback_reason": "string", "dwell_millis": "bigint", "completion_rate": "double"}
#: Where an impression was shown; each the first value that isn't null.
PLACES = {"surface": "string", "locale": "string", "timezone": "string", "device": "string"}
FEATURES = {"user_features": "map<string,string>", "item_features": "map<string,string>", "context_features": "map<string,string>"}


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with the columns of wanted that it lacks, as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in df.columns})


def _no_features() -> Column:
    return F.create_map().cast("map<string,string>")


def joiner_gate(events: DataFrame) -> Gate:
    """Events that can become samples; the reasons name the first field that is missing."""
    seconds = events if "timestamp" in events.columns else events.withColumn("timestamp", F.expr("timestamp_ms div 1000"))
    return Gate(seconds, [(f"null_{c}", F.col(c).isNotNull()) for c in (*KEYS, "event_type", "timestamp")])


def samples_gate(samples: DataFrame) -> Gate:
    """Samples that can go into slates."""
    return Gate(samples, [(f"null_{c}", F.col(c).isNotNull()) for c in KEYS])


def build_samples(events: DataFrame) -> DataFrame:
    """One row per (request, user, item) that has an impression.

    events: request_id, user_id, item_id, event_type, timestamp (epoch seconds),
    and optionally event_id, timestamp_ms, session_id, position and the columns
    of MEASURED, ANSWERS, PLACES and FEATURES. Impressions and what answers them
    meet in one aggregate, one shuffle.

    Position and time are the largest of the impressions; the measured fields come
    together from the last impression by (timestamp, event id). Each answer is the
    latest value that isn't null, of any feedback; only clicks and orders move
    last_feedback_ts and the delay, which is in milliseconds (from seconds where
    an event has no timestamp_ms). thumb is 1 or -1 by the latest thumb, null
    without one. A request shows several values of places, features or session_id:
    the earliest.
    """
    rows = with_columns(events, {"event_id": "string", "timestamp_ms": "bigint", "session_id": "string", "position": "int"} | MEASURED | ANSWERS | PLACES | FEATURES)
    rows = rows.withColumn("timestamp_ms", F.coalesce("timestamp_ms", (F.col("timestamp") * 1000).cast("long")))
    kind = F.lower(F.trim("event_type"))
    shown, engaged, answered, thumbed = (kind.isin(*k) for k in (IMPRESSIONS, ENGAGEMENT, FEEDBACK, THUMBS))
    order = F.struct(F.col("timestamp"), F.coalesce("event_id", F.lit("")))

    def latest(c: str, where: Column) -> Column:
        given = where & F.col(c).isNotNull()
        return F.max_by(F.when(given, F.col(c)), F.when(given, order))

    def earliest(c: str, where: Column) -> Column:
        given = where & F.col(c).isNotNull()
        return F.min_by(F.when(given, F.col(c)), F.when(given, order)).alias(c)

    is_ = lambda *kinds: F.max(flag(kind.isin(*kinds)))
    rows = rows.groupBy(*KEYS).agg(
        F.max(F.when(shown, F.col("position"))).alias("position"),
        F.max(F.when(shown, F.col("timestamp"))).alias("impression_ts"),
        F.max(F.when(shown, F.col("timestamp_ms"))).alias("impression_ms"),
        is_("click").alias("clicked"),
        is_(*ORDERS).alias("ordered"),
        F.max_by(F.when(shown, F.struct(*MEASURED)), F.when(shown, order)).alias("measured"),
        latest("timestamp", engaged).alias("last_feedback_ts"),
        latest("timestamp_ms", engaged).alias("last_feedback_ms"),
        *[latest(c, answered).cast(k).alias(c) for c, k in ANSWERS.items()],
        earliest("session_id", F.lit(True)),
        *[earliest(c, shown) for c in (*PLACES, *FEATURES)],
        F.max_by(F.when(thumbed, F.when(kind == "thumb_up", 1).otherwise(-1)), F.when(thumbed, order)).alias("thumb"),
        is_("abandon").alias("abandoned"),
    )
    return rows.filter(F.col("impression_ts").isNotNull()).select(
        F.concat_ws(":", *KEYS).alias("sample_id"), *KEYS, "position", "impression_ts", F.timestamp_seconds("impression_ts").alias("impression_time"), "clicked", "ordered",
        F.when(F.col("ordered") == 1, 2.0).when(F.col("clicked") == 1, 1.0).otherwise(0.0).alias("label"),
        "last_feedback_ts", (F.col("last_feedback_ms") - F.col("impression_ms")).cast("long").alias("feedback_delay_ms"),
        *[F.col(f"measured.{c}").alias(c) for c in MEASURED], *ANSWERS, F.coalesce("session_id", F.lit("")).alias("session_id"),
        "thumb", "abandoned", *PLACES, *[F.coalesce(c, _no_features()).alias(c) for c in FEATURES],
    )


def with_date(samples: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """samples with their UTC date and the catalog's genres; unmatched items have none.

    The catalog is a reference table of unknown size: Spark broadcasts it if it is
    small enough, and joins by shuffle otherwise.
    """
    out = samples.withColumn("date", utc_date(F.col("impression_ts")))
    none = F.array().cast("array<string>")
    if catalog is None:
        return out.withColumn("genres", none)
    return out.join(catalog.select("item_id", "genres"), "item_id", "left").withColumn("genres", F.coalesce("genres", none))


#: Fields of a slate's item, in order.
ITEM = ("position", "item_id", "clicked", "ordered", "label", "last_feedback_ts", "feedback_delay_ms", *list(MEASURED)[:3], *ANSWERS, *list(MEASURED)[3:], "item_features")


def build_slates(samples: DataFrame) -> DataFrame:
    """One row per (request, user): items by position, nulls last, then by item.

    Measured fields that samples lacks are null. session_id and the features are
    those of the item that stands first of those that have any.
    """
    kinds = {"session_id": "string", "position": "int", "last_feedback_ts": "bigint", "feedback_delay_ms": "bigint"} | MEASURED | ANSWERS | FEATURES
    rows = with_columns(samples, kinds).withColumns({c: F.coalesce(c, _no_features()) for c in FEATURES})
    at = F.struct(F.col("position").isNull(), "position", "item_id")
    item = F.struct(F.col("position").isNull().alias("unplaced"), F.col("position").alias("at"), F.col("item_id").alias("id"), F.struct(*ITEM).alias("item"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    out = rows.groupBy("request_id", "user_id").agg(
        first("session_id"), F.min("impression_ts").alias("request_ts"), F.max("clicked").alias("slate_clicked"), F.max("ordered").alias("slate_ordered"),
        F.sum("label").alias("slate_reward"), first("user_features"), first("context_features"),
        F.array_sort(F.collect_list(item), lambda x, y: reduce(lambda rest, c: F.when(x[c] < y[c], -1).when(x[c] > y[c], 1).otherwise(rest), ("id", "at", "unplaced"), F.lit(0))).alias("items"),
    )
    return out.select(
        F.concat_ws(":", "request_id", "user_id").alias("slate_id"), "request_id", "user_id", "session_id", "request_ts", "slate_clicked", "slate_ordered", "slate_reward",
        F.size("items").alias("slate_size"), "user_features", "context_features", F.transform("items", lambda i: i["item"]).alias("items"),
    )


def recall_samples(samples: DataFrame) -> DataFrame:
    return samples.select("user_id", "request_id", "item_id", F.when(F.col("clicked") == 1, F.col("item_id")).alias("clicked_item_id"), F.col("impression_ts").alias("ts"))


def ranking_samples(samples: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Both sides' vectors by left joins; a missing one is an empty array and the row stays."""
    none = F.array().cast("array<double>")
    out = samples.join(users.select("user_id", F.col("vector").alias("user_vector")), "user_id", "left").join(items.select("item_id", F.col("vector").alias("item_vector")), "item_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("array<double>"), none) for c in ("user_vector", "item_vector")})


def relevance_samples(samples: DataFrame, films: DataFrame | None = None) -> DataFrame:
    """A query key of user and session, or user and request where the session is blank, with what films (item_id, title, genres, release_year) say.

    Items without film data stay: no title, no genres.
    """
    blank = F.coalesce(F.length(F.trim("session_id")) == 0, F.lit(True))
    rows = samples.select(F.concat_ws(":", "user_id", F.when(blank, F.col("request_id")).otherwise(F.col("session_id"))).alias("query"), "item_id", "label", "position")
    if films is None:
        return rows
    out = rows.join(films.select("item_id", "title", "genres", "release_year"), "item_id", "left")
    return out.withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def with_ingest_lag(slates: DataFrame, sent: str = "kafka_timestamp") -> DataFrame:
    """Slates that name slate, request and user, with the milliseconds from the request to the message; null where one is missing."""
    lag = F.unix_millis(F.col(sent)) - F.col("request_ts") * 1000
    named = F.col("slate_id").isNotNull() & F.col("request_id").isNotNull() & F.col("user_id").isNotNull()
    return slates.withColumn("kafka_ingest_lag_ms", lag).drop(sent).filter(named)


def metric_events(slates: DataFrame, large: int = 20) -> DataFrame:
    """(slate_id, metric, value) of the metrics that aren't 0, and a delay per answered item, 0 or not."""
    fixed = {"clicks": F.col("slate_clicked"), "orders": F.col("slate_ordered"), "reward": F.col("slate_reward"), "items": F.col("slate_size"), "large_slate": flag(F.col("slate_size") > large)}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), F.lit(False).alias("keep")) for k, v in fixed.items()])
    delays = F.transform(F.filter("items", lambda i: i["last_feedback_ts"].isNotNull()), lambda i: F.struct(F.lit("feedback_delay_s").alias("metric"), (i["last_feedback_ts"] - F.col("request_ts")).cast("double").alias("value"), F.lit(True).alias("keep")))
    return slates.select("slate_id", F.explode(F.filter(F.concat(pairs, delays), lambda m: m["keep"] | (m["value"] != 0))).alias("m")).select("slate_id", "m.metric", "m.value")


def classified(events: DataFrame) -> DataFrame:
    """Context events with what each feeds: is_rating, is_user_update, is_movie_update; one event may feed several."""
    kinds = {"user_id": "string", "item_id": "string", "rating": "double", "age": "int", "gender": "string", "occupation": "string", "zip_code": "string", "title": "string", "genres": "array<string>", "release_year": "int"}
    rows = with_columns(events, kinds).withColumn("event_type", F.lower(F.trim(F.coalesce("event_type", F.lit("")))))
    any_of = lambda *cols: F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in cols], F.lit(False))
    user, item = F.col("user_id").isNotNull(), F.col("item_id").isNotNull()
    return rows.withColumns({
        "is_rating": (F.col("event_type") == "rating") & user & item,
        "is_user_update": user & any_of("age", "gender", "occupation", "zip_code"),
        "is_movie_update": item & (any_of("title", "release_year") | (F.coalesce(F.size("genres"), F.lit(0)) > 0)),
    })


def context_gate(events: DataFrame) -> Gate:
    """Context events that feed something."""
    return Gate(classified(events), [("unclassifiable_shape", F.col("is_rating") | F.col("is_user_update") | F.col("is_movie_update"))])


def _first(c: str, name: str) -> Column:
    """The value of the earliest event that has one."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("timestamp", c))).alias(name)


def user_feature_updates(events: DataFrame, recent: int = 50) -> DataFrame:
    """What classified events change of each user: demographics, ratings added, items rated latest (new ones first)."""
    who = events.filter("is_user_update").groupBy("user_id").agg(F.max("age").alias("age"), _first("gender", "gender"), _first("occupation", "occupation"), _first("zip_code", "zipCode"), F.max("timestamp").alias("seen"))
    rated = F.collect_list(F.struct((-F.coalesce("timestamp", F.lit(0))).alias("o"), F.col("item_id").alias("i")))
    ratings = events.filter("is_rating").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.max("timestamp").alias("rated"), F.slice(F.array_sort(rated), 1, recent).alias("items"))
    return who.join(ratings, "user_id", "full_outer").select(
        "user_id", "age", "gender", "occupation", "zipCode", F.coalesce("n", F.lit(0)).alias("ratingCountDelta"), F.coalesce("total", F.lit(0.0)).alias("ratingSumDelta"),
        F.coalesce(F.transform("items", lambda x: x["i"]), F.array().cast("array<string>")).alias("recentlyRatedMovieIds"), F.greatest("seen", "rated").alias("lastUpdatedTs"),
    )


def movie_feature_updates(events: DataFrame) -> DataFrame:
    """What classified events say of each film."""
    rows = events.filter("is_movie_update")
    return rows.groupBy("item_id").agg(_first("title", "title"), _first("genres", "genres"), F.max("release_year").alias("releaseYear"), F.max("timestamp").alias("lastUpdatedTs"))


def upsert_users(state: DataFrame | None, update: DataFrame, recent: int = 50) -> DataFrame:
    """Users' features after an update: what it has replaces, counts and sums add up, the mean follows, latest items come first."""
    u = update.select("user_id", *[F.col(c).alias(f"u_{c}") for c in update.columns if c != "user_id"])
    names = ["age", "gender", "occupation", "zipCode"]
    if state is None:
        kinds = {c: t for c, t in update.dtypes}
        state = update.limit(0).select("user_id", *names, F.lit(None).cast("bigint").alias("ratingCount"), F.lit(None).cast("double").alias("ratingSum"), F.lit(None).cast(kinds["recentlyRatedMovieIds"]).alias("recentlyRatedMovieIds"), "lastUpdatedTs")
    out = state.select("user_id", *names, "ratingCount", "ratingSum", "recentlyRatedMovieIds", "lastUpdatedTs").join(u, "user_id", "full_outer")
    none = F.array().cast("array<string>")
    n = F.coalesce("ratingCount", F.lit(0)) + F.coalesce("u_ratingCountDelta", F.lit(0))
    total = F.coalesce("ratingSum", F.lit(0.0)) + F.coalesce("u_ratingSumDelta", F.lit(0.0))
    items = F.slice(F.array_distinct(F.concat(F.coalesce("u_recentlyRatedMovieIds", none), F.coalesce("recentlyRatedMovieIds", none))), 1, recent)
    return out.select(
        "user_id", *[F.coalesce(f"u_{c}", c).alias(c) for c in names], n.cast("long").alias("ratingCount"), total.alias("ratingSum"), F.when(n > 0, total / n).alias("avgRating"),
        items.alias("recentlyRatedMovieIds"), F.greatest("lastUpdatedTs", "u_lastUpdatedTs").alias("lastUpdatedTs"),
    )


def upsert_movies(state: DataFrame | None, update: DataFrame) -> DataFrame:
    """Films' features after an update: what it has replaces."""
    if state is None:
        return update
    names = [c for c in update.columns if c not in ("item_id", "lastUpdatedTs")]
    u = update.select("item_id", *[F.col(c).alias(f"u_{c}") for c in update.columns if c != "item_id"])
    return state.join(u, "item_id", "full_outer").select("item_id", *[F.coalesce(f"u_{c}", c).alias(c) for c in names], F.greatest("lastUpdatedTs", "u_lastUpdatedTs").alias("lastUpdatedTs"))


def merge_context(updates: DataFrame, deltas: DataFrame) -> DataFrame:
    """Demographic updates and rating deltas of users, from either side."""
    return updates.join(deltas, "user_id", "full_outer")


def upsert_running(state: DataFrame, delta: DataFrame, recent: int = 10) -> DataFrame:
    """Running count and sum per user, and the latest different items, new ones first."""
    d = delta.select("user_id", F.col("n").alias("dn"), F.col("total").alias("dt"), F.col("items").alias("di"))
    none = F.array().cast("array<string>")
    out = state.join(d, "user_id", "full_outer")
    return out.select(
        "user_id", (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), (F.coalesce("total", F.lit(0.0)) + F.coalesce("dt", F.lit(0.0))).alias("total"),
        F.slice(F.array_distinct(F.concat(F.coalesce("di", none), F.coalesce("items", none))), 1, recent).alias("items"),
    )


def item_sequences(ratings: DataFrame, least: float = 3.5, length: int = 2) -> DataFrame:
    """Liked items of each user by time, of users with `length` or more."""
    liked = ratings.filter(F.col("userId").isNotNull() & F.col("movieId").isNotNull() & F.col("timestamp").isNotNull() & (F.col("rating") >= least))
    rows = liked.groupBy("userId").agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "movieId"))), lambda x: x["movieId"]).alias("items"))
    return rows.filter(F.size("items") >= length)


#: Attributes packed into a sequence chunk.
PACKED = ("item_id", "ts", "action", "rating", "genres", "release_year")
#: Actions of readers that the behaviour sequence holds.
BEHAVIOURS = ("search", "result_view", "detail_view", "click")


def _blank(c: str) -> Column:
    return F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))


def behaviour_gate(events: DataFrame) -> Gate:
    """Behavioural events with what their action needs; other events aren't counted as rejected."""
    kind = F.col("event_type")
    rows = with_columns(events, {c: "string" for c in ("query_id", "query_text", "result_set_id", "item_id")}).filter(kind.isin(*BEHAVIOURS))
    return Gate(rows, [
        ("null_user_id", F.col("user_id").isNotNull()),
        ("null_event_id", F.col("event_id").isNotNull()),
        ("null_timestamp", F.col("timestamp_ms").isNotNull()),
        ("missing_search_query", (kind != "search") | (F.col("query_id").isNotNull() & ~_blank("query_text"))),
        ("missing_result_identity", (kind != "result_view") | (F.col("query_id").isNotNull() & F.col("result_set_id").isNotNull())),
        ("missing_behavior_item", (kind == "search") | ~_blank("item_id")),
    ])


def _sequence(events: DataFrame, kind: str, item: Column) -> DataFrame:
    return events.filter(F.col("user_id").isNotNull() & F.col("timestamp_ms").isNotNull()).select(
        "user_id", F.lit(kind).alias("kind"), item.alias("item_id"), F.col("timestamp_ms").cast("long").alias("ts"), F.col("event_type").alias("action"),
        F.lit(None).cast("double").alias("rating"), F.lit(None).cast("array<string>").alias("genres"), F.lit(None).cast("int").alias("release_year"),
    )


def behaviour_sequence(events: DataFrame) -> DataFrame:
    """Every behavioural event as a row of the sequence store; a search has an empty item."""
    return _sequence(events, "behavior", F.coalesce("item_id", F.lit("")))


def click_sequence(events: DataFrame) -> DataFrame:
    """Clicks on an item alone."""
    return _sequence(events.filter((F.col("event_type") == "click") & F.col("item_id").isNotNull()), "click", F.col("item_id"))


def rating_sequence(events: DataFrame) -> DataFrame:
    """Ratings as rows of the sequence store; their timestamps are seconds."""
    rows = with_columns(events, {"genres": "array<string>", "release_year": "int"}).filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("timestamp").isNotNull())
    return rows.select("user_id", F.lit("rating").alias("kind"), "item_id", (F.col("timestamp") * 1000).cast("long").alias("ts"), F.lit("rating").alias("action"), F.col("rating").cast("double").alias("rating"), "genres", "release_year")


def identifier_gate(rows: DataFrame) -> Gate:
    """Rows whose identifiers hold no separator of the packing: without it two entities would become one."""
    return Gate(rows, [("separator_in_identifier", ~F.coalesce(F.col("user_id").rlike("[,|]") | F.col("item_id").rlike("[,|]"), F.lit(False)))])


def to_chunks(rows: DataFrame, separator: str = ",") -> DataFrame:
    """One row per (user, kind, UTC day): each attribute as one string, by time; nulls are empty strings.

    Genres are joined by |. Separators are cut from values; rows with one in an
    identifier are left out (identifier_gate counts them).
    """
    rows = identifier_gate(with_columns(rows, {"genres": "array<string>", "release_year": "int"})).kept
    plain = lambda c: F.regexp_replace(c, r"[,|]", "")
    clean = {c: plain(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in PACKED if c != "genres"}
    clean["genres"] = F.coalesce(F.array_join(F.transform("genres", plain), "|"), F.lit(""))
    day = F.date_format(utc_date(F.floor(F.col("ts") / 1000)), "yyyyMMdd")
    packed = rows.select("user_id", "kind", day.alias("bucket"), F.struct(F.col("ts").alias("at"), *[clean[c].alias(c) for c in PACKED]).alias("r"))
    out = packed.groupBy("user_id", "kind", "bucket").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    join = lambda c: F.array_join(F.transform("rs", lambda r: r[c]), separator).alias(c)
    return out.select("user_id", "kind", "bucket", *[join(c) for c in PACKED], F.size("rs").cast("long").alias("n"))


def explode_chunks(chunks: DataFrame, separator: str = ",") -> DataFrame:
    """The rows of packed chunks. A ragged chunk gives as many rows as its shortest column; n = 0 gives none."""
    lists = chunks.select("user_id", "kind", "bucket", "n", *[F.split(c, separator, -1).alias(c) for c in PACKED])
    size = F.least(*[F.size(c) for c in PACKED], F.col("n").cast("int"))
    at = F.explode(F.when(size > 0, F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1)))
    rows = lists.withColumn("i", at)
    return rows.select("user_id", "kind", "bucket", "i", *[F.get(c, F.col("i")).alias(c) for c in PACKED])


def merge_chunks(old: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """Chunks of the same key appended, the newest `most` rows kept."""
    rows = explode_chunks(old).withColumn("side", F.lit(0)).unionByName(explode_chunks(new).withColumn("side", F.lit(1)))
    rs = rows.groupBy("user_id", "kind", "bucket").agg(F.sort_array(F.collect_list(F.struct("side", "i", *PACKED))).alias("rs"))
    kept = rs.withColumn("rs", F.slice("rs", F.greatest(F.size("rs") - most + 1, F.lit(1)), F.lit(most)))
    return kept.select("user_id", "kind", "bucket", *[F.array_join(F.expr(f"transform(rs, r -> r.{c})"), ",").alias(c) for c in PACKED], F.size("rs").cast("long").alias("n"))


# What counts as advertising, and the countries that are told apart.
ADS = ("ad", "ads", "sponsored")
COUNTRIES = ("US", "CA", "GB", "AU", "DE", "FR", "JP", "IN", "BR")


def bucket(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value in lower case if it is listed, else other; unknown where it is blank."""
    clean = F.lower(F.trim(value))
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").when(clean.isin(*[a.lower() for a in allowed]), clean).otherwise("other")


def response_metrics(slates: DataFrame, subscriptions: tuple[str, ...], countries: tuple[str, ...] = COUNTRIES, enough_ads: int = 5, enough_items: int = 20) -> DataFrame:
    """(type, stage, subscription, country, blender, value): what each response held, tags that don't apply null.

    slates: items array<struct<item_features map, feedback_delay_ms, ...>>,
    user_features and context_features maps, and kafka_ingest_lag_ms if it is known.
    Zeros are left out, but for delays; negative delays are left out. One pass, nothing is shuffled.
    """
    user, context = F.col("user_features"), F.col("context_features")
    lag = F.col("kafka_ingest_lag_ms") if "kafka_ingest_lag_ms" in slates.columns else F.lit(None)
    kind = lambda i: F.lower(F.coalesce(i["item_features"]["type"], i["item_features"]["product_type"], F.lit("")))
    shown = F.coalesce(F.size(F.when(F.col("items").isNotNull(), F.col("items"))), F.lit(0))
    ads = F.coalesce(F.size(F.filter("items", lambda i: kind(i).isin(*ADS))), F.lit(0))
    delays = F.coalesce(F.filter(F.transform("items", lambda i: i["feedback_delay_ms"].cast("long")), lambda x: x >= 0), F.array().cast("array<bigint>"))
    rows = slates.select(
        bucket(F.coalesce(user["subscription_level"], user["subscription"], F.lit("none")), subscriptions).alias("sub"),
        bucket(F.coalesce(context["country_code"], user["country_code"], user["country"]), countries).alias("land"),
        F.nullif(F.trim(F.coalesce(context["AdsBlenderType"], context["ads_blender_type"], F.lit("default"))), F.lit("")).alias("mixer"),
        ads.cast("long").alias("ads"), (shown - ads).cast("long").alias("rest"), delays.alias("delays"), lag.cast("long").alias("lag"),
    )
    none = F.lit(None).cast("string")

    def one(name: str, value: Column, stage: Column = none, country: Column = none, blender: Column = none) -> Column:
        return F.struct(F.lit(name).alias("type"), stage.alias("stage"), F.col("sub").alias("subscription"), country.alias("country"), blender.alias("blender"), value.cast("long").alias("value"))

    land, mixer, response = F.col("land"), F.col("mixer"), F.lit("response")
    fixed = [one("total", F.lit(1)), one("total", F.lit(1), country=land), one("items", F.col("rest"), blender=mixer), one("ads", F.col("ads"), blender=mixer)]
    for name, holds in (("empty_ads", F.col("ads") == 0), ("empty_items", F.col("rest") == 0), ("sufficient_ads", F.col("ads") >= enough_ads), ("sufficient_items", F.col("rest") >= enough_items)):
        fixed.append(one(name, holds.cast("long"), stage=response, blender=mixer))
    late = F.transform("delays", lambda x: one("feedback_delay_ms", x, country=land))
    queue = F.filter(F.array(one("kafka_ingest_lag_ms", F.col("lag"), country=land)), lambda m: m["value"] >= 0)
    return rows.select(F.inline(F.concat(F.filter(F.array(*fixed), lambda m: m["value"] > 0), late, queue)))
