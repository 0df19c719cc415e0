"""Behaviour profiles of users, with explainable scores and personas."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.columns import Gate
from rivulet.operators.samples import with_columns

_DAY = 86_400
PREFERENCE = "array<struct<value:string,score:double,evidence_count:bigint>>"
PERSONA = "struct<type:string,label:string,confidence:double,evidence:map<string,double>>"


@dataclass(frozen=True)
class ProfileConfig:
    """Times are in seconds; reference is the epoch second that profiles are made for."""

    reference: int
    half_life: float = 7.0 * _DAY
    impression: float = -0.1
    click: float = 1.0
    order: float = 3.0
    rating_low: float = 1.0
    rating_middle: float = 3.0
    rating_high: float = 5.0
    shrinkage: float = 5.0
    least_evidence: int = 5
    most_genres: int = 10
    most_tags: int = 20
    enthusiast: float = 0.6
    explorer_diversity: float = 0.6
    explorer_concentration: float = 0.5
    focused: float = 0.7
    recent_release: float = 0.6
    intent_engagement: float = 0.4
    intent_conversion: float = 0.1
    casual_engagement: float = 0.1
    casual_conversion: float = 0.02
    lookback: int = 30 * _DAY
    release_age: int = 365 * _DAY

    def __post_init__(self) -> None:
        if self.half_life <= 0 or self.lookback <= 0 or self.release_age <= 0 or self.shrinkage < 0 or self.least_evidence < 0 or min(self.most_genres, self.most_tags) < 1:
            raise ValueError("a setting has a sign it can't have")
        if not self.rating_low < self.rating_middle < self.rating_high:
            raise ValueError("ratings must rise from low over middle to high")


def terms(values: Column) -> Column:
    """Different values, trimmed and in lower case, ascending, without blanks."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda v: F.length(v) > 0)))


def prepared(samples: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Samples with every column that profiles read: trimmed keys, flags as booleans, terms, recent_release and dedupe_id.

    An item is a recent release by its published_at; where that is null, by
    new_release. dedupe_id is the sample's id, or a digest of what it says.
    """
    kinds = {
        "sample_id": "string", "request_id": "string", "user_id": "string", "item_id": "string", "impression_ts": "bigint", "clicked": "boolean", "ordered": "boolean",
        "rating": "double", "new_release": "boolean", "published_at": "bigint", "genres": "array<string>", "tags": "array<string>",
    }
    rows = with_columns(samples, kinds)
    rows = rows.withColumns({c: F.trim(F.col(c).cast("string")) for c in ("sample_id", "request_id", "user_id", "item_id")})
    rows = rows.withColumns({c: F.col(c).cast(kinds[c]) for c in ("impression_ts", "rating", "new_release", "published_at")})
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("clicked", "ordered")} | {c: terms(F.col(c)) for c in ("genres", "tags")})
    recent = F.when(F.col("published_at").isNotNull(), F.col("published_at") >= cfg.reference - cfg.release_age).otherwise(F.coalesce("new_release", F.lit(False)))
    said = F.to_json(F.struct("user_id", "request_id", "item_id", "impression_ts", "clicked", "ordered", "rating"), {"ignoreNullFields": "false"})
    return rows.withColumn("recent_release", recent).withColumn("dedupe_id", F.when(F.length("sample_id") > 0, F.col("sample_id")).otherwise(F.sha2(said, 256)))


def profile_gate(samples: DataFrame, cfg: ProfileConfig) -> Gate:
    """Prepared samples; the reasons are counted by Gate.counts."""
    ts, rating = F.col("impression_ts"), F.col("rating")
    return Gate(prepared(samples, cfg), [
        ("missing_user", F.length("user_id") > 0),
        ("invalid_timestamp", ts.isNotNull()),
        ("invalid_behavior", rating.isNull() | rating.between(cfg.rating_low, cfg.rating_high)),
        ("outside_source_window", (ts >= cfg.reference - cfg.lookback) & (ts < cfg.reference + 1)),
    ])


def valid(samples: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """What passes the gate, one row per dedupe_id."""
    return profile_gate(samples, cfg).kept.dropDuplicates(["dedupe_id"])


def event_weight(cfg: ProfileConfig) -> Column:
    """One outcome an event: its rating's distance from the middle, else order, click or impression; halved every half-life."""
    r = F.col("rating")
    rated = F.when(r >= cfg.rating_middle, (r - cfg.rating_middle) / (cfg.rating_high - cfg.rating_middle)).otherwise((r - cfg.rating_middle) / (cfg.rating_middle - cfg.rating_low))
    base = F.when(r.isNotNull(), rated).when(F.col("ordered"), cfg.order).when(F.col("clicked"), cfg.click).otherwise(cfg.impression)
    age = F.greatest(F.lit(0), F.lit(cfg.reference) - F.col("impression_ts"))
    return base * F.pow(F.lit(0.5), age.cast("double") / float(cfg.half_life))


def activity(rows: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Counts, rates and activity level of each user; low under least_evidence events, medium under four times that."""
    n = F.count("*")
    total = lambda c: F.sum(F.col(c).cast("long"))
    level = F.when(n < cfg.least_evidence, "low").when(n < 4 * cfg.least_evidence, "medium").otherwise("high")
    return rows.groupBy("user_id").agg(
        n.alias("evidence_count"), n.alias("impressions"), total("clicked").alias("clicks"), total("ordered").alias("orders"), F.avg("rating").alias("average_rating"),
        (total("clicked").cast("double") / n).alias("engagement_rate"), (total("ordered").cast("double") / n).alias("conversion_rate"), level.alias("activity_level"),
    )


def preferences(rows: DataFrame, cfg: ProfileConfig, column: str = "genres") -> DataFrame:
    """(user_id, value, weight, evidence_count, score): score = the weight over (evidence + shrinkage), kept within -1 and 1."""
    each = rows.select("user_id", event_weight(cfg).alias("w"), F.explode(column).alias("value"))
    out = each.groupBy("user_id", "value").agg(F.sum("w").alias("weight"), F.count("*").alias("evidence_count"))
    share = F.col("weight") / (F.col("evidence_count").cast("double") + float(cfg.shrinkage))
    return out.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))


def top_preferences(table: DataFrame, most: int, name: str) -> DataFrame:
    """(user_id, name): the `most` best preferences, by score, then by value."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "value")
    best = table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    listed = best.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "score", "evidence_count"))).alias("p"))
    return listed.select("user_id", F.transform("p", lambda p: F.struct(p["value"].alias("value"), p["score"].alias("score"), p["evidence_count"].alias("evidence_count"))).alias(name))


def shape(rows: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Diversity of genres (1 less the sum of squared shares) and the largest share, over events of positive weight."""
    each = rows.select("user_id", event_weight(cfg).alias("w"), "genres").filter("w > 0").select("user_id", "w", F.explode("genres").alias("genre"))
    positive = each.groupBy("user_id", "genre").agg(F.sum("w").alias("w"))
    share = positive.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("user_id")))
    return share.groupBy("user_id").agg((1 - F.sum(F.col("share") * F.col("share"))).alias("genre_diversity"), F.max("share").alias("preference_concentration"))


def recency(rows: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """The share of the positive weight that recent releases have."""
    each = rows.select("user_id", event_weight(cfg).alias("w"), "recent_release").filter("w > 0")
    return each.groupBy("user_id").agg((F.sum(F.when(F.col("recent_release"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("recent_release_affinity"))


#: What sums of the same numbers in another order may differ by, near 1.
_SAME = 1e-12


def _above(value: Column, least: float) -> Column:
    """How far a value is from its threshold towards 1."""
    if least >= 1:
        return F.when(value >= least - _SAME, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - least) / (1.0 - least)))


def _below(value: Column, most: float) -> Column:
    if most <= 0:
        return F.when(value <= most + _SAME, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(most) - value) / most))


def _title(value: Column) -> Column:
    words = F.filter(F.split(value, "[-_ ]+"), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def personas(cfg: ProfileConfig) -> Column:
    """The personas that fit a row of features, in a fixed order, each with confidence and evidence.

    Under least_evidence events: new_or_unknown alone. Reads evidence_count,
    impressions, clicks, orders, genre_preferences, engagement_rate,
    conversion_rate, genre_diversity, preference_concentration and
    recent_release_affinity; what is null fits nothing. A value within 1e-12 of a
    threshold is at it: sums of weights end in digits that depend on their order.
    """
    c = {n: F.col(n).cast("double") for n in ("evidence_count", "impressions", "clicks", "orders", "engagement_rate", "conversion_rate", "genre_diversity", "preference_concentration", "recent_release_affinity")}
    evidence = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    best = F.get(F.array_sort(F.transform(F.filter("genre_preferences", lambda p: p["score"] > 0), lambda p: F.struct((-p["score"]).alias("order"), p["value"].alias("value"), p["evidence_count"].cast("double").alias("n")))), F.lit(0))
    score = -best["order"]
    engaged, converted, diverse, focus, recent = c["engagement_rate"], c["conversion_rate"], c["genre_diversity"], c["preference_concentration"], c["recent_release_affinity"]
    least = lambda value, x: value >= x - _SAME
    most = lambda value, x: value <= x + _SAME
    tests = [
        ("genre_enthusiast", F.concat(_title(best["value"]), F.lit(" enthusiast")), least(score, cfg.enthusiast), _above(score, cfg.enthusiast), evidence(preference_score=score, evidence_count=best["n"])),
        (
            "genre_explorer", F.lit("Genre explorer"), least(diverse, cfg.explorer_diversity) & most(focus, cfg.explorer_concentration),
            F.least(_above(diverse, cfg.explorer_diversity), _below(focus, cfg.explorer_concentration)), evidence(genre_diversity=diverse, preference_concentration=focus),
        ),
        ("focused_viewer", F.lit("Focused viewer"), least(focus, cfg.focused), _above(focus, cfg.focused), evidence(preference_concentration=focus)),
        ("recent_release_seeker", F.lit("Recent release seeker"), least(recent, cfg.recent_release), _above(recent, cfg.recent_release), evidence(recent_release_affinity=recent)),
        (
            "high_intent_engager", F.lit("High-intent engager"), least(engaged, cfg.intent_engagement) & least(converted, cfg.intent_conversion),
            F.least(_above(engaged, cfg.intent_engagement), _above(converted, cfg.intent_conversion)),
            evidence(engagement_rate=engaged, conversion_rate=converted, clicks=c["clicks"], orders=c["orders"]),
        ),
        (
            "casual_browser", F.lit("Casual browser"), (c["impressions"] >= cfg.least_evidence) & most(engaged, cfg.casual_engagement) & most(converted, cfg.casual_conversion),
            F.least(_below(engaged, cfg.casual_engagement), _below(converted, cfg.casual_conversion)),
            evidence(impressions=c["impressions"], engagement_rate=engaged, conversion_rate=converted),
        ),
    ]
    one = lambda kind, label, sure, why: F.struct(F.lit(kind).alias("type"), label.alias("label"), sure.cast("double").alias("confidence"), why.alias("evidence")).cast(PERSONA)
    fits = F.filter(F.array(*[F.when(F.coalesce(holds, F.lit(False)), one(kind, label, sure, why)) for kind, label, holds, sure, why in tests]), lambda p: p.isNotNull())
    unknown = F.array(one("new_or_unknown", F.lit("New or unknown"), F.lit(1.0), evidence(evidence_count=c["evidence_count"], minimum_evidence=F.lit(float(cfg.least_evidence)))))
    return F.when(c["evidence_count"] < cfg.least_evidence, unknown).otherwise(fits)


def build_profiles(samples: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """One row a user: counts, rates, preferences by genre and tag, shape, affinity and personas.

    All parts are aggregates by user, so they share one partitioning by user_id.
    """
    rows = valid(samples, cfg)
    parts = [
        top_preferences(preferences(rows, cfg, "genres"), cfg.most_genres, "genre_preferences"),
        top_preferences(preferences(rows, cfg, "tags"), cfg.most_tags, "tag_preferences"),
        shape(rows, cfg), recency(rows, cfg),
    ]
    out = reduce(lambda df, part: df.join(part, "user_id", "left"), parts, activity(rows, cfg))
    out = out.withColumns({c: F.coalesce(c, F.array().cast(PREFERENCE)) for c in ("genre_preferences", "tag_preferences")})
    return out.withColumn("personas", personas(cfg))


#: Version of the profile document.
PROFILE_VERSION = 1


def with_document(profiles: DataFrame, cfg: ProfileConfig, run_id: str, generated_at: str) -> DataFrame:
    """profiles with what says where they come from, and profile_json, the document that is served (nulls included)."""
    iso = lambda t: F.lit(datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    rows = profiles.withColumns({
        "profile_version": F.lit(PROFILE_VERSION), "run_id": F.lit(run_id), "generated_at": F.lit(generated_at),
        "source_window": F.struct(iso(cfg.reference - cfg.lookback).alias("start"), iso(cfg.reference + 1).alias("end")),
        "preferences": F.struct(F.col("genre_preferences").alias("genres"), F.col("tag_preferences").alias("tags")),
        "behavioral_features": F.struct("engagement_rate", "conversion_rate", "genre_diversity", "preference_concentration", "recent_release_affinity", "average_rating", "activity_level"),
    })
    document = F.struct("user_id", "profile_version", "run_id", "generated_at", "source_window", "evidence_count", "preferences", "behavioral_features", "personas")
    return rows.withColumn("profile_json", F.to_json(document, {"ignoreNullFields": "false"}))

