"""Queries of the reports and measurements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import derive
from rivulet.operators import evaluation, governance, measures, reports, samples
from rivulet.plans.adapters import EVENTS, SAMPLES, STAR, events, star, table
from rivulet.plans.catalogue import _r, _samples, query
from rivulet.sources import files

_GENRES = ("Drama", "Action", "Polka", "Comedy", "Sci-Fi", "Documentary")
_COLUMNS = "request_id session_id user_id item_id clicked ordered label year device segment"


def _films(spark, d):
    """Line items as samples of films: genres, year and device made from the part's key."""
    rows = star(spark, d, _COLUMNS).withColumn("k", F.col("item_id").cast("int"))
    name = lambda i: F.element_at(F.array(*[F.lit(g) for g in _GENRES]), i + 1)
    genres = F.when(F.col("k") % 5 == 0, F.array(name(F.col("k") % 6))).when(F.col("k") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(name(F.col("k") % 6), name(F.col("k") % 4)))
    return rows.withColumns({"genres": genres, "release_year": F.when(F.col("k") % 7 > 0, F.col("year"))})


_FILMS = f"""{STAR}, fk AS (SELECT *, CAST(item_id AS INTEGER) AS k, {list(_GENRES)} AS names FROM st),
  fi AS (SELECT * EXCLUDE (genres), CASE WHEN k % 5 = 0 THEN [names[k % 6 + 1]] WHEN k % 11 = 0 THEN [] ELSE [names[k % 6 + 1], names[k % 4 + 1]] END AS genres, CASE WHEN k % 7 > 0 THEN year END AS release_year FROM fk),
  kw AS (SELECT *, coalesce(genres[1], 'unknown') AS keyword, coalesce(genres[2], 'none') AS subkeyword,
    CASE coalesce(genres[1], '') WHEN 'Drama' THEN 'Drama&Romance' WHEN 'Action' THEN 'Action&Adventure' WHEN 'Comedy' THEN 'Comedy' WHEN 'Sci-Fi' THEN 'SciFi&Fantasy' ELSE 'Other' END AS l1,
    coalesce(genres[1], 'unknown') AS l2, coalesce(genres[1], 'unknown') || '·' || coalesce(CAST(release_year // 10 * 10 AS VARCHAR) || 's', 'unknown') AS l3 FROM fi),
  ba AS (SELECT round(avg(CAST(clicked AS DOUBLE)), 4) AS base FROM st)"""


def _distribution(by: str) -> str:
    return f"WITH {_FILMS} SELECT {by}, count(*) AS movie_impressions, count(DISTINCT item_id) AS distinct_movies, CAST(sum(clicked) AS BIGINT) AS query_clicks FROM kw GROUP BY 1"


@query(_distribution("keyword"))
def keyword_distribution(spark, d):
    return reports.keyword_distribution(reports.with_keywords(_films(spark, d)), "keyword")


@query(_distribution("subkeyword"))
def subkeyword_distribution(spark, d):
    return reports.keyword_distribution(reports.with_keywords(_films(spark, d)), "subkeyword")


def _tops(level: str) -> str:
    return f"""SELECT '{level}' AS level, category, keyword, movie_impressions, query_clicks, CAST(rank AS INTEGER) AS rank FROM (
      SELECT {level} AS category, keyword, count(*) AS movie_impressions, CAST(sum(clicked) AS BIGINT) AS query_clicks, row_number() OVER (PARTITION BY {level} ORDER BY count(*) DESC, keyword) AS rank
      FROM (SELECT {level}, unnest(genres) AS keyword, clicked FROM kw) GROUP BY 1, 2)"""


@query(f"WITH {_FILMS} SELECT * FROM ({_tops('l1')}) WHERE rank <= 10 UNION ALL SELECT * FROM ({_tops('l2')}) WHERE rank <= 10 UNION ALL SELECT * FROM ({_tops('l3')}) WHERE rank <= 10")
def top_keywords(spark, d):
    rows = reports.with_keywords(_films(spark, d))
    found = [reports.top_keywords(rows, c).withColumnRenamed(c, "category").select(F.lit(c).alias("level"), "*") for c in ("l1", "l2", "l3")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {_FILMS}, t AS ({_tops('l1')} UNION ALL {_tops('l2')} UNION ALL {_tops('l3')}), p AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY category, rank) AS place FROM t WHERE rank <= 10)
    SELECT * EXCLUDE (place) FROM p WHERE place <= 10""")
def dashboard_level_tops(spark, d):
    return reports.top_of_levels(reports.with_keywords(_films(spark, d)))


def _per(by: str, table_: str, per: str, name: str, digits: int) -> str:
    return f"""SELECT {by}, CAST(sum(n) AS BIGINT) AS impressions, CAST(sum(c) AS BIGINT) AS clicks, CAST(sum(o) AS BIGINT) AS orders, count(*) AS {per}, round(CAST(sum(c) AS DOUBLE) / sum(n), 4) AS ctr,
      round(CAST(sum(o) AS DOUBLE) / sum(n), 4) AS order_rate, round(CAST(sum(c) AS DOUBLE) / count(*), {digits}) AS {name}, round((round(CAST(sum(c) AS DOUBLE) / sum(n), 4) - any_value(base)) / any_value(base) * 100, 1) AS ctr_lift_pct
      FROM {table_}, ba GROUP BY 1"""


def _categories(level: str) -> str:
    return f"WITH {_FILMS}, i AS (SELECT item_id, {level}, count(*) AS n, sum(clicked) AS c, sum(ordered) AS o FROM kw WHERE k % 13 > 0 GROUP BY 1, 2) " + _per(level, "i", "items", "clicks_per_item", 2)


def _category_report(spark, d, level):
    rows = _films(spark, d)
    # items without features stay out
    features = reports.with_keywords(rows).filter("k % 13 > 0").select("item_id", level).distinct()
    return reports.category_metrics(rows, features, level)


@query(_categories("l1"))
def category_report_l1(spark, d):
    return _category_report(spark, d, "l1")


@query(_categories("l2"))
def category_report_l2(spark, d):
    return _category_report(spark, d, "l2")


@query(_categories("l3"))
def category_report_l3(spark, d):
    return _category_report(spark, d, "l3")


@query(f"WITH {_FILMS}, u AS (SELECT device, user_id, count(*) AS n, sum(clicked) AS c, sum(ordered) AS o FROM st GROUP BY 1, 2) " + _per("device", "u", "users", "clicks_per_user", 3))
def device_metrics(spark, d):
    return reports.device_metrics(star(spark, d, "device user_id clicked ordered"))


def _known(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    age = F.when(k % 17 == 0, "old").otherwise((15 + k % 60).cast("string"))
    return reports.demographics(c.select(
        k.cast("string").alias("user_id"), F.when(k % 2 == 0, "f").otherwise("m").alias("gender"), F.col("c_mktsegment").alias("occupation"), age.alias("age"), ((k * 7919) % 100_000).cast("string").alias("zip_code"),
        (1 + k % 4 + 0.5).alias("avg_rating"), (k % 3).alias("rating_count"),
    ))


_KNOWN = f"""{_FILMS}, dm AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender, c_mktsegment AS occupation,
    CASE WHEN c_custkey % 17 = 0 THEN 'unknown' WHEN 15 + c_custkey % 60 <= 24 THEN '18-24' WHEN 15 + c_custkey % 60 <= 34 THEN '25-34' WHEN 15 + c_custkey % 60 <= 44 THEN '35-44' WHEN 15 + c_custkey % 60 <= 54 THEN '45-54' ELSE '55+' END AS age_band,
    coalesce(CASE substr(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 1, 1) WHEN '0' THEN 'Northeast' WHEN '1' THEN 'Northeast' WHEN '2' THEN 'Mid-Atlantic' WHEN '3' THEN 'Southeast' WHEN '4' THEN 'Midwest' WHEN '5' THEN 'Midwest' WHEN '6' THEN 'South-Central'
      WHEN '7' THEN 'South-Central' WHEN '8' THEN 'Mountain' WHEN '9' THEN 'West' END, 'unknown') AS geo, 1 + c_custkey % 4 + 0.5::DOUBLE AS r, c_custkey % 3 AS m FROM customer),
  du AS (SELECT user_id, count(*) AS n, sum(clicked) AS c, sum(ordered) AS o FROM st GROUP BY 1), dj AS (SELECT * FROM du JOIN dm USING (user_id))"""


def _demographics(by: str) -> str:
    plain = _per(by, "dj", "users", "clicks_per_user", 3)
    return f"WITH {_KNOWN}, p AS ({plain}), a AS (SELECT {by}, CASE WHEN sum(m) > 0 THEN round(sum(r * m) / sum(m), 3) END AS avg_rating FROM dj GROUP BY 1) SELECT p.*, avg_rating FROM p JOIN a USING ({by})"


def _by_known(spark, d, by):
    return reports.demographic_metrics(star(spark, d, "user_id clicked ordered"), _known(spark, d), by)


@query(_demographics("age_band"))
def segment_age_band(spark, d):
    return _by_known(spark, d, "age_band")


@query(_demographics("gender"))
def segment_gender(spark, d):
    return _by_known(spark, d, "gender")


@query(_demographics("occupation"))
def segment_occupation(spark, d):
    return _by_known(spark, d, "occupation")


@query(_demographics("geo"))
def segment_geo(spark, d):
    return _by_known(spark, d, "geo")


@query("""SELECT c_custkey, coalesce(CASE substr(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 1, 1) WHEN '1' THEN 'Northeast' WHEN '2' THEN 'Mid-Atlantic' WHEN '3' THEN 'Southeast' WHEN '4' THEN 'Midwest' WHEN '5' THEN 'Midwest' WHEN '6' THEN 'South-Central'
    WHEN '7' THEN 'South-Central' WHEN '8' THEN 'Mountain' WHEN '9' THEN 'West' WHEN '0' THEN 'Northeast' END, 'unknown') AS region, CAST((c_custkey + 1900) // 10 * 10 AS VARCHAR) || 's' AS decade FROM customer""")
def derived_regions(spark, d):
    return table(spark, d, "customer").select("c_custkey", derive.zip_region(((F.col("c_custkey") * 7919) % 100_000).cast("string")).alias("region"), derive.decade((F.col("c_custkey") + 1900).cast("string")).alias("decade"))


_STATE = "CASE WHEN label >= 2 THEN 'ordered' WHEN label >= 1 THEN 'clicked' ELSE 'impression_only' END"
_SHARES = ", ".join(f"round(avg(CASE WHEN {_STATE} = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS {s}_share" for s in reports.STATES)


@query(f"WITH {_FILMS} SELECT {_STATE} AS relevance_state, min(label) AS score, count(*) AS impressions, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM st), 4) AS proportion FROM st GROUP BY 1")
def relevance_states(spark, d):
    return reports.state_distribution(star(spark, d, "label"))


@query(f"WITH {_FILMS} SELECT coalesce(nullif(array_to_string(genres, ' '), ''), 'unknown') AS query, count(*) AS impressions, round(avg(label), 4) AS mean_score, {_SHARES} FROM fi GROUP BY 1")
def relevance_by_query(spark, d):
    return reports.relevance_breakdown(_films(spark, d), "query")


@query(f"WITH {_FILMS} SELECT genre, count(*) AS impressions, round(avg(label), 4) AS mean_score, {_SHARES} FROM (SELECT unnest(genres) AS genre, label FROM fi) GROUP BY 1")
def relevance_genre_states(spark, d):
    return reports.relevance_breakdown(_films(spark, d), "genre")


@query(f"""WITH {STAR}, c AS (SELECT date, count(*) AS n FROM st GROUP BY 1 ORDER BY date DESC LIMIT 3) SELECT 'held' AS part, count(*) AS n FROM st WHERE date IN (SELECT date FROM c)
    UNION ALL SELECT 'train', count(*) FROM st WHERE date NOT IN (SELECT date FROM c) UNION ALL SELECT 'counted', CAST(sum(n) AS BIGINT) FROM c""")
def holdout_dates(spark, d):
    train, held, n = reports.split_by_date(star(spark, d, "date"), 3)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(train, "train").unionByName(count(held, "held")).unionByName(spark.range(1).select(F.lit("counted").alias("part"), F.lit(n).cast("long").alias("n")))


# --- governance

_NOW = 1_706_745_600
_AGED = f"""{SAMPLES}, ob AS (SELECT item_id, CAST(clicked AS DOUBLE) AS clicked, greatest(0.0::DOUBLE, (impression_ts - published_at) / 86400.0::DOUBLE) AS age FROM sm WHERE published_at IS NOT NULL),
  ct AS (SELECT age <= 30 AS fresh, item_id, sum(clicked) AS c, count(*) AS n FROM ob GROUP BY 1, 2), mm AS (SELECT fresh, sum(c) / sum(n) AS mean FROM ct GROUP BY 1),
  se AS (SELECT fresh, any_value(mean) AS mean, sqrt(sum(pow(c - mean * n, 2)) / pow(sum(n), 2) * count(*) / (count(*) - 1)) AS se FROM ct JOIN mm USING (fresh) GROUP BY 1 HAVING count(*) > 1),
  ab AS (SELECT CASE WHEN age <= 7 THEN '0-7 d' WHEN age <= 30 THEN '8-30 d' WHEN age <= 90 THEN '31-90 d' WHEN age <= 365 THEN '91-365 d' ELSE '> 1 y' END AS band, * FROM ob)"""


@query(
    f"""WITH {_AGED}, g AS (SELECT count(*) AS n, count(*) FILTER (WHERE age <= 30) AS f, avg(age) AS mean_age, quantile_cont(age, 0.5) AS median_age, avg(clicked) FILTER (WHERE age <= 30) AS fc, avg(clicked) FILTER (WHERE age > 30) AS ec FROM ob),
    i AS (SELECT avg(CAST(f AS DOUBLE)) AS share FROM (SELECT max(CAST(age <= 30 AS INTEGER)) AS f FROM ob GROUP BY item_id)), a AS (SELECT * FROM se WHERE fresh), b AS (SELECT * FROM se WHERE NOT fresh)
    SELECT 'published_at' AS freshness_source, round(CAST(f AS DOUBLE) / n, 9) AS fresh_share, round(CAST(n AS DOUBLE) / (SELECT count(*) FROM sm), 9) AS freshness_coverage, 1.0::DOUBLE AS age_at_exposure_coverage,
      round(mean_age, 6) AS mean_content_age_days, round(median_age, 6) AS median_content_age_days, round(fc, 9) AS fresh_ctr, round(ec, 9) AS established_ctr, round(a.mean - b.mean, 9) AS fresh_ctr_diff,
      round(sqrt(a.se * a.se + b.se * b.se), 9) AS fresh_ctr_diff_se, round(share, 9) AS fresh_item_share, round(CAST(f AS DOUBLE) / n / share, 9) AS fresh_exposure_lift FROM g, i, a, b"""
)
def freshness(spark, d):
    out = governance.freshness(_samples(spark, d), _NOW).drop("status", "fresh_ctr_diff_z")
    return out.select(*[(_r(c, 6 if c.endswith("days") else 9) if t == "double" else F.col(c)).alias(c) for c, t in out.dtypes])


@query(
    f"""WITH {_AGED}, p AS (SELECT avg(clicked) AS p0, count(*) AS a, count(DISTINCT item_id) AS items FROM ob), c AS (SELECT band, item_id, sum(clicked) AS c, count(*) AS n FROM ab GROUP BY 1, 2),
    z AS (SELECT band, CAST(sum(n) AS BIGINT) AS n, count(*) AS m, sum(c) / sum(n) AS ctr, sqrt(sum(pow(c - p0 * n, 2)) / pow(sum(n), 2) * count(*) / nullif(count(*) - 1, 0)) AS se FROM c, p GROUP BY 1)
    SELECT v.band, coalesce(n, 0) AS exposures, round(coalesce(n, 0) / CAST(a AS DOUBLE), 9) AS exposure_share, coalesce(m, 0) AS items, round(coalesce(m, 0) / CAST(items AS DOUBLE), 9) AS item_share, round(ctr, 9) AS ctr,
      CASE WHEN se > 0 THEN round((ctr - p0) / se, 6) END AS z FROM (VALUES ('0-7 d'), ('8-30 d'), ('31-90 d'), ('91-365 d'), ('> 1 y')) v(band) LEFT JOIN z USING (band), p"""
)
def freshness_bands(spark, d):
    out = governance.age_bands(_samples(spark, d), _NOW)
    return out.withColumns({"exposure_share": _r("exposure_share", 9), "item_share": _r("item_share", 9), "ctr": _r("ctr", 9), "z": _r("z")})


@query(
    f"""WITH {SAMPLES}, r AS (SELECT CASE WHEN filter_reason IN ('expired', 'muted_product_type', 'muted_genre', 'muted_keyword', 'muted_title') THEN filter_reason WHEN filter_reason IS NOT NULL THEN 'unknown' END AS reason, unsafe_label FROM sm)
    SELECT 'catalog-filter-v1' AS policy_version, count(*) AS evaluated_candidates, count(reason) AS filter_decisions, CAST(count(reason) AS DOUBLE) / count(*) AS filter_decision_rate,
      count(*) FILTER (WHERE reason = 'expired') AS expired, count(*) FILTER (WHERE reason = 'muted_genre') AS muted_genre, count(*) FILTER (WHERE reason = 'muted_title') AS muted_title, count(*) FILTER (WHERE reason = 'unknown') AS unknown,
      CAST(count(*) FILTER (WHERE reason = 'unknown') AS DOUBLE) / count(*) AS unknown_share, CAST(count(*) FILTER (WHERE unsafe_label) AS DOUBLE) / count(unsafe_label) AS unsafe_exposure_rate,
      CAST(count(unsafe_label) AS DOUBLE) / count(*) AS unsafe_label_coverage FROM r"""
)
def safety_reasons(spark, d):
    return governance.safety(_samples(spark, d)).drop("status", "muted_product_type", "muted_keyword")


@query(
    f"""WITH {STAR}, m AS (SELECT unnest([{{'d': 'geo', 'g': geo}}, {{'d': 'device', 'g': device}}, {{'d': 'occupation', 'g': segment}}]) AS x, clicked, ordered, label FROM st),
    g AS (SELECT x.d AS dimension, coalesce(nullif(trim(x.g), ''), 'unknown') AS "group", count(*) AS support, avg(CAST(clicked AS DOUBLE)) AS ctr, avg(CAST(ordered AS DOUBLE)) AS order_rate, avg(label) AS mean_reward FROM m GROUP BY 1, 2),
    s AS (SELECT dimension, count(*) FILTER (WHERE support < 1200) AS suppressed_group_count, CAST(coalesce(sum(support) FILTER (WHERE support < 1200), 0) AS BIGINT) AS suppressed_candidate_count FROM g GROUP BY 1),
    w AS (SELECT count(*) AS n, avg(CAST(clicked AS DOUBLE)) AS c FROM st)
    SELECT dimension, "group", support, round(CAST(support AS DOUBLE) / n, 9) AS exposure_share, round(ctr, 9) AS ctr, round(order_rate, 9) AS order_rate, round(mean_reward, 9) AS mean_reward, round(abs(ctr - c), 9) AS ctr_absolute_gap_from_overall,
      CASE WHEN count(*) OVER v > 1 THEN round(max(ctr) OVER v - min(ctr) OVER v, 9) END AS ctr_max_min_gap, CASE WHEN count(*) OVER v > 1 THEN round(min(ctr) OVER v / max(ctr) OVER v, 9) END AS ctr_disparity_ratio,
      suppressed_group_count, suppressed_candidate_count FROM g JOIN s USING (dimension), w WHERE support >= 1200 WINDOW v AS (PARTITION BY dimension)"""
)
def fairness_groups(spark, d):
    rows = star(spark, d, "geo device segment clicked ordered label").withColumnsRenamed({"segment": "occupation", "label": "reward"})
    out = governance.fairness(rows, least=1200)
    kept = ["exposure_share", "ctr", "order_rate", "mean_reward", "ctr_absolute_gap_from_overall", "ctr_max_min_gap", "ctr_disparity_ratio"]
    return out.select("dimension", "group", "support", *[_r(c, 9).alias(c) for c in kept], "suppressed_group_count", "suppressed_candidate_count")


@query(
    f"""WITH {STAR}, i AS (SELECT item_id, count(*) AS c FROM st GROUP BY 1), z AS (SELECT c FROM i UNION ALL SELECT 0 FROM range(greatest(0, (SELECT 2 * count(*) FROM part) - (SELECT count(*) FROM i)))),
    o AS (SELECT c, row_number() OVER (ORDER BY c) AS r, count(*) OVER () AS m FROM z), u AS (SELECT user_id, count(DISTINCT item_id) AS d, count(*) AS s FROM st GROUP BY 1)
    SELECT (SELECT count(*) FROM i) AS items_served, round(CAST((SELECT count(*) FROM i) AS DOUBLE) / (SELECT 2 * count(*) FROM part), 9) AS catalog_coverage, round(CAST(sum((2 * r - m - 1) * c) AS DOUBLE) / (any_value(m) * CAST(sum(c) AS DOUBLE)), 9) AS exposure_gini,
      round(CAST(sum(c) FILTER (WHERE r > m - m // 10) AS DOUBLE) / sum(c), 9) AS top_decile_exposure_share, (SELECT quantile_cont(d, 0.5) FROM u) AS median_items_per_user, (SELECT round(1 - CAST(sum(d) AS DOUBLE) / sum(s), 9) FROM u) AS user_repeat_rate,
      (SELECT round(1 - sum(n * (1 - pow(1 - 1 / n, s))) / sum(s), 9) FROM u, (SELECT 2.0::DOUBLE * count(*) AS n FROM part)) AS user_repeat_rate_uniform FROM o"""
)
def exposure_spread(spark, d):
    size = 2 * table(spark, d, "part").count()
    out = governance.spread(star(spark, d, "user_id item_id"), size)
    return out.select(*[(_r(c, 9) if c not in ("items_served", "median_items_per_user") else F.col(c)).alias(c) for c in out.columns])


# --- gates and sequences


@query(
    f"""WITH {EVENTS}, b AS (SELECT event_id, CASE event_type WHEN 'impression' THEN 'result_view' WHEN 'order' THEN 'detail_view' WHEN 'signup' THEN 'search' WHEN 'click' THEN 'click' END AS event_type, nullif(item_id, 'item_3') AS item_id,
      CASE WHEN k % 3 > 0 THEN 'q' END AS query_id, CASE WHEN k % 4 > 0 THEN ' ' || k ELSE ' ' END AS query_text, CASE WHEN k % 5 > 0 THEN 's' END AS result_set_id FROM ev),
    g AS (SELECT CASE WHEN event_type = 'search' AND (query_id IS NULL OR trim(query_text) = '') THEN 'missing_search_query' WHEN event_type = 'result_view' AND (query_id IS NULL OR result_set_id IS NULL) THEN 'missing_result_identity'
      WHEN event_type <> 'search' AND item_id IS NULL THEN 'missing_behavior_item' ELSE 'kept' END AS reason FROM b WHERE event_type IS NOT NULL)
    SELECT r.reason, count(g.reason) AS n FROM (VALUES ('kept'), ('null_user_id'), ('null_event_id'), ('null_timestamp'), ('missing_search_query'), ('missing_result_identity'), ('missing_behavior_item')) r(reason) LEFT JOIN g USING (reason) GROUP BY 1"""
)
def behaviour_gate(spark, d):
    return samples.behaviour_gate(_behaviour(spark, d)).counts()


def _behaviour(spark, d):
    """Events as searches, views and clicks of readers; some of them incomplete."""
    k = F.col("k")
    kind = F.expr("CASE event_type WHEN 'impression' THEN 'result_view' WHEN 'order' THEN 'detail_view' WHEN 'signup' THEN 'search' WHEN 'click' THEN 'click' ELSE event_type END")
    return events(spark, d).withColumns({
        "event_type": kind, "item_id": F.nullif("item_id", F.lit("item_3")), "query_id": F.when(k % 3 > 0, "q"),
        "query_text": F.when(k % 4 > 0, F.concat(F.lit(" "), k)).otherwise(" "), "result_set_id": F.when(k % 5 > 0, "s"),
    })


@query(
    f"""WITH {EVENTS}, b AS (SELECT user_id, timestamp_ms, CASE event_type WHEN 'impression' THEN 'result_view' WHEN 'order' THEN 'detail_view' WHEN 'signup' THEN 'search' WHEN 'click' THEN 'click' END AS event_type, nullif(item_id, 'item_3') AS item_id, k FROM ev),
    v AS (SELECT * FROM b WHERE event_type IS NOT NULL AND NOT (event_type = 'search' AND (k % 3 = 0 OR k % 4 = 0)) AND NOT (event_type = 'result_view' AND (k % 3 = 0 OR k % 5 = 0)) AND NOT (event_type <> 'search' AND item_id IS NULL))
    SELECT user_id, 'behavior' AS kind, coalesce(item_id, '') AS item_id, timestamp_ms AS ts, event_type AS action FROM v UNION ALL SELECT user_id, 'click', item_id, timestamp_ms, event_type FROM v WHERE event_type = 'click' AND item_id IS NOT NULL"""
)
def behaviour_sequences(spark, d):
    kept = samples.behaviour_gate(_behaviour(spark, d)).kept
    return samples.behaviour_sequence(kept).unionByName(samples.click_sequence(kept)).select("user_id", "kind", "item_id", "ts", "action")


@query(
    """WITH i AS (SELECT p_partkey AS item_id, p_brand, p_name FROM part), s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN ['own'] ELSE [] END AS genres FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN len(s.genres) > 0 THEN 'own' ELSE array_to_string(string_split(lower(p_name), ' '), '|') END AS genres, p_brand AS release_year FROM s LEFT JOIN i ON item_id = l_partkey"""
)
def catalog_fill(spark, d):
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.split(F.lower("p_name"), " ").alias("genres"), F.col("p_brand").alias("release_year"))
    own = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), own.alias("genres"))
    return reports.filled_from_catalog(rows, catalog).select("l_orderkey", "l_linenumber", F.array_join("genres", "|").alias("genres"), "release_year")


# --- evaluation

_WEIGHTS = (0.5, -0.25, 0.125)


@query(
    f"""WITH {STAR}, f AS (SELECT request_id, label, CASE WHEN tie % 9 > 0 THEN price END AS p, CASE WHEN tie % 7 > 0 THEN score * 0.5 - position * 0.25 + tie * 0.125 END AS s, tie % 11 = 0 AS odd, CASE WHEN tie % 13 = 0 THEN -1.0 ELSE label END AS y FROM st),
    t AS (SELECT *, s IS NOT NULL AND NOT odd AND p IS NOT NULL AND y >= 0 AS fits FROM f WHERE list_sum(list_transform(string_split(md5(request_id), ''), lambda x: strpos('0123456789abcdef', x) - 1)) % 5 = 0),
    g AS (SELECT request_id, s, p, y FROM t WHERE fits), a AS (SELECT a.s AS s1, b.s AS s0, a.p AS p1, b.p AS p0 FROM g a JOIN g b USING (request_id) WHERE a.y > 0 AND b.y = 0),
    c AS (SELECT count(*) AS slates, count(*) FILTER (WHERE pos > 0 AND neg > 0) AS usable FROM (SELECT request_id, count(*) FILTER (WHERE y > 0) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM g GROUP BY 1))
    SELECT slates, usable AS usable_slates, (SELECT count(*) FROM a) AS pairs, (SELECT round(avg(CASE WHEN s1 > s0 THEN 1.0 WHEN s1 = s0 THEN 0.5 ELSE 0.0 END), 9) FROM a) AS policy_auc,
      (SELECT round(avg(CASE WHEN p1 > p0 THEN 1.0 WHEN p1 = p0 THEN 0.5 ELSE 0.0 END), 9) FROM a) AS prediction_auc, (SELECT count(*) FROM t WHERE fits) AS usable, (SELECT count(*) FROM t WHERE NOT fits) AS dropped FROM c"""
)
def policy_offline_auc(spark, d):
    rows = star(spark, d, "request_id label price score position tie")
    x = F.array(F.col("score").cast("double"), F.col("position").cast("double"), F.col("tie").cast("double"))
    rows = rows.select(
        "request_id", F.when(F.col("tie") % 11 == 0, "v1").otherwise("v2").alias("version"), F.when(F.col("tie") % 7 > 0, x).alias("x"), F.when(F.col("tie") % 9 > 0, F.col("price")).alias("prediction_score"),
        F.when(F.col("tie") % 13 == 0, -1.0).otherwise(F.col("label")).alias("label"),
    )
    scored, counts = evaluation.scored_rows(rows, _WEIGHTS, "v2")
    got = evaluation.pairwise_auc(scored).crossJoin(counts)  # one row each
    return got.withColumns({"policy_auc": _r("policy_auc", 9), "prediction_auc": _r("prediction_auc", 9)})


@query(
    f"""WITH {EVENTS}, q AS (SELECT CAST(floor(quantile_cont(timestamp, 0.9)) AS BIGINT) AS cut FROM ev), u AS (SELECT user_id, count(*) FILTER (WHERE timestamp <= cut) AS h, count(*) FILTER (WHERE timestamp > cut) AS a FROM ev, q GROUP BY 1)
    SELECT CASE WHEN h = 0 THEN 'no_history' WHEN a = 0 THEN 'no_target' ELSE 'kept' END AS reason, count(*) AS n FROM u GROUP BY 1"""
)
def next_item_split(spark, d):
    readers = evaluation.split_timelines(events(spark, d))[2]
    return readers.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {EVENTS}, c AS (SELECT user_id, CASE WHEN k % 5 > 0 THEN item_id END AS item_id, CASE event_type WHEN 'click' THEN 'Rating ' ELSE event_type END AS event_type, timestamp, CASE WHEN event_type = 'click' THEN CAST(k % 5 AS DOUBLE) END AS rating,
      CASE WHEN event_type = 'signup' AND k % 3 > 0 THEN CAST(k AS INTEGER) END AS age, CASE WHEN event_type = 'signup' AND k % 4 > 0 THEN 'g' || (k % 4) END AS gender, CASE WHEN event_type = 'impression' AND k % 6 > 0 THEN 't' || k END AS title, CASE WHEN event_type = 'impression' THEN CAST(1900 + k AS INTEGER) END AS year FROM ev),
    r AS (SELECT user_id, count(*) AS n, sum(rating) AS total, max(timestamp) AS t FROM c WHERE event_type = 'Rating ' AND item_id IS NOT NULL GROUP BY 1),
    w AS (SELECT user_id, max(age) AS age, arg_min(gender, (timestamp, gender)) FILTER (WHERE gender IS NOT NULL) AS gender, max(timestamp) AS t FROM c WHERE age IS NOT NULL OR gender IS NOT NULL GROUP BY 1)
    SELECT user_id, age, gender, coalesce(n, 0) AS "ratingCountDelta", coalesce(total, 0.0::DOUBLE) AS "ratingSumDelta", greatest(w.t, r.t) AS "lastUpdatedTs" FROM w FULL JOIN r USING (user_id)"""
)
def context_user_updates(spark, d):
    return samples.user_feature_updates(samples.context_gate(_context(spark, d)).kept).select("user_id", "age", "gender", "ratingCountDelta", "ratingSumDelta", "lastUpdatedTs")


def _context(spark, d):
    """Events as ratings, sign-ups and film descriptions; some incomplete."""
    k, kind = F.col("k"), F.col("event_type")
    return events(spark, d).select(
        "user_id", F.when(k % 5 > 0, F.col("item_id")).alias("item_id"), F.when(kind == "click", "Rating ").otherwise(kind).alias("event_type"), "timestamp", F.when(kind == "click", (k % 5).cast("double")).alias("rating"),
        F.when((kind == "signup") & (k % 3 > 0), k.cast("int")).alias("age"), F.when((kind == "signup") & (k % 4 > 0), F.concat(F.lit("g"), k % 4)).alias("gender"),
        F.when((kind == "impression") & (k % 6 > 0), F.concat(F.lit("t"), k)).alias("title"), F.when(kind == "impression", (1900 + k).cast("int")).alias("release_year"),
    )


@query(
    f"""WITH {EVENTS}, c AS (SELECT CASE WHEN k % 5 > 0 THEN item_id END AS item_id, timestamp, CASE WHEN k % 6 > 0 THEN 't' || k END AS title, CAST(1900 + k AS INTEGER) AS year FROM ev WHERE event_type = 'impression')
    SELECT item_id, arg_min(title, (timestamp, title)) FILTER (WHERE title IS NOT NULL) AS title, max(year) AS "releaseYear", max(timestamp) AS "lastUpdatedTs" FROM c WHERE item_id IS NOT NULL GROUP BY 1"""
)
def context_movie_updates(spark, d):
    return samples.movie_feature_updates(samples.context_gate(_context(spark, d)).kept).select("item_id", "title", "releaseYear", "lastUpdatedTs")


@query("SELECT vec_id, 'g:' || array_to_string(list_sort(list_distinct(['x' || (vec_id % 3), 'a', 'x' || (vec_id % 2)])), ',') || '|t:' || CASE WHEN vec_id % 4 = 0 THEN '' ELSE 't' || (vec_id % 4) END AS state FROM embeddings")
def state_keys(spark, d):
    k = F.col("vec_id")
    genres = F.array(F.concat(F.lit("x"), k % 3), F.lit("a"), F.concat(F.lit("x"), k % 2), F.lit(None).cast("string"))
    return table(spark, d, "embeddings").select("vec_id", files.state_key(genres, F.when(k % 4 > 0, F.array(F.concat(F.lit("t"), k % 4)))).alias("state"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT u.vec_id AS u, i.vec_id AS i, list_cosine_similarity(u.v, i.v) AS score FROM v u, v i WHERE u.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM s) SELECT 'rec:' || u || ':candidates' AS key, string_agg(CAST(i AS VARCHAR), ',' ORDER BY rank) AS items FROM r WHERE rank <= 10 GROUP BY 1"""
)
def candidate_lists(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    best = measures.top_k_cosine(rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "user_id"), rows.withColumnRenamed("vec_id", "item_id"), 10)
    return files.candidate_lists(best, "rec", 3600).select("key", F.array_join("items", ",").alias("items"))


# --- queries, quality

_QUERY = f"""{_FILMS}, qy AS (SELECT *, coalesce(nullif(array_to_string(genres, ' '), ''), 'unknown') AS query FROM fi)"""
_RATES = """count(*) AS impressions, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions, count(DISTINCT query) AS distinct_queries, CAST(sum(clicked) AS BIGINT) AS clicks, CAST(sum(ordered) AS BIGINT) AS orders,
    round(CAST(sum(clicked) AS DOUBLE) / count(*), 4) AS ctr, round(CAST(sum(ordered) AS DOUBLE) / count(*), 4) AS cvr, round(sum(label) / count(*), 4) AS avg_rating"""


@query(f"WITH {_QUERY} SELECT query, CAST(length(query) AS INTEGER) AS query_len, {_RATES} FROM qy GROUP BY 1, 2")
def common_queries(spark, d):
    return reports.query_engagement(reports.with_query(_films(spark, d)), ["query", "query_len"])


@query(f"WITH {_QUERY} SELECT CASE WHEN length(query) <= 10 THEN 'short (<=10)' ELSE 'long (>10)' END AS query_length, {_RATES} FROM qy GROUP BY 1")
def query_lengths(spark, d):
    return reports.query_engagement(reports.with_query(_films(spark, d)), ["query_length"])


@query(
    f"""WITH {SAMPLES} SELECT avg(CAST(clicked AS DOUBLE)) AS ctr, 1.0::DOUBLE AS ctr_coverage, avg(CAST(ordered AS DOUBLE)) AS order_rate, 1.0::DOUBLE AS order_coverage, round(avg(label), 9) AS mean_reward, 1.0::DOUBLE AS reward_coverage,
    round(avg(rating), 6) AS mean_rating, CAST(count(rating) AS DOUBLE) / count(*) AS rating_coverage, round(avg(dwell_millis), 6) AS mean_dwell_millis, CAST(count(dwell_millis) AS DOUBLE) / count(*) AS dwell_coverage,
    round(avg(completion_rate), 9) AS mean_completion_rate, CAST(count(completion_rate) AS DOUBLE) / count(*) AS completion_coverage, CASE WHEN count(negative_feedback_reason) > 0 THEN CAST(count(negative_feedback_reason) AS DOUBLE) / count(*) END AS negative_feedback_rate,
    CAST(count(negative_feedback_reason) AS DOUBLE) / count(*) AS negative_feedback_coverage, count(rating) AS rated_samples, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM sm"""
)
def satisfaction_signals(spark, d):
    out = governance.satisfaction(_samples(spark, d).withColumn("reward", F.col("label")))
    return out.withColumns({"mean_reward": _r("mean_reward", 9), "mean_rating": _r("mean_rating"), "mean_dwell_millis": _r("mean_dwell_millis"), "mean_completion_rate": _r("mean_completion_rate", 9)})


def _diverse(spark, d):
    rows = _films(spark, d)
    return rows.select(F.col("request_id").alias("slate_id"), "item_id", "genres", F.when(F.col("k") % 3 > 0, (F.col("k") % 100).cast("double")).alias("popularity"))


_DIVERSE = f"""{_FILMS}, di AS (SELECT request_id AS slate_id, item_id, genres, list_sort(list_distinct(genres)) AS g, CASE WHEN k % 3 > 0 THEN k % 100 END AS popularity, row_number() OVER () AS i FROM fi),
  dn AS (SELECT slate_id, genre, count(*) AS n FROM (SELECT slate_id, unnest(genres) AS genre FROM di) GROUP BY 1, 2), dp AS (SELECT slate_id, n / sum(n) OVER (PARTITION BY slate_id) AS p FROM dn),
  de AS (SELECT slate_id, CAST(count(*) AS INTEGER) AS unique_genres, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS genre_entropy FROM dp GROUP BY 1),
  dd AS (SELECT a.slate_id, avg(1 - CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g)))) AS genre_distance FROM di a JOIN di b ON a.slate_id = b.slate_id AND a.i < b.i AND len(a.g) > 0 AND len(b.g) > 0 GROUP BY 1),
  ds AS (SELECT slate_id, count(*) AS n, count(*) FILTER (WHERE len(g) > 0) AS s, count(popularity) AS p, count(*) FILTER (WHERE popularity < 50) AS tail FROM di GROUP BY 1),
  dv AS (SELECT ds.slate_id, unique_genres, genre_entropy, genre_distance, CASE WHEN p > 0 THEN CAST(tail AS DOUBLE) / p END AS long_tail_share, CAST(s AS DOUBLE) / n AS genre_coverage, CAST(p AS DOUBLE) / n AS popularity_coverage
    FROM ds LEFT JOIN de USING (slate_id) LEFT JOIN dd USING (slate_id))"""


@query(f"WITH {_DIVERSE} SELECT slate_id, unique_genres, round(genre_entropy, 6) + 0.0 AS genre_entropy, round(genre_distance, 6) + 0.0 AS genre_distance, long_tail_share, genre_coverage, popularity_coverage FROM dv")
def slate_diversity(spark, d):
    out = governance.slate_diversity(_diverse(spark, d), 50.0)
    return out.withColumns({"genre_entropy": _r("genre_entropy") + F.lit(0.0), "genre_distance": _r("genre_distance") + F.lit(0.0)})


@query(f"WITH {_DIVERSE} SELECT b / 10::DOUBLE AS bin_start, count(dv.slate_id) AS count FROM range(10) r(b) LEFT JOIN (SELECT * FROM dv WHERE genre_distance IS NOT NULL) dv ON least(floor(round(genre_distance * 10, 9)), 9) = b GROUP BY 1")
def diversity_histogram(spark, d):
    return governance.histogram(governance.slate_diversity(_diverse(spark, d)), "genre_distance")


@query(
    f"""WITH {_FILMS}, e AS (SELECT unnest(genres) AS genre FROM fi), u AS (SELECT DISTINCT item_id, genres FROM fi), s AS (SELECT unnest(genres) AS genre FROM u)
    SELECT genre, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM e), 9) AS exposure_share, round(any_value(n) / (SELECT CAST(count(*) AS DOUBLE) FROM s), 9) AS served_share FROM e JOIN (SELECT genre, count(*) AS n FROM s GROUP BY 1) USING (genre) GROUP BY 1"""
)
def genre_exposure(spark, d):
    return governance.genre_exposure(_diverse(spark, d)).withColumns({"exposure_share": _r("exposure_share", 9), "served_share": _r("served_share", 9)})


@query(
    f"""WITH {STAR}, u AS (SELECT clicked, 'position' AS signal, CAST(-position AS DOUBLE) AS s FROM st UNION ALL SELECT clicked, 'quantity', CASE WHEN tie % 5 > 0 THEN score END FROM st UNION ALL SELECT clicked, 'nothing', NULL FROM st),
    a AS (SELECT signal, count(*) AS a, count(s) AS n, count(*) FILTER (WHERE clicked = 1 AND s IS NOT NULL) AS positives FROM u GROUP BY 1), g AS (SELECT * FROM u WHERE s IS NOT NULL),
    r AS (SELECT signal, clicked, rank() OVER (PARTITION BY signal ORDER BY s) + (count(*) OVER (PARTITION BY signal, s) - 1) / 2.0 AS rk FROM g),
    c AS (SELECT signal, (sum(rk) FILTER (WHERE clicked = 1) - sum(clicked) * (sum(clicked) + 1) / 2.0) / (sum(clicked) * (count(*) - sum(clicked))) AS auc FROM r GROUP BY 1),
    m AS (SELECT signal, avg(s) AS m, stddev_pop(s) AS d FROM g GROUP BY 1), l AS (SELECT signal, avg(-CASE WHEN clicked = 1 THEN ln(p) ELSE ln(1 - p) END) AS logloss FROM (SELECT signal, clicked, 1 / (1 + exp(-(s - m) / d)) AS p FROM g JOIN m USING (signal)) GROUP BY 1)
    SELECT signal, n, positives, CAST(n AS DOUBLE) / a AS coverage, round(auc, 9) AS auc, round(logloss, 6) AS logloss FROM a LEFT JOIN c USING (signal) LEFT JOIN l USING (signal)"""
)
def ranking_signals(spark, d):
    rows = star(spark, d, "clicked position score tie")
    scores = {"position": -F.col("position"), "quantity": F.when(F.col("tie") % 5 > 0, F.col("score")), "nothing": F.lit(None)}
    return measures.signals(rows, scores, F.col("clicked") == 1).withColumns({"auc": _r("auc", 9), "logloss": _r("logloss")})


@query(f"WITH {SAMPLES} SELECT user_id || ':' || session_id AS query, item_id, label, p_type AS title, coalesce(array_to_string(string_split(lower(p_name), ' '), '|'), '') AS genres FROM sm LEFT JOIN part ON 'item_' || (p_partkey + 3) = item_id")
def relevance_with_films(spark, d):
    films = table(spark, d, "part").select(F.concat(F.lit("item_"), F.col("p_partkey") + 3).alias("item_id"), F.col("p_type").alias("title"), F.split(F.lower("p_name"), " ").alias("genres"), (F.col("p_size") + 1980).alias("release_year"))
    return samples.relevance_samples(_samples(spark, d), films).select("query", "item_id", "label", "title", F.array_join("genres", "|").alias("genres"))


@query(f"WITH {SAMPLES} SELECT concat_ws(':', request_id, user_id) AS slate_id, max(impression_ms) + 1500 - min(impression_ts) * 1000 AS lag FROM sm WHERE user_id <> '3' GROUP BY request_id, user_id")
def ingest_lag(spark, d):
    slates = samples.build_slates(_samples(spark, d))
    last = _samples(spark, d).groupBy("request_id", "user_id").agg(F.max("impression_ts").alias("t"))
    ms = events(spark, d).filter("event_type = 'impression'").groupBy("request_id", "user_id").agg(F.max("timestamp_ms").alias("ms"))
    sent = slates.join(last, ["request_id", "user_id"]).join(ms, ["request_id", "user_id"]).withColumn("kafka_timestamp", F.timestamp_millis(F.col("ms") + 1500)).withColumn("user_id", F.nullif("user_id", F.lit("3")))
    return samples.with_ingest_lag(sent).select("slate_id", F.col("kafka_ingest_lag_ms").alias("lag"))


@query(f"WITH {SAMPLES}, g AS (SELECT CASE WHEN user_id = '3' THEN 'null_user_id' WHEN item_id = 'item_3' THEN 'null_item_id' ELSE 'kept' END AS reason FROM sm) SELECT r.reason, count(g.reason) AS n FROM (VALUES ('kept'), ('null_request_id'), ('null_user_id'), ('null_item_id')) r(reason) LEFT JOIN g USING (reason) GROUP BY 1")
def samples_gate(spark, d):
    rows = _samples(spark, d).withColumns({"user_id": F.nullif("user_id", F.lit("3")), "item_id": F.nullif("item_id", F.lit("item_3"))})
    return samples.samples_gate(rows).counts()
