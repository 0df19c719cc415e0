"""The driver's tables seen as events, samples, catalogs and ratings; each view in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the table's event types stand for; errors are thumbs or abandons by their number k.
_KIND = """CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'order'
    WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'thumb_up' WHEN 1 THEN 'thumb_down' ELSE 'abandon' END ELSE event_type END"""
#: Fields that the table lacks, made from k; the same text in both dialects.
_MADE = """CONCAT('m', k % 3) AS model_version, CASE WHEN k % 5 > 0 THEN CONCAT('p', k % 2) END AS policy_version, CAST(NULL AS STRING) AS algorithm_version,
    CASE WHEN k % 4 > 0 THEN timestamp - k * 86400 END AS published_at, k % 6 = 0 AS new_release,
    CASE k % 9 WHEN 0 THEN 'expired' WHEN 1 THEN 'muted_genre' WHEN 2 THEN 'else' END AS filter_reason, CASE WHEN k % 8 > 0 THEN k % 11 = 0 END AS unsafe_label,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'not_interested' END AS negative_feedback_reason, CASE WHEN event_type = 'click' THEN k * 100 END AS dwell_millis,
    CASE WHEN event_type = 'click' AND k % 7 > 0 THEN k % 11 / CAST(10 AS DOUBLE) END AS completion_rate,
    CASE WHEN k % 2 = 0 THEN 'home' ELSE 'search' END AS surface, CASE WHEN k % 3 = 0 THEN 'de' END AS locale, 'UTC' AS timezone, CASE WHEN k % 4 > 1 THEN 'phone' ELSE 'tv' END AS device"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").withColumn("ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    request = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.col("user_id"))
    rows = rows.select(
        F.col("event_id").cast("string").alias("event_id"), request.alias("request_id"), request.alias("session_id"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("item_"), k % 10).alias("item_id"), "event_type", F.expr("ms div 1000").alias("timestamp"), F.col("ms").alias("timestamp_ms"),
        (k % 7).cast("int").alias("position"), F.when(F.col("event_type").isin("click", "purchase"), F.col("value")).alias("rating"), k.alias("k"),
    )
    rows = rows.selectExpr("*", f"{_KIND} AS kind", *_split(_MADE))
    return rows.drop("event_type").withColumnRenamed("kind", "event_type").withColumn("item_features", F.create_map(F.lit("k"), F.col("k").cast("string")))


def _split(listed: str) -> list[str]:
    """The entries of a select list."""
    out, depth = [""], 0
    for c in listed:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_DUCK = _MADE.replace("AS STRING", "AS VARCHAR")
EVENTS = f"""e0 AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, epoch_us(ts) // 1000000 AS timestamp FROM events),
  ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y%m%d') || '-' || user_id AS request_id, strftime(ts, '%Y%m%d') || '-' || user_id AS session_id,
  CAST(user_id AS VARCHAR) AS user_id, 'item_' || (k % 10) AS item_id, {_KIND} AS event_type, timestamp, epoch_us(ts) // 1000 AS timestamp_ms, CAST(k % 7 AS INTEGER) AS position,
  CASE WHEN event_type IN ('click', 'purchase') THEN value END AS rating, k, {_DUCK} FROM e0)"""

_SHOWN, _ENGAGED = "event_type IN ('impression', 'exposure')", "event_type IN ('click', 'order', 'purchase')"
_ANSWERED = "event_type IN ('click', 'order', 'purchase', 'thumb_up', 'thumb_down', 'abandon')"
_LATEST = ", ".join(f"arg_max({c}, (timestamp, event_id)) FILTER (WHERE {_ANSWERED} AND {c} IS NOT NULL) AS {c}" for c in ("rating", "negative_feedback_reason", "dwell_millis", "completion_rate"))
_FIRST = ", ".join(f"arg_min({c}, (timestamp, event_id)) FILTER (WHERE {_SHOWN} AND {c} IS NOT NULL) AS {c}" for c in ("surface", "locale", "timezone", "device"))
_MEASURED = ("model_version", "policy_version", "algorithm_version", "published_at", "new_release", "filter_reason", "unsafe_label")

#: Samples, one row per (request, user, item) with an impression: the largest position and time of the impressions, what the last
#: impression by (timestamp, event_id) says of models and item, the latest answers that aren't null, the latest thumb.
SAMPLES = (
    EVENTS
    + f""", s0 AS (SELECT concat_ws(':', request_id, user_id, item_id) AS sample_id, request_id, user_id, item_id, coalesce(arg_min(session_id, (timestamp, event_id)), '') AS session_id,
  max(position) FILTER (WHERE {_SHOWN}) AS position, max(timestamp) FILTER (WHERE {_SHOWN}) AS impression_ts, max(timestamp_ms) FILTER (WHERE {_SHOWN}) AS impression_ms,
  CAST(max(CAST(event_type = 'click' AS INTEGER)) AS INTEGER) AS clicked, CAST(max(CAST(event_type IN ('order', 'purchase') AS INTEGER)) AS INTEGER) AS ordered,
  arg_max({{{', '.join(f"'{c}': {c}" for c in _MEASURED)}}}, (timestamp, event_id)) FILTER (WHERE {_SHOWN}) AS said,
  arg_max(timestamp, (timestamp, event_id)) FILTER (WHERE {_ENGAGED}) AS last_feedback_ts, arg_max(timestamp_ms, (timestamp, event_id)) FILTER (WHERE {_ENGAGED}) AS last_feedback_ms,
  {_LATEST}, {_FIRST}, arg_min(CAST(k AS VARCHAR), (timestamp, event_id)) FILTER (WHERE {_SHOWN}) AS feature,
  arg_max(CASE event_type WHEN 'thumb_up' THEN 1 ELSE -1 END, (timestamp, event_id)) FILTER (WHERE event_type IN ('thumb_up', 'thumb_down')) AS thumb,
  CAST(max(CAST(event_type = 'abandon' AS INTEGER)) AS INTEGER) AS abandoned
  FROM ev WHERE event_type <> 'signup' GROUP BY request_id, user_id, item_id HAVING bool_or({_SHOWN})),
  sm AS (SELECT *, CASE WHEN ordered = 1 THEN 2.0::DOUBLE WHEN clicked = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, last_feedback_ms - impression_ms AS feedback_delay_ms,
  {', '.join(f'said.{c} AS {c}' for c in _MEASURED)} FROM s0)"""
)

#: Columns of star() that need more than line items, and the tables that they need.
_NEEDS = {
    "user_id": "orders", "device": "orders", "segment": "orders customer", "geo": "orders customer nation region",
    "genres": "part", "year": "part", "query_text": "part", "brand": "part",
}


def star(spark: SparkSession, sf_dir: str, columns: str = "") -> DataFrame:
    """A dense table of samples: a line item is an impression, returned ones clicked, flag A ordered.

    columns: those that are needed (all if none is named). Tables of which no
    column is needed aren't joined: every line item has its order, part and so on.
    """
    flag = F.col("l_returnflag")
    made = {
        "request_id": F.col("l_orderkey").cast("string"), "session_id": F.col("l_orderkey").cast("string"), "user_id": F.col("o_custkey").cast("string"),
        "item_id": F.col("l_partkey").cast("string"), "position": F.col("l_linenumber"), "tie": F.col("l_suppkey"),
        "clicked": F.when(flag.isin("A", "R"), 1).otherwise(0), "ordered": F.when(flag == "A", 1).otherwise(0),
        "label": F.when(flag == "A", 2.0).when(flag == "R", 1.0).otherwise(0.0), "date": F.to_date("l_shipdate"),
        "genres": F.split(F.lower("p_name"), " "), "year": F.col("p_size") + 1980, "query_text": F.col("p_type"), "score": F.col("l_quantity"), "price": F.col("l_extendedprice"),
        "segment": F.col("c_mktsegment"), "geo": F.col("r_name"), "device": F.col("o_orderpriority"), "status": F.col("l_linestatus"), "brand": F.col("p_brand"),
    }
    wanted = columns.split() or list(made)
    needed = {t for c in wanted for t in _NEEDS.get(c, "").split()}
    rows = table(spark, sf_dir, "lineitem")
    for name, left, right in (("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")):
        if name in needed:
            rows = rows.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return rows.select(*[made[c].alias(c) for c in wanted])


STAR = """st AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, CAST(l_orderkey AS VARCHAR) AS session_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
  l_linenumber AS position, l_suppkey AS tie, CAST(l_returnflag IN ('A', 'R') AS INTEGER) AS clicked, CAST(l_returnflag = 'A' AS INTEGER) AS ordered,
  CASE l_returnflag WHEN 'A' THEN 2.0::DOUBLE WHEN 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CAST(l_shipdate AS DATE) AS date, string_split(lower(p_name), ' ') AS genres,
  p_size + 1980 AS year, p_type AS query_text, l_quantity AS score, l_extendedprice AS price, c_mktsegment AS segment, r_name AS geo, o_orderpriority AS device, l_linestatus AS status, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
