"""Schemas of the event and sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "features": T.MapType(T.StringType(), T.StringType())}


def _fields(text: str) -> T.StructType:
    """A schema of `name kind, ...`; no session is needed."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


EVENT = _fields(
    "event_id string, request_id string, session_id string, user_id string, item_id string, event_type string, timestamp_ms bigint, position int, "
    "user_features features, item_features features, context_features features, model_version string, policy_version string, algorithm_version string, "
    "rating double, negative_feedback_reason string, dwell_millis bigint, completion_rate double, published_at bigint, new_release boolean, filter_reason string, unsafe_label boolean, "
    "surface string, locale string, timezone string, device string, query_id string, query_text string, result_set_id string, referrer string, view_kind string, view_duration_ms bigint"
)
RATINGS = _fields("userId string, movieId string, rating double, timestamp bigint")
ENVELOPE = _fields("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp").add("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])))


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with every field of schema, absent ones as typed nulls, and nothing else."""
    there = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(there[f.name.lower()]) if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
