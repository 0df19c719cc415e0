"""Sources and sinks in files: text forms, JSON, CSV, sequences, keyed state."""

from __future__ import annotations

import csv
import io
import json
import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.schemas import RATINGS


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=RATINGS, header=True)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose types are inferred; that reads it twice."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_or_empty(spark: SparkSession, read, schema: T.StructType | str, name: str) -> DataFrame:
    """read(), or an empty table and a warning if its source isn't there: a report goes on without it."""
    try:
        return read()
    except Exception as e:
        warnings.warn(f"{name} is left out: {type(e).__name__}", stacklevel=2)
        return spark.createDataFrame([], schema)


#: A slate or a replayed event, as far as readers need it; other fields are left out.
SLATE = "slate_id string, request_id string, user_id string, request_ts bigint, items array<struct<item_id:string,position:int,clicked:int,ordered:int,label:double,genres:array<string>,popularity:double>>"
REPLAY = (
    "requestId string, user string, action string, reward double, timestamp bigint, feedbackTimestamp bigint, state struct<genres:array<string>,tags:array<string>>, "
    "actionSpace array<struct<item:string,features:map<string,double>>>"
)


def read_slates(spark: SparkSession, path: str) -> DataFrame:
    """Slates of a file: JSON a line (.jsonl), a JSON array of records, a JSON object by column and row number (.json), or Parquet."""
    if path.endswith(".jsonl"):
        return spark.read.schema(SLATE).json(path)
    if not path.endswith(".json"):
        rows = spark.read.parquet(path)
        return rows.select(*[c for c in T._parse_datatype_string(SLATE).names if c in rows.columns])
    text = spark.read.text(path, wholetext=True)
    kind = T._parse_datatype_string(SLATE)
    records = text.filter(~F.trim("value").startswith("{")).select(F.explode(F.from_json("value", T.ArrayType(kind))).alias("r")).select("r.*")
    # by column: {"user_id": {"0": ...}, ...}
    by = ", ".join(f"{f.name}: map<string,{f.dataType.simpleString()}>" for f in kind)
    whole = text.filter(F.trim("value").startswith("{")).select(F.from_json("value", f"struct<{by}>").alias("c"))
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(f"c.{n}"), F.array().cast("array<string>")) for n in kind.names])))
    rows = whole.select("c", F.explode(keys).alias("i")).orderBy(F.col("i").try_cast("long"), "i")
    return records.unionByName(rows.select(*[F.try_element_at(F.col(f"c.{n}"), F.col("i")).alias(n) for n in kind.names]))


def read_replay(spark: SparkSession, path: str, least: int = -1) -> DataFrame:
    """Replayed events of JSON lines or Parquet, those from `least` (epoch milliseconds) on; what isn't one is left out."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(REPLAY).json(path)
    return rows.filter(F.col("requestId").isNotNull() & (F.coalesce("feedbackTimestamp", "timestamp", F.lit(0)) >= least))


def event_time() -> Column:
    """Epoch milliseconds of a replayed event: of its feedback, else of when it was served, else 0."""
    return F.coalesce("feedbackTimestamp", "timestamp", F.lit(0).cast("long"))


def state_key(genres: Column, tags: Column) -> Column:
    """g:<genres>|t:<tags>, each sorted, without repeats or nulls: the same for the same state, whatever its order."""
    part = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: x.isNotNull()))), ",")
    return F.concat(F.lit("g:"), part(genres), F.lit("|t:"), part(tags))


def dated_tables(spark: SparkSession, root: str, prefix: str, first: str, last: str) -> DataFrame:
    """The tables root/prefixYYYYMMDD from first to last as one, with the suffix of each row; only those are opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    wanted = sorted(n for n in names if n.startswith(prefix) and first <= n.removeprefix(prefix).removesuffix(".parquet") <= last)
    if not wanted:
        raise FileNotFoundError(f"no table {prefix}* from {first} to {last}")
    out = None
    for n in wanted:
        df = spark.read.parquet(f"{root}/{n}").withColumn("table_suffix", F.lit(n.removeprefix(prefix).removesuffix(".parquet")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A table that must not be there yet; any format of the session."""
    df.write.format(fmt).mode("errorifexists").save(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of lines `id:v1 v2 ...`; lines that aren't of that form are left out."""
    rows = spark.read.text(path).select(F.split("value", ":", 2).alias("p")).filter(F.size("p") == 2)
    rows = rows.select(F.trim(F.col("p")[0]).alias("id"), F.transform(F.split(F.trim(F.col("p")[1]), r"\s+"), lambda x: x.try_cast("double")).alias("vector"))
    return rows.filter((F.col("id") != "") & ~F.exists("vector", lambda x: x.isNull()))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.col("id"), F.lit(":"), F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, title, genres, tags, newRelease, publishedAt) of a JSON object by item."""
    entry = "struct<title:string,genres:array<string>,tags:array<string>,newRelease:boolean,publishedAt:string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("item_id", "e"))
    return rows.select("item_id", "e.*")


def from_json_topic(raw: DataFrame, schema: T.StructType) -> DataFrame:
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")


def to_json_topic(df: DataFrame, key: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Key and JSON of all columns, with headers where a durable sink asks for them."""
    cols = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")]
    if headers:
        cols.append(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in headers.items()]).alias("headers"))
    return df.select(*cols)


def read_topic(spark: SparkSession, options: dict[str, str], fmt: str = "kafka") -> DataFrame:
    """A stream of envelopes; any streaming format of the session with its options."""
    return spark.readStream.format(fmt).options(**options).load()


def csv_document(rows: list[dict]) -> str:
    """Rows as CSV with the sorted names of all their fields; what isn't finite or is missing is empty, lists and maps are JSON."""
    names = sorted({k for r in rows for k in r})
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(names)
    for r in rows:
        cells = [r.get(n) for n in names]
        writer.writerow(["" if c is None or isinstance(c, float) and not math.isfinite(c) else json_document(c) if isinstance(c, (dict, list, tuple)) else c for c in cells])
    return out.getvalue()


def candidate_lists(ranked: DataFrame, prefix: str, seconds: int) -> DataFrame:
    """(key, items, expires_s) of ranked (user_id, item_id, rank): the list that is served to each user, best first; users without items have none."""
    rows = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("r"))
    return rows.select(F.concat(F.lit(f"{prefix}:"), "user_id", F.lit(":candidates")).alias("key"), F.transform("r", lambda x: x["item_id"].cast("string")).alias("items"), F.lit(seconds).alias("expires_s"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as a single file; for small results only."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)


def json_document(value) -> str:
    """Sorted JSON with null for what isn't finite."""

    def clean(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), sort_keys=True, ensure_ascii=False, default=str)


def replay_ratings(entries: DataFrame) -> DataFrame:
    """Ratings of replayed rewards: five times the reward, 5 at most, to one decimal."""
    # tenths are rounded to a whole number: 0.69 * 5 is 3.4499999999999997, which round(x, 1) takes for less than 3.45
    rating = F.round(F.least(F.col("reward") * 5, F.lit(5.0)) * 10) / 10
    # whole numbers are divided: a double has too few digits for those over 2^53
    entries = entries.withColumns({"rating": rating, "t": F.floor("timestamp").cast("long")})
    return entries.select(F.col("user").alias("userId"), F.col("action").alias("movieId"), "rating", F.expr("(t - pmod(t, 1000)) div 1000").alias("timestamp"))


class KeyedState:
    """A table of values by key, in versions: a version is written whole, then a pointer names it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        base = self.path(f"{self.root}/pointers")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(base)) if self.fs.exists(base) else []

    def read(self) -> DataFrame | None:
        got = self._versions()
        return self.spark.read.parquet(f"{self.root}/v={got[-1]}") if got else None

    def publish(self, df: DataFrame, version: int) -> bool:
        """False if that version or a later one is already there: a retry, or a writer that fell behind."""
        got = self._versions()
        if got and version <= got[-1]:
            return False
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        self.fs.create(self.path(f"{self.root}/pointers/{version:012d}"), False).close()
        for old in got[:-1]:
            self.fs.delete(self.path(f"{self.root}/v={old}"), True)
            self.fs.delete(self.path(f"{self.root}/pointers/{old:012d}"), True)
        return True

    def add_counts(self, delta: DataFrame, key: str, count: str, version: int) -> bool:
        old = self.read()
        now = delta if old is None else old.unionByName(delta).groupBy(key).agg(F.sum(count).alias(count))
        return self.publish(now, version)

    def lookup(self, keys: DataFrame, key: str) -> DataFrame:
        """keys with what the state has of them; keys it lacks stay out. Only the columns that are used of it are read."""
        state = self.read()
        return keys.limit(0) if state is None else keys.join(state, key)
