"""Replaying archives and sending dead letters again."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.sources.avro import Codec, decode_frame
from rivulet.streaming.engine import Commits


def archive(commits: Commits, batches: list[str], start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows of committed batches whose date lies in [start, end). Each batch is checked against its manifest first."""
    out = None
    for name in batches:
        commits.validate(name)
        df = commits.read(name)
        if start is not None:
            df = df.filter(F.col("date") >= F.lit(start))
        if end is not None:
            df = df.filter(F.col("date") < F.lit(end))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no batches")
    return out


def replay(commits: Commits, batches: list[str], send: Callable[[DataFrame], None], name: str = "replay") -> list[str]:
    """Sends every batch once, in order; after a failure it goes on with the first that wasn't sent."""
    sent = []
    for batch in batches:
        mark = f"_replay/{name}/{batch.replace('/', '_')}"
        if commits.marked(mark):
            continue
        commits.validate(batch)
        send(commits.read(batch))
        commits.mark(mark)
        sent.append(batch)
    return sent


def redrive(dead: DataFrame, codec: Codec, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(messages to send again, counts of the others by their first error code).

    A dead letter may go again if its bytes decode now; they are sent as they are.
    """
    keys = [c for c in dead.columns if c.startswith("kafka_")]
    raw = dead.select(F.col("raw_value").alias("value"), *[F.col(c).alias(c.removeprefix("kafka_")) for c in keys])
    valid, _ = decode_frame(raw, codec, schema)
    again = dead.join(valid.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("raw_value").alias("value"))
    left = dead.join(again.select(*keys), keys, "left_anti").groupBy("error_code").agg(F.count("*").alias("n"))
    return again, left


def replay_paced(
    commits: Commits, batches: list[str], send: Callable[[DataFrame], None], rows_per_second: float, rows: int = 1000, order: tuple[str, ...] = ("timestamp_ms", "event_id"), name: str = "paced",
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Sends every batch in slices of about `rows` rows, in order, no faster than the rate; gives the number of rows sent now.

    A batch is sorted by range into slices and written down once, so a slice
    holds the same rows when the replay goes on after a failure. A slice that was
    sent before isn't sent again and takes no time.
    """
    if not rows_per_second > 0 or rows < 1:
        raise ValueError("a rate above 0 and slices of a row at least are needed")
    sent, began = 0, None
    for batch in batches:
        commits.validate(batch)
        key = f"_replay/{name}/{batch.replace('/', '_')}"
        if commits.marked(f"{key}/all"):
            continue
        df = commits.read(batch)
        total = df.count()
        slices = max(1, -(-total // rows))
        if not commits.exists(f"{key}/sliced"):
            number = F.spark_partition_id().alias("rv_slice")
            commits.write(f"{key}/sliced", df.repartitionByRange(slices, *order).sortWithinPartitions(*order).select("*", number), ["rv_slice"], reserved=())
        held = commits.read(f"{key}/sliced")
        counts = dict(held.groupBy("rv_slice").count().collect())
        for k in sorted(counts):
            if commits.marked(f"{key}/{k}"):
                continue
            began = clock() if began is None else began
            wait = began + sent / rows_per_second - clock()
            if wait > 0:
                sleep(wait)
            send(held.filter(F.col("rv_slice") == k).drop("rv_slice"))
            commits.mark(f"{key}/{k}")
            sent += counts[k]
        commits.mark(f"{key}/all")
        commits.remove(f"{key}/sliced")
    return sent
