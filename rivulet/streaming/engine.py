"""Micro-batches with durable, idempotent commits."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import StreamConfig
from rivulet.functions.columns import cutoff_ms, is_fixed, interval_seconds, utc_date


def with_retry(call: Callable, attempts: int = 2, wait: float = 0.2):
    """call(), and up to `attempts` times more if it fails."""
    for k in range(attempts + 1):
        try:
            return call()
        except Exception:
            if k == attempts:
                raise
            time.sleep(wait)


class Commits:
    """Directories that appear whole or not at all, each with a manifest of its files.

    Files are written by Spark to an attempt folder, listed with sizes, digests and
    row count in a manifest, and moved in one rename that never replaces anything.
    Digests are a job over the files; only files of over DIGEST_BYTES, too large
    for a row, are read as a stream on the driver.
    """

    VERSION = 2
    DIGEST_BYTES = 256 << 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, path: str, data: bytes) -> None:
        stream = self._fs.create(self._path(path), False)
        stream.write(bytearray(data))
        stream.close()

    def _digest(self, path: str) -> str:
        """SHA-256 of a file, read in the JVM as a stream."""
        md = self.spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
        stream = self.spark._jvm.java.security.DigestInputStream(self._fs.open(self._path(path)), md)
        try:
            self._io.copyLarge(stream, self.spark._jvm.java.io.OutputStream.nullOutputStream())
        finally:
            stream.close()
        return bytes(md.digest()).hex()

    def _files(self, folder: str) -> list[dict]:
        sizes, todo = {}, [folder]
        root = self._path(folder).toUri().getPath().rstrip("/")
        relative = lambda path: path[path.index(root) + len(root) + 1 :]
        while todo:
            for s in self._fs.listStatus(self._path(todo.pop())):
                name = s.getPath().toUri().getPath()
                if s.isDirectory():
                    todo.append(name)
                elif name.endswith(".parquet"):
                    sizes[name] = s.getLen()
        small = {n for n, size in sizes.items() if size <= self.DIGEST_BYTES}
        digests = {n: self._digest(n) for n in sizes.keys() - small}
        if small:
            rows = self.spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load(folder)
            for r in rows.filter(F.col("length") <= self.DIGEST_BYTES).select("path", F.sha2("content", 256).alias("sha256")).collect():
                digests[self._path(r["path"]).toUri().getPath()] = r["sha256"]
        return sorted(({"path": relative(n), "size": size, "sha256": digests[n]} for n, size in sizes.items()), key=lambda f: f["path"])

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}/_manifest.json"))

    def validate(self, name: str) -> dict:
        """The manifest, if the directory holds exactly what it says."""
        raw = self._read(f"{self.root}/{name}/_manifest.json")
        manifest = json.loads(raw)
        if manifest.get("version") != self.VERSION or json.dumps(manifest, sort_keys=True).encode() != raw:
            raise ValueError(f"{name}: not a manifest of version {self.VERSION}")
        if self._files(f"{self.root}/{name}") != manifest["files"]:
            raise ValueError(f"{name}: the files differ from the manifest")
        return manifest

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), reserved: Sequence[str] = ("query", "sink", "batch")) -> bool:
        """False, after a check of what is there, if it was committed before."""
        clash = {c.lower() for c in df.columns} & {r.lower() for r in reserved}
        if clash:
            raise ValueError(f"reserved columns: {sorted(clash)}")
        if self.exists(name):
            self.validate(name)
            return False
        attempt = f"{self.root}/_attempts/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(attempt)
        rows = self.spark.read.schema(df.schema).parquet(attempt).count()
        manifest = {"version": self.VERSION, "name": name, "rows": rows, "files": self._files(attempt)}
        self._write(f"{attempt}/_manifest.json", json.dumps(manifest, sort_keys=True).encode())
        target = self._path(f"{self.root}/{name}")
        self._fs.mkdirs(target.getParent())
        moved = not self._fs.exists(target) and self._fs.rename(self._path(attempt), target)
        # some file systems move a folder into one that has come to be there meanwhile
        inside = self._path(f"{self.root}/{name}/{attempt.rsplit('/', 1)[1]}")
        if moved and not self._fs.exists(inside):
            return True
        self._fs.delete(inside if moved else self._path(attempt), True)
        self.validate(name)
        return False

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def mark(self, name: str) -> None:
        if not self._fs.exists(self._path(f"{self.root}/{name}")):
            self._write(f"{self.root}/{name}", b"")

    def marked(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))


def dedupe_within_watermark(df: DataFrame, time_column: str, delay: str, key: str = "event_id") -> DataFrame:
    """One row per key: within the watermark on a stream, overall on a table."""
    if df.isStreaming:
        return df.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


class DurableDedupe:
    """Keys seen so far, a snapshot a batch. A retry of batch N reads N - 1 again, so it decides the same."""

    def __init__(self, commits: Commits, delay: str, key: str = "event_id", time_ms: str = "timestamp_ms"):
        cutoff_ms(0, delay)  # refuses what isn't an interval
        self.commits, self.delay, self.key, self.time = commits, delay, key, time_ms

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """New rows only. The watermark forgets old keys; it never drops a row of the batch."""
        now = batch.dropDuplicates([self.key])
        seen = now.select(self.key, self.time)
        before = f"dedupe/batch={batch_id - 1:012d}"
        if batch_id > 0 and self.commits.exists(before):
            prior = self.commits.read(before, seen.schema)
            now = now.join(prior.select(self.key), self.key, "left_anti")
            seen = prior.unionByName(seen).groupBy(self.key).agg(F.max(self.time).alias(self.time))
        newest = seen.agg(F.max(self.time).alias("newest"))
        if is_fixed(self.delay):
            kept = seen.crossJoin(F.broadcast(newest)).filter(F.col(self.time) >= F.col("newest") - interval_seconds(self.delay) * 1000).drop("newest")  # newest is one row
        else:
            last = newest.first()[0]
            kept = seen if last is None else seen.filter(F.col(self.time) >= cutoff_ms(last, self.delay))
        self.commits.write(f"dedupe/batch={batch_id:012d}", kept)
        if batch_id > 1:
            self.commits.remove(f"dedupe/batch={batch_id - 2:012d}")
        return now


class LateFeedback:
    """Holds a slate's events until it closes, then lets them go all at once.

    A slate closes when event time has passed its impression (or first event) by
    the wait, or when it has been held that long by the clock. Event time never
    runs ahead of the clock, so one event from the future closes nothing.
    """

    KEYS = ("request_id", "user_id")

    def __init__(self, commits: Commits, wait: str):
        self.commits, self.wait = commits, interval_seconds(wait) * 1000

    def split(self, events: DataFrame, pending: DataFrame | None, now_ms: int) -> tuple[DataFrame, DataFrame]:
        """(due, open) of the events held and those that come in (both with timestamp_ms)."""
        every = events.withColumn("first_seen_ms", F.lit(now_ms).cast("long"))
        if pending is not None:
            every = pending.unionByName(every, allowMissingColumns=True)
        shown = F.lower("event_type").isin("impression", "exposure")
        slates = every.groupBy(*self.KEYS).agg(F.min(F.when(shown, F.col("timestamp_ms"))).alias("shown"), F.min("timestamp_ms").alias("first"), F.min("first_seen_ms").alias("seen"))
        clock = F.least(F.max("timestamp_ms"), F.lit(now_ms))
        slates = slates.crossJoin(F.broadcast(every.agg(clock.alias("clock"))))  # one row
        closes = (F.col("clock") >= F.coalesce("shown", "first") + self.wait) | (F.lit(now_ms) - F.col("seen") >= self.wait)
        due = slates.filter(closes).select(*self.KEYS)
        keys = list(self.KEYS)
        return every.join(due, keys, "left_semi").drop("first_seen_ms"), every.join(due, keys, "left_anti")

    def process(self, events: DataFrame, batch_id: int, now_ms: int) -> DataFrame:
        """The due events. A retry finds its snapshot and lets the same slates go."""
        before, mine = f"pending/batch={batch_id - 1:012d}", f"pending/batch={batch_id:012d}"
        schema = events.withColumn("first_seen_ms", F.lit(0).cast("long")).schema
        pending = self.commits.read(before, schema) if batch_id > 0 and self.commits.exists(before) else None
        due, held = self.split(events, pending, now_ms)
        if self.commits.exists(mine):
            every = events if pending is None else pending.drop("first_seen_ms").unionByName(events, allowMissingColumns=True)
            return every.join(self.commits.read(mine, schema).select(*self.KEYS).distinct(), list(self.KEYS), "left_anti")
        self.commits.write(mine, held)
        if batch_id > 1:
            self.commits.remove(f"pending/batch={batch_id - 2:012d}")
        return due

    @staticmethod
    def orphans(due: DataFrame) -> DataFrame:
        """Events of slates without an impression."""
        shown = due.filter(F.lower("event_type").isin("impression", "exposure")).select(*LateFeedback.KEYS).distinct()
        return due.join(shown, list(LateFeedback.KEYS), "left_anti")


@dataclass
class Sink:
    """A named place for a batch: transform, then write(df, batch_id)."""

    name: str
    write: Callable[[DataFrame, int], None]


class Engine:
    """Runs stages over each batch and each sink once, whatever is retried."""

    def __init__(self, commits: Commits, stages: Sequence[Callable[[DataFrame, int], DataFrame]], sinks: Sequence[Sink], retries: int = 2):
        names = [s.name.strip() for s in sinks]
        if not all(names) or len(set(names)) != len(names):
            raise ValueError("sinks need different names that aren't blank")
        self.commits, self.stages, self.sinks, self.retries = commits, stages, sinks, retries

    def batch(self, df: DataFrame, batch_id: int) -> None:
        for stage in self.stages:
            df = stage(df, batch_id)
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for sink in self.sinks:
                done = f"_done/{hashlib.sha256(sink.name.encode()).hexdigest()[:16]}-{batch_id:012d}"
                if not self.commits.marked(done):
                    with_retry(lambda sink=sink: sink.write(df, batch_id), self.retries)
                    self.commits.mark(done)
        finally:
            df.unpersist()

    def run(self, source: DataFrame, checkpoint: str, trigger: dict | None = None):
        return source.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def run_configured(self, source: Source, config: StreamConfig, checkpoint: str):
        """A job as configured: bounded offsets, data-loss rule and interval (0: what is there, then the end) come from config."""
        problems = config.problems()
        if problems:
            raise ValueError("; ".join(problems))
        self.retries = config.retries
        trigger = {"processingTime": f"{config.trigger_seconds} seconds"} if config.trigger_seconds else {"availableNow": True}
        return self.run(source.read(self.commits.spark, config), checkpoint, trigger)


@dataclass(frozen=True)
class Source:
    """A streaming format of the session with its options; those that config sets go first."""

    format: str
    options: dict[str, str]
    schema: str | None = None

    def read(self, spark: SparkSession, config: StreamConfig) -> DataFrame:
        bound = {"kafka": {"maxOffsetsPerTrigger": str(config.max_offsets), "failOnDataLoss": str(config.fail_on_data_loss).lower()}}
        reader = spark.readStream.format(self.format).options(**{**bound.get(self.format, {}), **self.options})
        return (reader.schema(self.schema) if self.schema else reader).load()


class DecodedEngine(Engine):
    """Batches of raw messages: decoded, both outcomes archived, then only new valid rows go on.

    decode gives (valid, dead). The archive comes first, so a batch that can't be
    archived isn't counted or processed. A retry finds the archive, the dedupe's
    decisions and the sinks' marks, and does what is left.
    """

    def __init__(self, commits: Commits, decode: Callable[[DataFrame], tuple[DataFrame, DataFrame]], dedupe: DurableDedupe, stages, sinks, retries: int = 2, report: Callable[[int, int, dict[str, int]], None] | None = None):
        super().__init__(commits, stages, sinks, retries)
        self.decode, self.dedupe, self.report = decode, dedupe, report

    def batch(self, df: DataFrame, batch_id: int) -> None:
        valid, dead = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in self.decode(df))
        try:
            dated = valid.withColumn("date", utc_date(F.floor(F.col(self.dedupe.time) / 1000)))
            with_retry(lambda: self.commits.write(f"raw/valid/batch={batch_id:012d}", dated, ["date"]), self.retries)
            with_retry(lambda: self.commits.write(f"raw/dead/batch={batch_id:012d}", dead), self.retries)
            if self.report:
                reasons = {r["error_code"]: r["n"] for r in dead.groupBy("error_code").agg(F.count("*").alias("n")).collect()}
                self.report(batch_id, valid.count(), reasons)
            super().batch(self.dedupe.process(valid, batch_id), batch_id)
            self.commits.mark(f"_complete/{batch_id:012d}")
        finally:
            valid.unpersist()
            dead.unpersist()


def parquet_sink(commits: Commits, name: str, partition_by: Sequence[str] = (), files: int | None = None) -> Sink:
    def write(df: DataFrame, batch_id: int) -> None:
        commits.write(f"{name}/batch={batch_id:012d}", df if files is None else df.coalesce(files), partition_by)

    return Sink(name, write)


class Ledger:
    """States of sinks that change once a batch: 1 applied, 0 applied before, -1 older than what is remembered.

    A change is a new version of the state, written whole. One small file then
    names it together with the batches applied so far, and is created only if no
    one else has: the change, its mark and the fence become visible at once or not
    at all, and outlive the process.
    """

    def __init__(self, spark: SparkSession, root: str, remember: int = 100):
        self.commits, self.remember = Commits(spark, root), remember

    def _folder(self, sink: str) -> str:
        return f"{self.commits.root}/{hashlib.sha256(sink.encode()).hexdigest()[:16]}"

    def _latest(self, sink: str) -> tuple[int, dict]:
        fs, path = self.commits._fs, self.commits._path(f"{self._folder(sink)}/pointers")
        found = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        if not found:
            return 0, {"data": None, "applied": []}
        return int(found[-1]), json.loads(self.commits._read(f"{self._folder(sink)}/pointers/{found[-1]}"))

    def read(self, sink: str) -> DataFrame | None:
        """The state of a sink; None before the first change."""
        data = self._latest(sink)[1]["data"]
        return self.commits.spark.read.parquet(f"{self._folder(sink)}/{data}") if data else None

    def apply(self, sink: str, batch_id: int, change: Callable[[DataFrame | None], DataFrame]) -> int:
        version, info = self._latest(sink)
        applied = info["applied"]
        if applied and batch_id <= max(applied) - self.remember:
            return -1
        if batch_id in applied:
            return 0
        data = f"state-{version + 1:012d}-{uuid.uuid4().hex}"
        change(self.read(sink)).write.parquet(f"{self._folder(sink)}/{data}")
        applied = sorted([*applied, batch_id])
        applied = [b for b in applied if b > applied[-1] - self.remember]
        # fails if another writer has made this version: the caller's retry then looks again
        self.commits._write(f"{self._folder(sink)}/pointers/{version + 1:012d}", json.dumps({"data": data, "applied": applied}).encode())
        if info["data"]:
            self.commits._fs.delete(self.commits._path(f"{self._folder(sink)}/{info['data']}"), True)
            self.commits._fs.delete(self.commits._path(f"{self._folder(sink)}/pointers/{version:012d}"), True)
        return 1
