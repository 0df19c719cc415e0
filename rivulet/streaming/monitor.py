"""What batches and stages cost."""

from __future__ import annotations

import logging
import threading
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("rivulet")


def human_bytes(n: int) -> str:
    for unit, size in (("G", 1 << 30), ("M", 1 << 20), ("K", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return f"{n}B"


class BatchMetrics(StreamingQueryListener):
    """A line a micro-batch: rows, rows a second, milliseconds."""

    def __init__(self, emit=log.info):
        self.emit = emit

    @staticmethod
    def line(name: str | None, rows: int, rate: float, millis: int) -> str:
        return f"batch query={name} rows={rows} rps={rate} ms={millis}"

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.emit(self.line(p.name, p.numInputRows, p.processedRowsPerSecond, int((p.durationMs or {}).get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


@dataclass(frozen=True)
class StageCost:
    stage: int
    attempt: int
    tasks: int
    failed: int
    spill_memory: int
    spill_disk: int
    shuffle_read: int
    shuffle_write: int

    @property
    def notable(self) -> bool:
        """Something spilled, failed or ran again."""
        return bool(self.spill_memory or self.spill_disk or self.failed or self.attempt)

    def line(self) -> str:
        return (
            f"stage={self.stage} attempt={self.attempt} tasks={self.tasks} failed={self.failed} spillMem={human_bytes(self.spill_memory)} spillDisk={human_bytes(self.spill_disk)} "
            f"shuffleRead={human_bytes(self.shuffle_read)} shuffleWrite={human_bytes(self.shuffle_write)}"
        )


def stage_costs(spark: SparkSession, after: int = -1) -> list[StageCost]:
    """Stages that completed, of a higher number than `after`, from the status store that the driver keeps (bounded by spark.ui.retainedStages)."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()
    done = jvm.java.util.ArrayList()
    done.add(jvm.org.apache.spark.status.api.v1.StageStatus.COMPLETE)
    done.add(jvm.org.apache.spark.status.api.v1.StageStatus.FAILED)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    found = store.stageList(done, False, False, none, jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return sorted(
        (
            StageCost(s.stageId(), s.attemptId(), s.numTasks(), s.numFailedTasks(), s.memoryBytesSpilled(), s.diskBytesSpilled(), s.shuffleReadBytes(), s.shuffleWriteBytes())
            for s in stages if s.stageId() > after
        ),
        key=lambda c: (c.stage, c.attempt),
    )


def report_stages(spark: SparkSession, after: int = -1, notable=log.info, quiet=log.debug) -> int:
    """Says what each new stage cost; the quiet ones quietly. The highest stage seen, for the next call."""
    for cost in stage_costs(spark, after):
        (notable if cost.notable else quiet)(cost.line())
        after = max(after, cost.stage)
    return after


def report_drops(name: str, gate, emit=log.info, warn=log.warning) -> dict[str, int]:
    """A line with what a gate kept and dropped, zeros included; a streaming frame can't be counted and says so once."""
    if gate.tagged.isStreaming:
        warn(f"drops gate={name}: a stream is counted batch by batch only")
        return {}
    counts = {r["reason"]: r["n"] for r in gate.counts().collect()}
    emit(f"drops gate={name} " + " ".join(f"{k}={counts[k]}" for k in ["kept", *gate.reasons]))
    return counts


class FailureTally:
    """Failures by (stage, attempt), for `most` stages at a time: late news of others is dropped, so nothing leaks."""

    def __init__(self, most: int = 10_000):
        self.most, self.counts, self.lock = most, {}, threading.Lock()

    def record(self, stage: int, attempt: int) -> None:
        with self.lock:
            key = (stage, attempt)
            if key in self.counts or len(self.counts) < self.most:
                self.counts[key] = self.counts.get(key, 0) + 1

    def drain(self, stage: int, attempt: int) -> int:
        """The count, forgotten as it is given."""
        with self.lock:
            return self.counts.pop((stage, attempt), 0)

    def __len__(self) -> int:
        return len(self.counts)
