"""The sequence store: chunks of a batch go to the served state and, if wanted, to an archive."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from rivulet.operators.samples import merge_chunks, to_chunks
from rivulet.streaming.engine import Commits, Ledger, Sink


def sequence_sink(name: str, ledger: Ledger, most: int, archive: Commits | None = None) -> Sink:
    """A sink of sequence rows: packed once, merged into the ledger's state (the newest `most` rows of a key), and kept in the archive.

    A retried batch changes neither.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        chunks = to_chunks(rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ledger.apply(name, batch_id, lambda old: merge_chunks(chunks.limit(0) if old is None else old, chunks, most))
            if archive is not None:
                archive.write(f"{name}/batch={batch_id:012d}", chunks, ["bucket"])
        finally:
            chunks.unpersist()

    return Sink(name, write)
