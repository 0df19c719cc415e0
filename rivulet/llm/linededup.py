"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII blanks at its ends and with A-Z
lower-cased; shards are the key's hash modulo their number, which follows the
number of repeated keys. The exact table counts, for each key of LENGTH code
points or more, the documents that hold it and names the largest. Keys that reach
COPIES documents are repeated, and each shard has a cuckoo filter of its repeated
keys. A document's lines are put to the filters; the few that pass are put to the
exact table, so a false positive costs a lookup and no line. Filters of up to
FILTER_BYTES in all are broadcast; beyond that they stay where their shards are,
and the lines' keys are dealt out to them in one shuffle.

New and deleted documents change the counts by addition. Keys that reach COPIES go into
their shard's filter, keys that fall below leave it (a cuckoo filter can forget),
so deleting what was inserted restores the earlier decisions. Only the filters of
shards with such keys are opened. Where a deleted document was the largest holder
of a key that others still hold, those are read for the next; keys of theirs that
aren't in question go no further than a filter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, let, private, shuffle_partitions

LENGTH, COPIES = 20, 3
#: Shards at least, and keys of a shard at most, on average (about 250 KB of filter).
SHARDS, SHARD_KEYS = 64, 100_000
#: Bytes of filters that are broadcast, at most.
FILTER_BYTES = 64 << 20
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int = LENGTH) -> bytes | None:
    """The key's 128-bit hash; None if the key is too short."""
    k = line.strip(_BLANKS).lower()
    if len(k) < least or (len(k) < 4 * least and len(k.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(k)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each may sit in either of two buckets.

    A number that finds no place makes the table twice as large, built anew from
    the fingerprints' full hashes, which the caller keeps (the exact table).
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 16, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        """All at once: in each turn every number without a place tries one of its buckets, and of those that find it full one kicks."""
        buckets = 16
        while buckets * cls.SLOTS * 0.85 < len(hashes):
            buckets *= 2
        while True:
            out = cls(buckets)
            prints = cls.prints(hashes)
            at = hashes & np.uint64(buckets - 1)
            for turn in range(cls.KICKS):
                order = np.argsort(at, kind="stable")
                prints, at = prints[order], at[order]
                new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
                full = (out.table != 0).sum(axis=1)[at]
                fits = full + rank < cls.SLOTS
                out.table[at[fits], (full + rank)[fits]] = prints[fits]
                left, kicks = ~fits, (full + rank == cls.SLOTS) & (turn > 0)
                if not left.any():
                    return out
                # the first that is too many in a bucket takes another's slot; the others, and who was there, try their second bucket
                slot = turn % cls.SLOTS
                gone = out.table[at[kicks], slot].copy()
                out.table[at[kicks], slot] = prints[kicks]
                prints[kicks] = gone
                prints, at = prints[left], at[left]
                at = cls.other(at, prints, np.uint64(buckets))
            buckets *= 2

    @staticmethod
    def prints(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def other(bucket, prints, buckets):
        """The second bucket; from it, the same step leads back."""
        return bucket ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & (np.asarray(buckets, np.uint64) - np.uint64(1)))

    def _places(self, h: int) -> tuple[int, int, int]:
        x = np.array([h], np.uint64)
        p = self.prints(x)
        a = x & np.uint64(self.buckets - 1)
        return int(p[0]), int(a[0]), int(self.other(a, p, self.buckets)[0])

    def add(self, h: int) -> bool:
        p, a, b = self._places(h)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        at, saved = b, self.table.copy()
        for kick in range(self.KICKS):
            slot = (p + kick) % self.SLOTS
            p, self.table[at, slot] = int(self.table[at, slot]), p
            at = int(self.other(np.array([at], np.uint64), np.array([p], np.uint16), self.buckets)[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        self.table = saved
        return False

    def remove(self, h: int) -> bool:
        """Only for what was added."""
        p, a, b = self._places(h)
        for at in (a, b):
            there = np.flatnonzero(self.table[at] == p)
            if len(there):
                self.table[at, there[0]] = 0
                return True
        return False

    def __contains__(self, h: int) -> bool:
        p, a, b = self._places(h)
        return p in self.table[a] or p in self.table[b]

    def dump(self) -> bytes:
        return struct.pack("<I", self.buckets) + self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        n = struct.unpack_from("<I", data)[0]
        return cls(n, np.frombuffer(data, np.uint16, offset=4).reshape(n, cls.SLOTS).copy())


class FilterSet:
    """Filters of several shards, asked all at once."""

    def __init__(self, dumps: dict[int, bytes], shards: int):
        filters = {s: CuckooFilter.load(d) for s, d in dumps.items()}
        self.size = np.zeros(shards, np.uint64)
        self.first = np.zeros(shards, np.uint64)
        at = 0
        for s in sorted(filters):
            self.size[s], self.first[s] = filters[s].buckets, at
            at += filters[s].buckets
        self.table = np.concatenate([filters[s].table for s in sorted(filters)]) if filters else np.zeros((1, CuckooFilter.SLOTS), np.uint16)

    def contains(self, hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
        n = self.size[shard]
        p = CuckooFilter.prints(hashes)
        a = hashes & (np.maximum(n, 1) - np.uint64(1))
        b = CuckooFilter.other(a, p, np.maximum(n, 1))
        at = lambda x: (self.table[self.first[shard] + x] == p[:, None]).any(axis=1)
        return (n > 0) & (at(a) | at(b))


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("own"), F.col(text).cast("binary").alias("text"))


def _shard(hi: str, shards: int) -> Column:
    return F.pmod(F.col(hi), F.lit(shards)).cast("int")


def references(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LENGTH) -> DataFrame:
    """The exact table (hi, lo, refs, last): per line key, documents that hold it and the largest key among them.

    A row of docs is a document. Each batch is counted before anything is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list] = {}
            for k, t in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                for h in {line_key(x, least) for x in _lines(t.as_py())} - {None}:
                    if (old := seen.get(h)) is None:
                        seen[h] = [1, k]
                    else:
                        old[0] += 1
                        if old[1] is None or (k is not None and k > old[1]):
                            old[1] = k
            h = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["hi", "lo", "refs", "last"]
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "hi bigint, lo bigint, refs bigint, last bigint").groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.max("last").alias("last"))


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of the keys (hi, lo) of repeated."""

    def run(part) -> Iterator:
        import pandas as pd

        return pd.DataFrame({"shard": part["shard"].iloc[:1], "filter": [CuckooFilter.build(part["lo"].to_numpy().view(np.uint64)).dump()]})

    return repeated.select(_shard("hi", shards).alias("shard"), "lo").groupBy("shard").applyInPandas(run, "shard int, filter binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, now: DataFrame, shards: int) -> DataFrame:
    """filters after keys (hi, lo) came and went. Only shards with such keys are opened; one without room is built anew from its keys in now."""

    def run(key, old, changes):
        import pandas as pd

        f = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter()
        lo, comes = changes["lo"].to_numpy().view(np.uint64), changes["comes"].to_numpy()
        for h in lo[~comes].tolist():
            f.remove(int(h))
        full = not all(f.add(int(h)) for h in lo[comes].tolist())
        return pd.DataFrame({"shard": [key[0]], "filter": [None if full else f.dump()]})

    of = lambda df, comes: df.select(_shard("hi", shards).alias("shard"), "lo", F.lit(comes).alias("comes"))
    changes = cut(of(removed, False).unionByName(of(added, True)))
    touched = changes.select("shard").distinct()
    opened = cut(filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, "shard int, filter binary"))
    full = opened.filter("filter IS NULL").select("shard")
    anew = build_filters(now.withColumn("shard", _shard("hi", shards)).join(full, "shard", "left_semi").select("hi", "lo"), shards)
    return filters.join(touched, "shard", "left_anti").unionByName(opened.filter("filter IS NOT NULL")).unionByName(anew)


def _keys_of(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, line, the two halves of the key's hash) of every line with a key."""
    found: list[tuple[int, int, bytes]] = []
    for d, t in enumerate(batch["text"]):
        found += [(d, i, h) for i, x in enumerate(_lines(t.as_py())) if (h := line_key(x, least))]
    h = np.frombuffer(b"".join(f[2] for f in found), "<i8").reshape(-1, 2)
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int32), h


def put_to_filters(docs: DataFrame, filters: DataFrame, shards: int, least: int = LENGTH, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(key, own, line, hi, lo) of the lines of docs (key, own, text as bytes) that pass the filter of their shard.

    Filters of over most_bytes in all aren't broadcast: each is sent once to every
    lane of its shard, ahead of the lines' keys that are dealt there.
    """
    spark = docs.sparkSession
    schema = "key bigint, own bigint, line int, hi bigint, lo bigint"
    names = ["key", "own", "line", "hi", "lo"]
    if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= most_bytes:
        sent = spark.sparkContext.broadcast(FilterSet({r["shard"]: bytes(r["filter"]) for r in filters.collect()}, shards))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, line, h = _keys_of(batch, least)
                hit = sent.value.contains(h[:, 1].copy().view(np.uint64), np.mod(h[:, 0], shards))
                yield pa.RecordBatch.from_arrays([*[batch[c].take(pa.array(row[hit])) for c in ("key", "own")], pa.array(line[hit]), pa.array(h[hit, 0]), pa.array(h[hit, 1])], names)

        return docs.mapInArrow(run, schema)

    lanes = max(1, -(-4 * shuffle_partitions(spark) // shards))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, line, h = _keys_of(batch, least)
            lane = np.mod(h[:, 0], shards) * lanes + np.mod(row, lanes)
            yield pa.RecordBatch.from_arrays([pa.array(lane), *[batch[c].take(pa.array(row)) for c in ("key", "own")], pa.array(line), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["lane", *names])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, f = None, None
        for batch in batches:
            at = batch["lane"].to_numpy()
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]), strict=True):
                if b > a and at[a] != lane:
                    # a lane's filter stands ahead of its keys
                    data = batch["filter"][a].as_py()
                    lane, f = at[a], None if data is None else FilterSet({0: data}, 1)
                if f is not None and b > a:
                    lo, there = batch["lo"].slice(a, b - a), pa.compute.is_valid(batch["line"].slice(a, b - a))
                    hit = f.contains(lo.fill_null(0).to_numpy().view(np.uint64), np.zeros(b - a, np.int64)) & there.to_numpy(zero_copy_only=False)
                    yield batch.slice(a, b - a).select(names).filter(pa.array(hit))

    asked = docs.mapInArrow(keys, f"lane bigint, {schema}").withColumn("filter", F.lit(None).cast("binary"))
    null = lambda kind: F.lit(None).cast(kind)
    each = filters.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: (F.col("shard") * lanes + i).cast("long"))).alias("lane"), null("bigint").alias("key"), null("bigint").alias("own"), null("int").alias("line"), null("bigint").alias("hi"), null("bigint").alias("lo"), "filter")
    dealt = each.unionByName(asked).repartition(max(shuffle_partitions(spark), shards), "lane").sortWithinPartitions("lane", F.col("filter").isNull())
    return dealt.mapInArrow(ask, schema)


@dataclass
class LineIndex:
    """The exact table of all keys, its repeated part, and the filters of that part."""

    counts: DataFrame
    repeated: DataFrame
    filters: DataFrame
    copies: int
    least: int
    shards: int

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", text: str = "text", copies: int = COPIES, least: int = LENGTH, shards: int | None = None) -> LineIndex:
        """The index of docs. shards: as many as the repeated keys ask for, if not given."""
        counts = references(docs, key, text, least)
        repeated = cut(counts.filter(F.col("refs") >= copies))
        shards = shards or max(SHARDS, -(-repeated.count() // SHARD_KEYS))
        return LineIndex(counts, repeated, cut(build_filters(repeated, shards)), copies, least, shards)

    def changed(self, inserted: DataFrame | None = None, deleted: DataFrame | None = None, held: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The index after whole documents came and went.

        held: the documents that stay; only read if a deleted document was the
        largest holder of a key that is still held, to find the next. The table of
        counts is taken over by addition; filters that no key enters or leaves
        stay as they are.
        """
        counts = self.counts
        if inserted is not None:
            counts = counts.unionByName(references(inserted, key, text, self.least)).groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.max("last").alias("last"))
        if deleted is not None:
            if held is None:
                raise ValueError("deletion needs the documents that stay")
            gone = references(deleted, key, text, self.least).select("hi", "lo", F.col("refs").alias("r"), F.col("last").alias("g"))
            left = counts.join(gone, ["hi", "lo"], "left")
            left = cut(left.select("hi", "lo", (F.col("refs") - F.coalesce("r", F.lit(0))).alias("refs"), "last", (F.col("r").isNotNull() & F.col("g").eqNullSafe(F.col("last"))).alias("lost")).filter("refs > 0"))
            lost = cut(left.filter("lost").select("hi", "lo"))
            if not lost.isEmpty():
                shards = max(SHARDS, -(-lost.count() // SHARD_KEYS))
                hits = put_to_filters(_rows(held, key, text), cut(build_filters(lost, shards)), shards, self.least)
                next_ = hits.join(lost, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("key").alias("next"))
                left = left.join(next_, ["hi", "lo"], "left").withColumn("last", F.when(F.col("lost"), F.col("next")).otherwise(F.col("last")))
            counts = left.select("hi", "lo", "refs", "last")
        counts = cut(counts)
        repeated = counts.filter(F.col("refs") >= self.copies)
        added = repeated.join(self.repeated, ["hi", "lo"], "left_anti")
        removed = self.repeated.join(repeated, ["hi", "lo"], "left_anti")
        return LineIndex(counts, repeated, cut(update_filters(self.filters, added, removed, repeated, self.shards)), self.copies, self.least, self.shards)

    def candidates(self, docs: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = FILTER_BYTES) -> DataFrame:
        """(key, own, line, hi, lo): the lines of documents whose keys pass the filters; own is the hash of the text."""
        return put_to_filters(_rows(docs, key, text), self.filters, self.shards, self.least, most_bytes)

    def dedup(self, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "kept", most_bytes: int = FILTER_BYTES) -> DataFrame:
        """docs with n_lines, n_dropped and the text that is left in column `name`.

        A repeated key loses all its lines but those of its largest holder.
        Null and empty texts are one empty line, so kept is never null. Rows
        that share a key are holders each, and lose their own lines alike; rows
        with a null key lose none, but count as holders. Columns of docs called like a
        new one are replaced, others kept whatever their names; an empty table
        gives an empty one.
        """
        p = private(docs)
        exact = self.repeated.select("hi", "lo", "last")
        hits = self.candidates(docs, key, text, most_bytes).join(exact, ["hi", "lo"]).filter(F.col("key") != F.col("last"))
        drops = hits.groupBy(F.col("key").alias(f"{p}key"), F.col("own").alias(f"{p}own")).agg(F.collect_set("line").alias(f"{p}drops"))
        new = ["n_lines", "n_dropped", name]
        rows = docs.join(drops, (F.col(key).cast("long") == F.col(f"{p}key")) & (F.xxhash64(text) == F.col(f"{p}own")), "left")
        whole = F.coalesce(F.col(text), F.lit(""))
        drop = F.coalesce(F.col(f"{p}drops"), F.array().cast("array<int>"))

        def cut_lines(lines: Column) -> Column:
            # with its number in front a line is one of a kind: the difference of two arrays goes by hash, once over each
            tell = lambda i, x: F.concat(F.lpad(i.cast("string"), 10, "0"), x)
            gone = F.transform(drop, lambda i: tell(i, F.get(lines, i)))
            left = F.array_except(F.transform(lines, lambda x, i: tell(i, x)), F.filter(gone, lambda x: x.isNotNull()))
            kept = F.when(F.size(drop) == 0, whole).otherwise(F.array_join(F.transform(left, lambda x: x.substr(F.lit(11), F.length(x))), "\n"))
            return F.struct(F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))

        rows = rows.withColumn(f"{p}cut", let(F.split(whole, "\n", -1), cut_lines))
        kept = [c for c in docs.columns if c.lower() not in [n.lower() for n in new] or c in (key, text) and c != name]
        return rows.select(*[F.col(c) for c in kept], F.col(f"{p}cut.n_lines").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"), F.col(f"{p}cut.kept").alias(name))
