"""SimHash near-duplicates by pigeonring filtering.

The 64 bits of a fingerprint form a ring of LIMIT + 1 segments. If two
fingerprints differ in LIMIT bits or fewer, some segment starts a chain in which
the first l consecutive segments differ, together, in no more than
l * LIMIT / (LIMIT + 1) bits, for every l: no bits in the first, one in the first
two, two in the first three and so on. The index holds a fingerprint under each
start: the first segment as it is, and the next two cut into three parts, of
which, with two bits to spend, at least one is as it is. Pairs that share a key are held to the budgets of the chain,
one segment at a time, before all bits are counted.

Fingerprints are indexed once each, however many documents have them. A bucket
gives no pairs, only the edges that join its members to the smallest id they
reach there; buckets of over BUCKET members are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, private, shuffle_partitions
from rivulet.llm.components import connected_components

WORDS, SEED, LIMIT = 4, 42, 4
#: Members of a bucket that one task compares at a time.
BUCKET = 4096
#: Shingles hashed at a time; bounds memory for long texts.
_BLOCK = 1 << 17


def shingle_hashes(parts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a word sequence, repeats included, in blocks; no words: nothing."""
    n = max(1, len(parts) - words + 1) if parts else 0
    for i in range(0, n, _BLOCK):
        block = parts[i : min(i + _BLOCK, n) + words - 1]
        joined = b" ".join(block)
        ends = np.cumsum([len(p) + 1 for p in block]) - 1
        first = [0, *(ends[:-1] + 1).tolist()]
        last = ends[min(words, len(block)) - 1 :].tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=False)], dtype="<u8")


def split_words(data: bytes | None) -> list[bytes]:
    # bytes.lower and bytes.split know just A-Z and the six ASCII blanks
    return (data or b"").lower().split()


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit, the lowest first."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(split_words(data), words):
        ones += bit_counts(h)
        n += len(h)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fingerprint) of every row; the 64 bits as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(got.view(np.int64))], ["key", "print"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "key bigint, print bigint")


def _ring(limit: int) -> tuple[list[int], list[int]]:
    """Widths and offsets, from the top, of limit + 1 segments."""
    m = limit + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return widths, [sum(widths[:i]) for i in range(m)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else x << np.uint64(by) | x >> np.uint64(64 - by)


def index_keys(prints: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The bucket numbers of each fingerprint, a row each: per start of a chain and part of it."""
    widths, offsets = _ring(limit)
    m = limit + 1
    chain = min(3, m)
    out = []
    for i in range(m):
        x = _turned(prints, offsets[i])
        head = x >> np.uint64(64 - widths[i])
        rest = sum(widths[(i + j) % m] for j in range(1, chain))
        at = widths[i]
        for p in range(chain):
            w = rest // chain + (p < rest % chain)
            part = x >> np.uint64(64 - at - w) & np.uint64((1 << w) - 1)
            out.append((head << np.uint64(w) | part) * np.uint64(m * chain) + np.uint64(i * chain + p))
            at += w
    return np.stack(out, axis=1).view(np.int64)


def _linked(x: np.ndarray, y: np.ndarray, start: np.ndarray | int, limit: int) -> np.ndarray:
    """Pairs that keep the budgets of the chain from their start on, and the limit over all bits."""
    widths, offsets = _ring(limit)
    m = limit + 1
    diff = x ^ y
    ok = np.ones(diff.shape, bool)
    spent = np.zeros(diff.shape, np.uint8)
    for step in range(m):
        if step == m - 1:
            return ok & (np.bitwise_count(diff) <= limit)
        seg = (np.asarray(start) + step) % m
        shift = np.array([64 - offsets[i] - widths[i] for i in range(m)], np.uint64)[seg]
        mask = np.array([(1 << widths[i]) - 1 for i in range(m)], np.uint64)[seg]
        spent = spent + np.bitwise_count(diff >> shift & mask)
        ok &= spent <= (step + 1) * limit // m
        if not ok.any():
            return ok
    return ok


def _star(prints: np.ndarray, ids: np.ndarray, start: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges from the members of one bucket to the smallest id that each reaches through links in it."""
    order = np.argsort(ids, kind="stable")
    prints, ids = prints[order], ids[order]
    left = np.arange(len(ids))
    while len(left):
        # breadth first from the smallest id left; what is reached is not looked at again
        reached, edge, left = left[:1], left[:1], left[1:]
        while len(edge) and len(left):
            hit = np.zeros(len(left), bool)
            for k in edge.tolist():
                open_ = np.flatnonzero(~hit)
                hit[open_[_linked(prints[left[open_]], prints[k], start, limit)]] = True
            edge, left = left[hit], left[~hit]
            reached = np.concatenate([reached, edge])
        if len(reached) > 1:
            yield ids[reached[1:]], np.full(len(reached) - 1, ids[reached[0]])


def _bucket_edges(bucket: np.ndarray, prints: np.ndarray, ids: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole buckets that stand one after the other. bucket: (number, start of its chain)."""
    number, start = bucket
    new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    size = np.diff(np.append(new, len(number)))
    # small ones all at once, by distance within the bucket
    at = np.repeat(size <= 8, size)
    for d in range(1, 8):
        a = np.flatnonzero(at[:-d] & (number[:-d] == number[d:])) if d < len(number) else np.empty(0, int)
        a = a[_linked(prints[a], prints[a + d], start[a], limit)] if len(a) else a
        if not len(a) and not (size > d).any():
            break
        yield ids[a], ids[a + d]
    for b, n in zip(new[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        yield from _star(prints[b : b + n], ids[b : b + n], int(start[b]), limit)


def links(reps: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between ids of different fingerprints; their components are those of all links.

    reps: (id, print), one row a fingerprint.
    """
    spark = reps.sparkSession
    if limit < 1:
        return reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    m, chain = limit + 1, min(3, limit + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = index_keys(batch["print"].to_numpy().view(np.uint64), limit)
            n = k.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(batch["id"].to_numpy(), n)), pa.array(np.repeat(batch["print"].to_numpy(), n))], ["bucket", "id", "print"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            number = cols[0]
            for a, b in _bucket_edges((cols[3], number % (m * chain) // chain), cols[2].view(np.uint64), cols[1], limit):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            # a bucket and a pair of its blocks, as one number that changes where either does
            cols = [batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "id", "print", "pair")]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            both = cols[0], cols[3]
            last = np.flatnonzero((both[0] != both[0][-1]) | (both[1] != both[1][-1]))
            n = last[-1] + 1 if len(last) else 0
            held = [c[n:] for c in cols]
            if n:
                yield from out(_numbered([c[:n] for c in cols]))
        if held is not None and len(held[0]):
            yield from out(_numbered(held))

    keyed = reps.mapInArrow(keys, "bucket bigint, id bigint, print bigint")
    many = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
    many = cut(many.select("bucket", F.ceil(F.col("n") / bucket).cast("int").alias("blocks")))
    if many.isEmpty():
        rows = keyed.withColumn("pair", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("long")
        pair = lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(j.cast("long")))
        rows = keyed.join(many, "bucket", "left").select("bucket", "id", "print", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"))
    rows = rows.repartition(shuffle_partitions(spark), "bucket", "pair").sortWithinPartitions("bucket", "pair")
    return rows.mapInArrow(edges, "a bigint, b bigint").distinct()


def _numbered(cols: list[np.ndarray]) -> list[np.ndarray]:
    """The last column becomes a running number of (bucket, pair)."""
    new = np.ones(len(cols[0]), np.int64)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[3][1:] != cols[3][:-1])
    return [*cols[:3], np.cumsum(new)]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(key, print, component): fingerprint and the smallest key reachable over links, itself included.

    Fingerprints link at `limit` or fewer differing bits; equal ones always do,
    that of texts without words too. Every row of docs gives a row, repeated
    keys included. Rows with a null key have a fingerprint and the component of
    that fingerprint, null if no other row has it; they carry no links.
    """
    prints = cut(fingerprints(docs, key, text, words))
    reps = cut(prints.filter("key IS NOT NULL").groupBy("print").agg(F.min("key").alias("id")).select("id", "print"))
    # a key that repeats with different texts names several fingerprints: it joins them
    found = connected_components(links(reps, limit, bucket))
    root = reps.join(found, reps["id"] == found["node"], "left").select("print", F.coalesce("root", "id").alias("component"))
    return prints.join(root, "print", "left").select(F.col("key").alias(key), "print", "component")


def hex_print(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
