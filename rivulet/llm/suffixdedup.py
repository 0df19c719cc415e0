"""Removal of repeated passages by sorted suffixes.

A byte goes if a string of SPAN bytes around it also starts earlier (in a smaller
key, or in the same text before). To find such strings without sorting every
suffix of the corpus:

1. Each window of SPAN bytes has an anchor, the least hash of its GRAM-byte
   grams (the leftmost of equal ones). It depends on the window's bytes alone,
   so equal windows share it at the same place. The windows of one anchor stand
   in a row and make up a block. Anchors are dealt out by hash; an anchor met
   once needs no more work, and of blocks met again, bytes and all, only the
   first can be an original.
2. What is left are anchors with blocks that differ: the edges of repeated
   passages. Their bytes are fetched, again dealt out by anchor, and the suffixes
   that start their windows are sorted deep-shallow: a multikey sort to SHALLOW
   bytes, then, in groups that share those, blind tries. Equal neighbours over
   SPAN bytes are equal windows; all but the first are repeats.
3. The repeats' bytes are cut from their documents.

Anchors that stand in many differing surroundings are spread in both steps. In
the first, those that are frequent in a small part of the documents, drawn by
hash, are dealt out by block: this only says where rows go, never what is
found. In the second, an anchor with over HEAVY different blocks is dealt out by
the hashes of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, private, shuffle_partitions

SPAN, GRAM, SHALLOW = 100, 32, 56
HEAVY = 1_000
#: One document in so many is looked at for frequent anchors, and the blocks there from which an anchor is frequent (and how many at most).
LOOK, FREQUENT, MOST_FREQUENT = 128, 200, 20_000
#: Window starts of a text handled at a time; under 2^24.
_BLOCK = 1 << 21
#: Blocks whose suffixes are sorted at a time.
_SORTED = 8192
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes in a row."""
    n = len(data) - 7
    h = np.empty(n, np.uint64)
    for s in range(8):
        part = data[s : s + (len(data) - s) // 8 * 8].view("<u8")
        h[s::8] = part[: len(h[s::8])]
    for step in (8, 16):
        h = (h[:-step] * _A + h[step:]) * _B
        h ^= h >> np.uint64(29)
    return h


def blocks(data: bytes, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, windows, anchor's place from the first window) of each block of a text."""
    raw = np.frombuffer(data, np.uint8)
    width = span - GRAM + 1
    for at in range(0, len(raw) - span + 1, _BLOCK):
        h = _gram_hashes(np.ascontiguousarray(raw[at : at + _BLOCK + span - 1]))
        low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        yield h[anchor[first]], first + at, np.diff(np.append(first, len(anchor))), anchor[first] - first


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal runs in order."""
    if not len(start):
        return start, stop
    order = np.lexsort((stop, start))
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


class BlindTrie:
    """Strings of one length, in order; a node knows where its strings part, not what they share."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, s: bytes, mark: int) -> None:
        """A leaf is [None, string, marks]; a node is [place, {byte: child}]."""
        if self.root is None:
            self.root = [None, s, [mark]]
            return
        node = self.root
        while node[0] is not None:  # blindly down: bytes between the places aren't looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf = node
        if leaf[1] == s:
            leaf[2].append(mark)
            return
        lo, hi = 0, len(s)
        while hi - lo > 1:  # the first byte that differs from the leaf's
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if leaf[1][:mid] == s[:mid] else (lo, mid)
        at, parent, node = lo, None, self.root
        while node[0] is not None and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == at:
            node[1][s[at]] = [None, s, [mark]]
            return
        split = [at, {leaf[1][at]: node, s[at]: [None, s, [mark]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def ordered(self) -> Iterator[list[int]]:
        """The marks of equal strings, the strings ascending."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow(data: np.ndarray, at: np.ndarray, span: int = SPAN, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data that start at `at`, sorted over span bytes: their order, and a number each that equal ones share.

    data must go on for span bytes behind each of them. Equal ones keep their
    order in `at`.
    """
    n = len(at)
    shallow = min(shallow, span) // 8 * 8
    rank = np.zeros(n, np.int64)  # place of the first of those that are equal so far
    order = np.arange(n)
    todo = order
    for depth in range(0, shallow, 8):
        # one turn of the multikey sort, over characters of eight bytes, in all groups that are still open
        words = np.zeros(len(todo), np.uint64)
        for b in range(8):
            words = words << np.uint64(8) | data[at[todo] + depth + b]
        mine = np.lexsort((words, rank[todo]))
        todo, words = todo[mine], words[mine]
        group = rank[todo]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (words[1:] != words[:-1])])
        first_of_group = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(todo)), 0))
        place = group + np.arange(len(todo)) - first_of_group
        rank[todo] = np.maximum.accumulate(np.where(new, place, -1))
        size = np.diff(np.append(np.flatnonzero(new), len(todo)))
        todo = todo[np.repeat(size > 1, size)]
        if not len(todo):
            break
    if len(todo) and shallow < span:
        group = rank[todo]
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        tail = data[at[todo][:, None] + np.arange(shallow, span)]
        head = np.repeat(new, np.diff(np.append(new, len(todo))))
        mixed = np.logical_or.reduceat((tail != tail[head]).any(axis=1), new)
        for b, e in zip(new[mixed].tolist(), np.append(new[1:], len(todo))[mixed].tolist(), strict=True):
            trie = BlindTrie()
            for k in range(b, e):
                trie.add(tail[k].tobytes(), k)
            place = int(group[b])
            for marks in trie.ordered():
                rank[todo[marks]] = place
                place += len(marks)
    return np.lexsort((np.arange(n), rank)), rank


def _repeats(doc: np.ndarray, start: np.ndarray, count: np.ndarray, data: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, window in it, first) of all windows that are equal to an earlier one; rows are in order of document and start."""
    base = np.cumsum([0, *map(len, data)])[:-1]
    block = np.repeat(np.arange(len(data)), count)
    within = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    order, rank = deep_shallow(np.frombuffer(b"".join(data), np.uint8), base[block] + within, span)
    d, s = doc[block[order]], start[block[order]] + within[order]
    group = rank[order]
    # the sort is stable only within rows; the earliest of a group is found by document and start
    again = np.lexsort((s, d, group))
    order, group, d, s = order[again], group[again], d[again], s[again]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = ~new & ((d != d[head]) | (s != s[head]))
    return block[order[later]], within[order[later]], order[new]


def _frequent(whole: DataFrame, span: int, look: int = LOOK, least: int = FREQUENT) -> np.ndarray:
    """Anchors with `least` or more different blocks in one of `look` documents (key, text); the most frequent first, at most MOST_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for t in batch["text"]:
                raw = t.as_py()
                for anchor, first, count, off in blocks(raw, span):
                    ends = (first + count + span - 1).tolist()
                    seen.update((a, xxhash.xxh3_64_intdigest(raw[x:y], o) >> 1) for a, x, y, o in zip(anchor.view(np.int64).tolist(), first.tolist(), ends, off.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in seen], pa.int64()), pa.array([s[1] for s in seen], pa.int64())], ["anchor", "block"])

    some = whole.filter(F.pmod(F.xxhash64("key"), F.lit(look)) == 0).select("text").mapInArrow(run, "anchor bigint, block bigint")
    found = some.distinct().groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(MOST_FREQUENT)
    return np.sort(np.array([r["anchor"] for r in found.collect()], np.int64))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, heavy: int = HEAVY) -> DataFrame:
    """(key, start, stop): stretches of bytes to remove, not merged; keys must not be null."""
    spark = docs.sparkSession
    if span < GRAM + 8:
        raise ValueError(f"span must be {GRAM + 8} or more")
    whole = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).filter(F.col("key").isNotNull() & (F.octet_length("text") >= span))
    shape = "kind int, lane bigint, anchor bigint, block bigint, key bigint, at bigint, more int"
    names = ["kind", "lane", "anchor", "block", "key", "at", "more"]
    hot = spark.sparkContext.broadcast(_frequent(whole, span))

    def batch_of(kind: int, anchor, block, doc, at, more) -> pa.RecordBatch:
        n = len(doc)
        # a frequent anchor is dealt out by block
        lane = np.where(np.isin(anchor, hot.value), anchor ^ block, anchor) if len(hot.value) else anchor
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in (lane, anchor, block, doc, at)], pa.array(np.ascontiguousarray(more, np.int32))], names)

    def spans_of(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stretches, merged within each document, as rows that go by their document."""
        if len(doc):
            order = np.argsort(doc, kind="stable")
            doc, start, stop = doc[order], start[order], stop[order]
            new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            got = [(doc[a], *merged(start[a:b], stop[a:b])) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True)]
            d = np.concatenate([np.full(len(s), k) for k, s, _ in got])
            s, e = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
            # a stretch of over 2^31 bytes is told in pieces
            while len(d):
                step = np.minimum(e - s, 1 << 30)
                yield batch_of(1, d * np.int64(31) + 7, s * 0, d, s, step)
                left = e - s > step
                d, s, e = d[left], (s + step)[left], e[left]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[tuple] = []
            for k, t in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                raw = t.as_py()
                for anchor, first, count, off in blocks(raw, span):
                    digest = xxhash.xxh3_64_intdigest
                    ends = (first + count + span - 1).tolist()
                    hashes = [digest(raw[a:b], o) for a, b, o in zip(first.tolist(), ends, off.tolist(), strict=True)]
                    cols.append((anchor.view(np.int64), np.array(hashes, np.uint64).view(np.int64), np.full(len(first), k), first, count << 8 | off))
            if not cols:
                continue
            anchor, block, doc, at, more = (np.concatenate(c) for c in zip(*cols, strict=True))
            order = np.lexsort((at, doc, block, anchor))
            anchor, block, doc, at, more = (c[order] for c in (anchor, block, doc, at, more))
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
            yield batch_of(0, anchor[new], block[new], doc[new], at[new], more[new])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & ((doc != doc[head]) | (at != at[head]))
            yield from spans_of(doc[again], at[again], at[again] + (more[again] >> 8) + span - 1)

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of blocks met again, and the first of each block of anchors with several."""
        last = None  # the row before, and the place of its block's first
        open_ = None  # the first row of the anchor's group, as long as it has one block
        for batch in batches:
            kind = batch["kind"].to_numpy()
            passed = kind == 1
            if passed.any():
                yield batch.filter(pa.array(passed))
            anchor, block, doc, at, more = (batch[c].to_numpy()[~passed] for c in ("anchor", "block", "key", "at", "more"))
            if not len(anchor):
                continue
            new_a = np.concatenate([[last is None or anchor[0] != last[0]], anchor[1:] != anchor[:-1]])
            new_b = new_a | np.concatenate([[last is None or block[0] != last[1]], block[1:] != block[:-1]])
            same = np.concatenate([[last is not None and doc[0] == last[2] and at[0] == last[3]], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
            again = ~new_b & ~same
            yield from spans_of(doc[again], at[again], at[again] + (more[again] >> 8) + span - 1)
            group = np.cumsum(new_a)
            blocks_in = np.bincount(group, new_b, group[-1] + 1)
            first = np.flatnonzero(new_b)
            # group 0 goes on from the batch before: each new block in it is one more than one; other blocks of a frequent anchor are elsewhere
            wanted = first[(blocks_in[group[first]] > 1) | (group[first] == 0) | np.isin(anchor[first], hot.value)]
            if open_ is not None and blocks_in[0] > 0:
                yield batch_of(0, *[np.array([x], np.int64) for x in open_])
                open_ = None
            elif group[-1] > 0:
                open_ = None
            yield batch_of(0, anchor[wanted], block[wanted], doc[wanted], at[wanted], more[wanted])
            if group[-1] > 0 and blocks_in[group[-1]] == 1:
                k = first[-1]
                open_ = (anchor[k], block[k], doc[k], at[k], more[k])
            last = (anchor[-1], block[-1], doc[-1], at[-1])

    dealt = whole.mapInArrow(anchors, shape).repartition(shuffle_partitions(spark), "lane").sortWithinPartitions("kind", "anchor", "block", "key", "at")
    found = cut(dealt.mapInArrow(differing, shape))
    asked = found.filter("kind = 0").select("anchor", "key", "at", "more").distinct()
    many = cut(asked.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("anchor", F.lit(True).alias("heavy")))
    if many.isEmpty():
        asked = asked.withColumn("heavy", F.lit(False))
    else:
        asked = asked.join(many, "anchor", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("at", "anchor", "more", "heavy")).alias("asked")).withColumnRenamed("key", "k")
    near = _only(whole, "key", asked.select("k"), "k").join(asked, F.col("key") == F.col("k")).select("key", "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "key", "at", "count", "data"]
        for batch in batches:
            for k, t, rows in zip(batch["key"].to_pylist(), batch["text"], batch["asked"], strict=True):
                raw, out = t.as_py(), []
                r = rows.values
                for at, anchor, more, heavy_ in zip(*(r.field(c).to_pylist() for c in ("at", "anchor", "more", "heavy")), strict=True):
                    if heavy_:
                        # dealt out by window
                        for s in range(at, at + (more >> 8)):
                            w = raw[s : s + span]
                            out.append((np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64), s, 1, w))
                    else:
                        out.append((anchor, at, more >> 8, raw[at : at + (more >> 8) + span - 1]))
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array([k] * len(out), pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def look(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
            doc, at, count = (t[c].to_numpy() for c in ("key", "at", "count"))
            block, within, firsts = _repeats(doc, at, count, t["data"].to_pylist(), span)
            order = np.lexsort((within, block))
            b, w = block[order], within[order]
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1] + 1)]) if len(b) else np.zeros(0, bool)
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(b)) - 1
            out = pa.RecordBatch.from_arrays([pa.array(doc[b[lo]]), pa.array(at[b[lo]] + w[lo]), pa.array(at[b[lo]] + w[hi if len(lo) else lo] + span)], ["key", "start", "stop"])
            return out, t.take(pa.array(firsts)) if (count == 1).all() else t.slice(0, 0)

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            anchor = t["anchor"].to_numpy()
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            for a, b in _chunks([0, *ends.tolist(), *([len(anchor)] if final else [])]):
                yield look(t.slice(a, b - a))[0]
            rest = t.slice(0 if final or not len(ends) else ends[-1])
            if not final and rest.num_rows > _SORTED and (rest["count"].to_numpy() == 1).all():
                # one window's hash, and very many of it: the first of each is all that later ones need
                out, rest = look(rest)
                yield out
            held = [] if final else rest.combine_chunks().to_batches()

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > _SORTED:
                yield from flush(False)
                size = 0
        if held:
            yield from flush(True)

    dealt = near.mapInArrow(fetch, "anchor bigint, key bigint, at bigint, count int, data binary")
    dealt = dealt.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "key", "at")
    edges = dealt.mapInArrow(sort, "key bigint, start bigint, stop bigint")
    met = found.filter("kind = 1").select("key", F.col("at").alias("start"), (F.col("at") + F.col("more")).alias("stop"))
    return met.unionByName(edges)


def _chunks(ends: list[int]) -> Iterator[tuple[int, int]]:
    """Whole groups of rows, taken together up to _SORTED rows."""
    a = 0
    for i, e in enumerate(ends[1:], 1):
        if i + 1 == len(ends) or ends[i + 1] - a > _SORTED:
            yield a, e
            a = e


#: Bits of the fixed map of keys that spares other documents a shuffle (2 MB). Where it fills up, more documents than needed are shuffled.
MAP_BITS = 1 << 24


def _only(docs: DataFrame, key: str, some: DataFrame, some_key: str) -> DataFrame:
    """docs less most rows whose key isn't in some, without a shuffle of docs."""
    return _mapped(docs, key, some, some_key)[0]


def _mapped(docs: DataFrame, key: str, some: DataFrame, some_key: str) -> tuple[DataFrame, DataFrame]:
    """docs whose key may be in some, and those whose key is not."""
    p = private(docs)
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(MAP_BITS))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(c) % 64).cast("int"))
    words = some.select(F.floor(bit(some_key) / 64).cast("long").alias(f"{p}word"), one(some_key).alias("b")).groupBy(f"{p}word").agg(F.bit_or("b").alias(f"{p}bits"))
    words = cut(words)  # MAP_BITS / 64 rows at most
    near = docs.withColumn(f"{p}word", F.floor(bit(key) / 64).cast("long")).join(F.broadcast(words), f"{p}word", "left")
    may = F.coalesce(F.col(f"{p}bits").bitwiseAND(one(key)) != 0, F.lit(False))
    return near.filter(may).select(*docs.columns), near.filter(~may).select(*docs.columns)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, heavy: int = HEAVY) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; kept: the bytes that are left.

    Null texts count as empty. Rows with equal keys count as one document
    (equal rows are not each other's repeats; each loses what any of them
    loses). Rows with a null key are left whole and are nobody's original.
    """
    passages = repeated_passages(docs, key, text, span, heavy).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")).withColumnRenamed("key", "k")
    passages = cut(passages)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, cuts in zip(batch["text"], batch["cuts"], strict=True):
                raw = t.as_py()
                c = cuts.values
                a, b = merged(c.field("start").to_numpy(), np.minimum(c.field("stop").to_numpy(), len(raw)))
                keep = [raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)]
                out.append((len(raw), int((b - a).sum()), len(a), b"".join(keep)))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    may, others = _mapped(rows, "key", passages.select("k"), "k")
    touched = may.join(passages, F.col("key").cast("long") == F.col("k"), "left")
    shape = rows.select("key").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    cuts = touched.filter("cuts IS NOT NULL").select("key", "text", "cuts").mapInArrow(trim, shape)
    whole = lambda df: df.select("key", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"))
    out = cuts.unionByName(whole(touched.filter("cuts IS NULL"))).unionByName(whole(others))
    return out.withColumnRenamed("key", key)
