"""Benchmark decontamination by q-gram lemma filtering.

Two texts within k edits share at least L - Q + 1 - k * Q of the L - Q + 1
q-grams of one of them (the q-gram lemma), and the shared ones lie on diagonals
no further than k from each other. So the shared q-grams of a document and an
item are counted in bands of diagonals, twice 2k + 1 wide and overlapping by
half; bands that reach the bound are verified by an alignment that stays in the
band. Texts are compared as letters and digits: A-Z lower-cased, runs of other
ASCII characters as one blank.

Items under LEAST bytes, too short for the lemma to say much, are found where
they stand word for word: their first bytes are looked up among the document's,
and what agrees is compared whole, from word bound to word bound.

Documents are read where they lie; nothing is shuffled. The items are the
stated query set: they are taken in blocks of BLOCK_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, private

Q = 8
#: Edits allowed, as a share of an item's length.
EDITS = 0.1
#: Items shorter than this (compared as above) match word for word only.
LEAST = 40
#: Items of fewer words are no evidence if they are also shorter than LEAST: a single word leaks nothing.
LEAST_WORDS = 2
#: Bytes of items that are indexed and sent to the tasks at a time.
BLOCK_BYTES = 4 << 20
#: Compared bytes of documents looked at together; longer ones go in pieces that overlap by more than any match is long.
PIECE = 1 << 20
_MAP = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _MAP[_c] = _c
_MAP[65:91] = np.arange(97, 123)


def normal(data: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The compared form of UTF-8 bytes, and where each byte of it stood. inside: a letter or digit stands before them."""
    low = _MAP[data]
    keep = low != 32
    before = np.concatenate([[inside], keep[:-1]]) if len(keep) else keep
    at = np.flatnonzero(keep | before)
    return low[at], at


def pieces(data: np.ndarray, size: int, over: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """The compared form of a text in pieces of `size` bytes and more, each starting with the `over` bytes that the one before ended with.

    The last two say whether the piece begins, and ends, where the text does.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    length, inside, first = 0, False, True
    for i in range(0, len(data), size):
        own, at = normal(data[i : i + size], inside)
        inside = bool(_MAP[data[min(i + size, len(data)) - 1]] != 32)
        held.append((own, at + i))
        length += len(own)
        if length >= size + over and i + size < len(data):
            own, at = (np.concatenate([h[k] for h in held]) for k in range(2))
            yield own, at, first, False
            held, length, first = [(own[len(own) - over :], at[len(at) - over :])], over, False
    if held:
        own, at = (np.concatenate([h[k] for h in held]) for k in range(2))
        yield own, at, first, True


def grams(data: np.ndarray) -> np.ndarray:
    """Every 8 bytes in a row, as a number."""
    return np.lib.stride_tricks.as_strided(data, (max(0, len(data) - Q + 1), Q), (1, 1)).copy().view("<u8").reshape(-1) if len(data) >= Q else np.empty(0, "<u8")


class Index:
    """Q-grams of some items, and how many of them must be found."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, least: int = LEAST):
        self.texts: list[bytes] = []
        self.ids: list[list[int]] = []
        self.short: list[bytes] = []
        self.short_ids: list[list[int]] = []
        by: dict[bytes, set[int]] = {}
        for k, text in items:
            by.setdefault(normal(np.frombuffer(text.encode(), np.uint8))[0].tobytes().strip(), set()).add(k)
        for text, ids in sorted(by.items()):
            if len(text) >= max(least, Q):
                self.texts.append(text)
                self.ids.append(sorted(ids))
            elif len(text.split()) >= LEAST_WORDS:
                self.short.append(text)
                self.short_ids.append(sorted(ids))
        # short items by how many of their first bytes are looked up, and the number these make
        heads: dict[int, list[tuple[int, int]]] = {}
        for n, text in enumerate(self.short):
            size = min(Q, len(text))
            heads.setdefault(size, []).append((int.from_bytes(text[:size], "little"), n))
        self.heads = {size: (np.array([h for h, _ in sorted(found)], np.uint64), np.array([n for _, n in sorted(found)], np.int64)) for size, found in heads.items()}
        self.length = np.array([len(t) for t in self.texts], np.int64)
        # no more edits than leave one q-gram to be found
        self.budget = np.minimum((self.length * edits).astype(np.int64), (self.length - Q) // Q)
        self.need = self.length - Q + 1 - self.budget * Q
        own = [grams(np.frombuffer(t, np.uint8)) for t in self.texts]
        every = np.concatenate(own) if own else np.empty(0, "<u8")
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        at = np.concatenate([np.arange(len(g)) for g in own]) if own else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[_slot(self.grams)] = True
        self.longest = int(self.length.max(initial=0))

    @property
    def over(self) -> int:
        """More compared bytes than any match has, with what stands around it."""
        return 2 * self.longest + 4 * int(self.budget.max(initial=0)) + 2 * Q + 2 * max(map(len, self.short), default=0)

    def verbatim(self, data: np.ndarray, begins: bool = True, ends: bool = True) -> Iterator[tuple[int, int]]:
        """(place, short item) wherever a short item stands, from word bound to word bound. begins, ends: data does where its text does."""
        for size, (heads, which) in self.heads.items():
            if len(data) < size:
                continue
            padded = np.concatenate([data, np.zeros(Q, np.uint8)])
            g = grams(padded)[: len(data) - size + 1]
            if size < Q:
                g = g & np.uint64((1 << 8 * size) - 1)
            # only what starts a word
            start = np.flatnonzero(np.concatenate([[begins], data[:-1] == 32])[: len(g)])
            lo, hi = np.searchsorted(heads, g[start]), np.searchsorted(heads, g[start], side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                at = int(start[k])
                for n in which[lo[k] : hi[k]].tolist():
                    end = at + len(self.short[n])
                    if end <= len(data) and data[at:end].tobytes() == self.short[n] and (data[end] == 32 if end < len(data) else ends):
                        yield at, n

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and position in the item of every shared q-gram."""
        g = grams(data)
        at = np.flatnonzero(self.seen[_slot(g)])
        found = np.searchsorted(self.grams, g[at])
        found[found == len(self.grams)] = 0
        real = self.grams[found] == g[at] if len(self.grams) else np.zeros(0, bool)
        at, found = at[real], found[real]
        n = self.count[found]
        entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else found, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[entry], self.at[entry]

    def bands(self, data: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first diagonal, q-grams) of every band that reaches its bound. doc: whose byte each one is."""
        pos, item, at = self.hits(data)
        if not len(pos):
            return
        pair = doc[pos].astype(np.int64) * len(self.texts) + item
        order = np.argsort(pair, kind="stable")
        pair, pos, item, at = pair[order], pos[order], item[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        n = np.diff(np.append(new, len(pair)))
        enough = np.repeat(n >= self.need[item[new]], n)
        pair, pos, item, at = pair[enough], pos[enough], item[enough], at[enough]
        if not len(pair):
            return
        wide = 2 * self.budget[item] + 1
        band = (pos - at + self.longest) // wide
        # a q-gram of the item counts once in a band, however often the document repeats it
        band = np.concatenate([band, band - 1])
        order = np.lexsort((np.concatenate([at, at]), band, np.concatenate([pair, pair])))
        where = order % len(pair)
        own, band, gram = pair[where], band[order], at[where]
        other = np.concatenate([[True], (own[1:] != own[:-1]) | (band[1:] != band[:-1])])
        fresh = other | np.concatenate([[True], gram[1:] != gram[:-1]])
        first = np.flatnonzero(other)
        n = np.add.reduceat(fresh.astype(np.int64), first)
        where, lower = where[first], band[first]
        for k in np.flatnonzero(n >= self.need[item[where]]).tolist():
            w = where[k]
            yield int(pair[w] // len(self.texts)), int(item[w]), int(lower[k] * wide[w] - self.longest), int(n[k])


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def banded(item: bytes, data: np.ndarray, lo: int, hi: int, limit: int) -> tuple[int, int] | None:
    """Fewest edits between item and any stretch of data, and the stretch's end, by paths on diagonals lo to hi.

    None beyond limit. Of equally good ends, the first.
    """
    width = hi - lo + 1
    cols = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 28)
    # entry i + c of these is about the byte at lo + i + c, on diagonal c: its value, and whether a path may take it or stand before it
    at = np.arange(lo, lo + len(item) + width + 1)
    taken = (at >= 0) & (at < len(data))
    value = np.full(len(at), 256, np.int16)
    value[taken] = data[at[taken]]
    no_byte = np.where(taken, 0, far).astype(np.int32)
    no_place = np.where((at >= 0) & (at <= len(data)), 0, far).astype(np.int32)
    cost = no_place[:width].copy()
    gone = np.full(width, far, np.int32)
    for i, c in enumerate(item):
        gone[:-1] = cost[1:] + 1  # the item's byte is left out
        cost = np.minimum(np.minimum(cost + (value[i : i + width] != c) + no_byte[i : i + width], gone), far)
        cost = np.minimum.accumulate(cost - cols) + cols  # bytes of data are left out
        cost = np.minimum(cost + no_place[i + 1 : i + 1 + width], far)
        if cost.min() > limit:
            return None
    k = int(cost.argmin())
    return int(cost[k]), lo + len(item) + k


def matches(index: Index, texts: list[bytes], piece: int = PIECE) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, edits, shared q-grams, first byte, bytes), once per document and item: the best, then the first.

    Short items come after the others: their number is that in index.short plus len(index.texts).
    """
    best: dict[tuple[int, int], tuple] = {}
    held: list[tuple[int, np.ndarray, np.ndarray, bool, bool]] = []
    if not index.texts and not index.short:
        return

    def add(key: tuple[int, int], edits: int, shared: int, start: int, end: int) -> None:
        # a piece that cuts a match short counts fewer of its q-grams than the next, which has it whole
        old = best.get(key)
        if old is None or (edits, start, -shared) < (old[0], old[2], old[1]):
            best[key] = (edits, -shared, start, end)

    def look() -> None:
        if not held:
            return
        data = np.concatenate([np.append(p[1], 1) for p in held]).astype(np.uint8)
        sizes = [len(p[1]) + 1 for p in held]
        first = np.cumsum([0, *sizes])
        for k, item, lo, n in index.bands(data, np.repeat(np.arange(len(held)), sizes)) if index.texts else ():
            doc, own, at = held[k][:3]
            lo -= int(first[k])
            key, budget, text = (doc, item), int(index.budget[item]), index.texts[item]
            if (old := best.get(key)) and old[0] == 0 and old[2] <= int(at[min(max(lo, 0), len(at) - 1)]):
                continue
            wide = 2 * budget + 1
            a, b = max(0, lo - budget), min(len(own), lo + 2 * wide + len(text) + budget)
            if (f := own[a:b].tobytes().find(text)) >= 0:
                got, start, end = 0, a + f, a + f + len(text)
            else:
                found = banded(text, own, lo - budget, lo + 2 * wide + budget, budget)
                if not found:
                    continue
                got, end = found
                # the same alignment from its end backwards gives the start
                back = banded(text[::-1], own[:end][::-1], -budget, budget, budget)
                start = end - (back[1] if back else len(text))
            add(key, got, n, int(at[start]), int(at[end - 1]) + 1)
        for doc, own, at, begins, ends in held if index.short else ():
            for start, n in index.verbatim(own, begins, ends):
                size = len(index.short[n])
                add((doc, len(index.texts) + n), 0, max(0, size - Q + 1), int(at[start]), int(at[start + size - 1]) + 1)
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        for own, at, begins, ends in pieces(np.frombuffer(text, np.uint8), piece, index.over):
            if len(own):
                held.append((k, own, at, begins, ends))
                size += len(own)
            if size >= piece:
                look()
                size = 0
    look()
    for (doc, item), (edits, n, start, end) in sorted(best.items()):
        yield doc, item, edits, -n, start, end - start


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    edits: float = EDITS,
    least: int = LEAST,
    block_bytes: int = BLOCK_BYTES,
    piece: int = PIECE,
) -> DataFrame:
    """(key, item_id, edits, shared, start, length): each item found in each document, once, where it fits best.

    start and length are bytes of the document's UTF-8 text, shared the q-grams
    counted. Items with equal compared texts are all reported. Items shorter than
    `least` are found word for word; those of a single word then never match.
    Null texts and documents without any item give no rows; so do empty tables.
    Null keys are kept as null, repeated keys and rows each give their own; other
    columns aren't read, so their names can't clash. Neither the length of a text
    nor `piece` or `block_bytes` changes what is found.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = "key bigint, item_id bigint, edits int, shared int, start bigint, length bigint"
    out = None
    for block in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part], edits, least))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            ids = [*x.ids, *x.short_ids]
            for batch in batches:
                keys, texts = batch["key"].to_pylist(), [t.as_py() or b"" for t in batch["text"]]
                rows = [(keys[d], i, e, n, s, w) for d, item, e, n, s, w in matches(x, texts, piece) for i in ids[item]]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "item_id", "edits", "shared", "start", "length"])

        got = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)
        if blocks > 1:
            # one index at a time on the driver and the executors: its finds, few, are kept in the shared folder
            got = cut(got)
            index.destroy()
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("key", key)


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs, all columns as they are, without those in which an item was found. Rows with a null key stay."""
    p = private(docs)
    gone = find_leaks(docs, items, key=key, **how).select(F.col(key).alias(f"{p}key")).distinct()
    return docs.join(gone, F.col(key) == F.col(f"{p}key"), "left_anti")
