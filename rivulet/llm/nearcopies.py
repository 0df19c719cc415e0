"""Near copies by word shingles, found with wide SimHash fingerprints on several rings.

Two sets of shingles with a Jaccard similarity s have a cosine of 2s / (1 + s) or
more, so the bits of their fingerprints differ with a known probability: at
s = 0.8 about 15 in 100. Segments that short-listed such a pair for certain would
be three bits long. Instead the BITS bits are laid out on several rings, each in
an order of its own, and a fingerprint is indexed under every segment of every
ring. Pairs that agree on a segment are held to the proportional budgets of the
chain of up to CHAIN bits that starts there, and what passes is checked exactly,
on the shingles themselves. Segments get longer, and rings more, with the number
of fingerprints (Layout), so that buckets stay small.

A bucket gives no pairs: its members are spanned by a forest, and each is joined to
the smallest id of its tree, so that whatever is connected within the budgets
stays so, and buckets that hold the same members give the same edges. Buckets of
over BUCKET members are dealt out as pairs of blocks. The components of all
these edges, clusters, then come together with their shingles, and members are
compared until no two of different components are left unchecked: no link is
lost to an edge that the check rejects. Once a member's component holds most of
its cluster nothing is held against it twice.

Clusters of over BLOCK members are dealt out by blocks. Each block is compared
first; what that leaves outside the cluster's largest component then visits all
other blocks, a stream past members that stay where they are.

The segments agree by chance: a pair just at 0.8 is found in about 993 of 1,000
cases, at 0.85 in 999 or more. No pair below the similarity links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, private, shuffle_partitions
from rivulet.llm.components import connected_components
from rivulet.llm.simhash import bit_counts, shingle_hashes, split_words

WORDS, SIMILARITY = 5, 0.8
BITS, CHAIN, LONGS = 256, 128, 4
#: Shortest and longest segment, and members of a bucket (by chance) from which segments get longer, as a power of 2.
SEGMENT, LONGEST, CROWD = 16, 32, 9
#: Segments that a pair just at the similarity shares on average: 8 leave one such pair in 140 unfound (5.7: one in 60).
MEETINGS = 8.0
#: Members of a bucket that one task compares at a time.
BUCKET = 4096
#: Members, and shingles, of a cluster that one task compares exactly at a time.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Larger buckets are spanned member by member.
_SMALL = 512
_FAR = 255
#: Slots of the table in which a task counts the members of buckets (a prime).
_SLOTS = 8_388_593
#: Bits of a filter for each id in it, and in all (16 MB).
_ID_BITS, _FILTER_BITS = 64, 1 << 27
#: Ids that are sent to where the documents are; to more, the documents go.
_FEW_IDS = 2_000_000
_PRINT = [f"p{k}" for k in range(LONGS)]


@lru_cache(maxsize=256)
def _order(ring: int) -> np.ndarray:
    return np.random.default_rng(ring).permutation(BITS)


def _share(similarity: float) -> float:
    """The part of the bits in which sets of that similarity differ, on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def bit_limit(similarity: float, bits: int = CHAIN, sigmas: float = 3.1) -> int:
    """Differing bits within which pairs of that similarity stay, but for one in a thousand."""
    share = _share(similarity)
    return min(bits // 2, ceil(bits * share + sigmas * sqrt(bits * share * (1 - share))))


@dataclass(frozen=True)
class Layout:
    """Length of the segments, number of rings, and the bits in which a chain may differ."""

    segment: int
    rings: int
    limit: int

    @property
    def starts(self) -> int:
        return BITS // self.segment

    @property
    def chain(self) -> int:
        return CHAIN // self.segment * self.segment

    @property
    def keys(self) -> int:
        return self.rings * self.starts


def layout(fingerprints: int, similarity: float = SIMILARITY) -> Layout:
    """Up to 33 million fingerprints 7 rings of 16 segments of 16 bits; from there on a bit more for every doubling."""
    segment = min(LONGEST, max(SEGMENT, ceil(log2(max(fingerprints, 1))) - CROWD))
    met = BITS // segment * (1 - _share(similarity)) ** segment
    return Layout(segment, max(1, ceil(MEETINGS / met)), bit_limit(similarity, CHAIN // segment * segment))


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a UTF-8 text as numbers, ascending; fewer words: the whole sequence; none: empty."""
    found = list(shingle_hashes(split_words(data), words))
    return np.unique(np.concatenate(found)) if found else np.empty(0, "<u8")


def wide_print(own: np.ndarray) -> list[int]:
    """The LONGS parts of the fingerprint of a set of shingles, and a hash that equal sets share."""
    out, h = [], own
    for _ in range(LONGS):
        out.append(int(np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view("<i8")[0]))
        # 64 more bits of each hash
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ h >> np.uint64(29)
    return [*out, xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)]


def ring_keys(prints: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, and the two longs of the chain, under every start on every ring: a row a fingerprint.

    A bucket's number is its ring and start above the bits of its segment. prints: signed longs, LONGS a row.
    """
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    out: list[tuple[np.ndarray, ...]] = []
    for ring in range(lay.rings):
        x = np.ascontiguousarray(np.packbits(bits[:, _order(ring)], axis=1)).view(">u8").astype(np.uint64)
        for start in range(lay.starts):
            first, by = divmod(lay.segment * start, 64)
            a, b, c = (x[:, (first + k) % LONGS] for k in range(3))
            if by:
                a, b = (p << np.uint64(by) | q >> np.uint64(64 - by) for p, q in ((a, b), (b, c)))
            out.append((np.uint64((ring * lay.starts + start) << lay.segment) | a >> np.uint64(64 - lay.segment), a, b))
    return tuple(np.stack([o[k] for o in out], axis=1) for k in range(3))


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[c].to_numpy() for c in _PRINT], axis=1)


def _apart(one: np.ndarray, two: np.ndarray, lay: Layout) -> np.ndarray:
    """Bits set in differences that keep the budgets of the chain from their first segment on; _FAR for others."""
    out = np.full(len(one), _FAR, np.int64)
    left = np.arange(len(one))
    for bits in range(2 * lay.segment, lay.chain + 1, lay.segment):
        spent = np.bitwise_count(one >> np.uint64(64 - bits) if bits <= 64 else one).astype(np.int64)
        if bits > 64:
            spent += np.bitwise_count(two >> np.uint64(CHAIN - bits))
        keep = np.flatnonzero(spent <= bits * lay.limit // lay.chain)
        left, one, two = left[keep], one[keep], two[keep]
        if bits == lay.chain:
            out[left] = spent[keep]
        if not len(left):
            break
    return out


def _span(one: np.ndarray, two: np.ndarray, lay: Layout) -> Iterator[tuple[int, int]]:
    """The spanning forest of one bucket, grown member by member."""
    n = len(one)
    left, near, by = np.arange(1, n), np.full(n - 1, _FAR + 1), np.zeros(n - 1, np.int64)
    now = 0
    while len(left):
        d = _apart(one[left] ^ one[now], two[left] ^ two[now], lay)
        closer = d < near
        near[closer], by[closer] = d[closer], now
        k = int(near.argmin())
        now = int(left[k])
        if near[k] < _FAR:
            yield int(by[k]), now
        left, near, by = np.delete(left, k), np.delete(near, k), np.delete(by, k)


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs (a, b) that span what all of them connect, nearest first."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for k in np.argsort(d, kind="stable").tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            up[max(x, y)] = min(x, y)
            yield int(a[k]), int(b[k])


def stars(edges: Iterator[tuple[int, int]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its tree) of the places that edges connect, each place once; those that are the least stay out."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            # the root of a tree is the place with its least id
            x, y = (x, y) if ids[x] < ids[y] else (y, x)
            up[y] = x
            up.setdefault(x, x)
    node = np.fromiter(up, np.int64, len(up))
    root = np.array([top(int(x)) for x in node], np.int64)
    other = node != root
    return ids[node[other]], ids[root[other]]


def bucket_edges(number: np.ndarray, one: np.ndarray, two: np.ndarray, lay: Layout) -> Iterator[tuple[int, int]]:
    """Places of the members that the forests of whole buckets, one after the other, join."""
    new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    size = np.diff(np.append(new, len(number)))
    at = np.flatnonzero(np.repeat(size <= _SMALL, size))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(1, _SMALL):
        at = at[at + step < len(number)]
        at = at[number[at] == number[at + step]]
        if not len(at):
            break
        d = _apart(one[at] ^ one[at + step], two[at] ^ two[at + step], lay)
        ok = d < _FAR
        found.append((at[ok], at[ok] + step, d[ok]))
    if found:
        a, b, d = (np.concatenate([f[k] for f in found]) for k in range(3))
        which = np.searchsorted(new, a, side="right") - 1
        # a bucket whose members nearly all pair off is cheaper to span member by member
        dense = np.bincount(which, minlength=len(new)) > 8 * size
        sparse = ~dense[which]
        yield from _forest(a[sparse], b[sparse], d[sparse])
    else:
        dense = np.zeros(len(new), bool)
    for k in np.flatnonzero(dense | (size > _SMALL)).tolist():
        first = int(new[k])
        for x, y in _span(one[first : first + size[k]], two[first : first + size[k]], lay):
            yield first + x, first + y


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut only where one of the columns `by` changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[c].to_numpy() for c in by]
        before = [held[-1][c][held[-1].num_rows - 1].as_py() if held else None for c in by]
        new = np.zeros(batch.num_rows, bool)
        for c, old in zip(cols, before, strict=True):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and c[0] != old
        at = np.flatnonzero(new)
        if len(at):
            cut_at = int(at[-1])
            held.append(batch.slice(0, cut_at))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
            batch = batch.slice(cut_at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Where the groups of a table begin, and its end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in by:
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _paired(rows: DataFrame) -> DataFrame:
    """rows of buckets with `pair`: those with several `blocks` stand once for every pair of blocks that their own is in."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long")
    pair = lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(j.cast("long")))
    none = F.array(F.lit(0).cast("long"))
    out = rows.select("bucket", "id", "one", "two", F.explode(F.when(F.coalesce(F.col("blocks"), F.lit(1)) <= 1, none).otherwise(pairs)).alias("pair"))
    return out.repartition(shuffle_partitions(rows.sparkSession), "bucket", "pair").sortWithinPartitions("bucket", "pair")


def _big_buckets(reps: DataFrame, lay: Layout, bucket: int) -> DataFrame:
    """(slot, blocks) of the slots of buckets that may have over `bucket` members; counted where the rows lie."""
    parts = max(1, reps.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_SLOTS, np.int32)
        for batch in batches:
            number = ring_keys(_columns(batch), lay)[0].reshape(-1) % np.uint64(_SLOTS)
            np.add.at(seen, number.view(np.int64), 1)
        # who has over `bucket` members has its share of them in some part
        many = np.flatnonzero(seen.astype(np.int64) * parts > bucket)
        yield pa.RecordBatch.from_arrays([pa.array(many), pa.array(seen[many].astype(np.int64))], ["slot", "n"])

    counted = reps.select(*_PRINT).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    most = F.col("n") + F.lit(bucket / parts) * (F.lit(parts) - F.col("k"))
    return counted.filter(most > bucket).select("slot", F.ceil(most / bucket).cast("int").alias("blocks"))


def _to_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), sorted by (b, a): each b joined to its least a, and its other a to that one; what they connect stays connected."""
    last, least = None, None
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        if not len(a):
            continue
        new = np.concatenate([[last is None or b[0] != last], b[1:] != b[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        low = np.where(head >= 0, a[np.maximum(head, 0)], 0 if least is None else least)
        last, least = b[-1], low[-1]
        node = np.where(new, b, a)
        keep = node != low
        yield pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(node[keep])], ["a", "b"])


def candidates(reps: DataFrame, lay: Layout, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect ids whose fingerprints keep the budgets: in each bucket to the smallest id that is reached there. reps: (id, p0, p1, ...)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, one, two = ring_keys(_columns(batch), lay)
            ids = np.repeat(batch["id"].to_numpy(), number.shape[1])
            cols = [number.reshape(-1).view(np.int64), ids, one.reshape(-1).view(np.int64), two.reshape(-1).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "id", "one", "two"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("bucket", "pair")):
            ends = _starts(table, ("bucket", "pair"))
            number = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            ids = table["id"].to_numpy()
            found = bucket_edges(number, table["one"].to_numpy().view(np.uint64), table["two"].to_numpy().view(np.uint64), lay)
            node, least = stars(found, ids)
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(node)], ["a", "b"])

    keyed = reps.mapInArrow(keys, "bucket bigint, id bigint, one bigint, two bigint")
    many = cut(_big_buckets(reps, lay, bucket))
    if many.isEmpty():
        rows = keyed.withColumn("blocks", F.lit(None).cast("int"))
    else:
        rows = keyed.withColumn("slot", F.col("bucket") % F.lit(_SLOTS)).join(many, "slot", "left").drop("slot")
    found = _paired(rows).mapInArrow(edges, "a bigint, b bigint").filter("a != b")
    # members of the same buckets have many least ids in common: joined to their own least one, few different edges are left
    near = found.repartition(shuffle_partitions(reps.sparkSession), "b").sortWithinPartitions("b", "a")
    return near.mapInArrow(_to_least, "a bigint, b bigint").distinct()


def _id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for every hash of an id, and their number: a power of 2. ids: (id)."""
    bits = min(_FILTER_BITS, 1 << max(16, ceil(log2(_ID_BITS * max(ids.count(), 1)))))
    slot = ids.select(_slot("id", bits).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out, bits


def _slot(key: str, bits: int):
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1).cast("long"))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """docs (key, text) with their shingles, 32 bits each, made where the texts are: of all whose key is among ids, and a few others."""
    table, bits = _id_filter(ids)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch["slot"].to_numpy()
            at = np.flatnonzero(table.value[slot >> 6] >> (slot & 63) & 1).tolist()
            text = batch["text"]
            own = [np.unique(shingles(text[k].as_py(), words).astype(np.uint32)).view(np.int32) for k in at]
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at, pa.int64())), pa.array(own, pa.list_(pa.int32()))], ["key", "own"])

    return docs.select("key", "text", _slot("key", bits).alias("slot")).mapInArrow(run, "key bigint, own array<int>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of that similarity or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


class Members:
    """Members of a cluster that are compared: ids, fingerprints, sets of shingles, and the component of each."""

    def __init__(self, ids: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float, part: np.ndarray | None = None):
        self.ids, self.prints, self.similarity = ids, prints, similarity
        self.part = np.arange(len(ids)) if part is None else part.copy()
        self.size = np.array([len(x) for x in sets], np.int64)
        self.ends = np.append(0, np.cumsum(self.size))
        self.known, self.flat = np.unique(np.concatenate(sets) if len(sets) else np.empty(0, np.int32), return_inverse=True)
        self.mark = np.zeros(len(self.known), bool)
        self.far = bit_limit(similarity, BITS, 5.0)

    def alike(self, own: np.ndarray, prints: np.ndarray, size: int, among: np.ndarray) -> np.ndarray:
        """Places of those among that are alike a set: own are the places of its shingles in known, size is how many it has in all."""
        least, most = np.minimum(self.size[among], size), np.maximum(self.size[among], size)
        at = among[least >= self.similarity * most]
        at = at[np.bitwise_count(self.prints[at] ^ prints).sum(axis=1, dtype=np.int64) <= self.far]
        if not len(at):
            return at
        self.mark[own] = True
        if len(at) > 32:
            total = np.append(0, np.cumsum(self.mark[self.flat]))
            shared = (total[self.ends[1:]] - total[self.ends[:-1]])[at]
        else:
            shared = np.array([int(self.mark[self.flat[self.ends[k] : self.ends[k + 1]]].sum()) for k in at.tolist()])
        self.mark[own] = False
        return at[shared >= self.similarity * (self.size[at] + size - shared)]

    def join(self) -> None:
        """Joins components until no two members of different ones are alike.

        Members go by their distance from some of the others, the most central
        first; each that isn't in the largest component is held against all
        members of other components.
        """
        n = len(self.ids)
        some = np.linspace(0, n - 1, min(n, 64)).astype(int)
        apart = sum(np.bitwise_count(self.prints ^ self.prints[k]).sum(axis=1, dtype=np.int64) for k in some.tolist())
        for turn, p in enumerate(np.argsort(apart, kind="stable").tolist()):
            if turn and self.part[p] == np.bincount(self.part).argmax():
                continue
            near = self.alike(self.flat[self.ends[p] : self.ends[p + 1]], self.prints[p], int(self.size[p]), np.flatnonzero(self.part != self.part[p]))
            if len(near):
                self.part[np.isin(self.part, self.part[near])] = self.part[p]
                if (self.part == self.part[0]).all():
                    return

    def roots(self) -> np.ndarray:
        """The smallest id of each member's component."""
        order = np.lexsort((self.ids, self.part))
        new = np.concatenate([[True], self.part[order][1:] != self.part[order][:-1]]) if len(order) else np.zeros(0, bool)
        out = np.empty(len(self.ids), np.int64)
        out[order] = self.ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return out


def _members(t: pa.Table, similarity: float) -> Members:
    prints = np.stack([t[c].to_numpy() for c in _PRINT], axis=1).view(np.uint64)
    part = np.unique(t["root"].to_numpy(), return_inverse=True)[1] if "root" in t.column_names else None
    return Members(t["id"].to_numpy(), prints, [x.values.to_numpy() for x in t["shingles"]], similarity, part)


def _in_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """(node, root): every member of a block, and the smallest id of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("cluster", "block")):
            ends = _starts(table, ("cluster", "block")).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                own = _members(table.slice(a, b - a).combine_chunks(), similarity)
                own.join()
                yield pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(own.roots())], ["node", "root"])

    dealt = members.select("cluster", "block", "id", *_PRINT, "shingles").repartition(shuffle_partitions(members.sparkSession), "cluster", "block")
    return dealt.sortWithinPartitions("cluster", "block").mapInArrow(run, "node bigint, root bigint")


def _visits(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of visitors to members of the blocks that they visit.

    members: with root and away, true for those outside their cluster's largest
    component, which visit all blocks of it. A block's own members come first and
    stay in memory; visitors pass one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, waiting = None, None, []
        for batch in batches:
            where = np.stack([batch[c].to_numpy() for c in ("cluster", "block")], axis=1)
            visit = batch["visitor"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1) | (visit[1:] != visit[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(where[a]) != at:
                    at, own, waiting = tuple(where[a]), None, []
                if not visit[a]:
                    waiting.append(part)
                    continue
                if own is None:
                    own = _members(pa.Table.from_batches(waiting).combine_chunks(), similarity)
                    roots = pa.Table.from_batches(waiting)["root"].to_numpy()
                prints = np.stack([part[c].to_numpy() for c in _PRINT], axis=1).view(np.uint64)
                found: list[tuple[int, int]] = []
                for k, (node, root, shingles_) in enumerate(zip(part["id"].to_pylist(), part["root"].to_pylist(), part["shingles"], strict=True)):
                    mine = shingles_.values.to_numpy()
                    places = np.searchsorted(own.known, mine)
                    places = places[(places < len(own.known)) & (own.known[np.minimum(places, len(own.known) - 1)] == mine)]
                    near = own.alike(places, prints[k], len(mine), np.flatnonzero(roots != root))
                    found += [(node, int(own.ids[x])) for x in near[np.unique(roots[near], return_index=True)[1]].tolist()]
                if found:
                    x, y = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda j: j != F.col("block"))
    names = ["cluster", "block", "visitor", "id", "root", *_PRINT, "shingles"]
    stay = members.withColumn("visitor", F.lit(False)).select(*names)
    go = members.filter("away").withColumn("block", F.explode(others)).withColumn("visitor", F.lit(True)).select(*names)
    dealt = stay.unionByName(go).repartition(shuffle_partitions(members.sparkSession), "cluster", "block").sortWithinPartitions("cluster", "block", "visitor")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _across(checked: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): of the checked edges one for every two components that they would connect."""
    rows = checked
    for c in ("a", "b"):
        rows = rows.join(found.select(F.col("node").alias(c), F.col("root").alias(f"{c}r")), c)
    rows = rows.filter("ar != br").groupBy(F.least("ar", "br").alias("x"), F.greatest("ar", "br").alias("y")).agg(F.min(F.struct("a", "b")).alias("e"))
    return rows.select("e.a", "e.b")


def _components(reps: DataFrame, rows: DataFrame, checked: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """(node, root) of all ends of checked edges that aren't a root themselves."""
    clusters = connected_components(checked)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).withColumnsRenamed({"node": "id", "root": "cluster"})
    sets = _sets(rows, clusters.select("id"), words).withColumnsRenamed({"key": "id", "own": "shingles"})
    # a key that repeats with different texts has a row for each: all of them are members
    members = cut(reps.join(clusters, "id").join(sets, "id"))
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    large = cut(size.filter("blocks > 1"))
    if large.isEmpty():
        return _in_blocks(members.withColumn("block", F.lit(0).cast("long")), similarity).filter("node != root").distinct()
    placed = members.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
    found = cut(_in_blocks(placed, similarity))
    near = found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    sets = members.select(F.col("id").alias("key"), F.col("shingles").alias("own"))
    # one edge for every two blocks' components that candidates connect: most of a large group hangs together after that
    links = cut(near.unionByName(_alike(_across(checked, found), sets, similarity)))
    joined = connected_components(links)
    rooted = placed.filter("blocks > 1").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    count = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rooted = rooted.join(count, "cluster").withColumn("away", F.col("root") != F.col("main"))
    return connected_components(links.unionByName(_visits(rooted, similarity)))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(key, component): the smallest key reachable over links, itself included, for every row with a key.

    Documents link if the Jaccard similarity of their sets of word shingles is
    `similarity` or more. Equal sets always link, those of texts without words
    (null, empty, blanks) too. Repeated keys give a row each; a key that repeats
    with different texts joins what they are near. Only the columns key and text
    are read, so names of others can't clash; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).filter("key IS NOT NULL")
    same = [*_PRINT, "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([wide_print(shingles(t.as_py(), words)) for t in batch["text"]], np.int64).reshape(-1, LONGS + 1)
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(got[:, k]) for k in range(LONGS + 1)]], ["key", *same])

    prints = cut(rows.mapInArrow(run, "key bigint, " + ", ".join(f"{c} bigint" for c in same)))
    # the last hash keeps texts with equal fingerprints and different shingles apart
    reps = cut(prints.groupBy(*same).agg(F.min("key").alias("id")))
    checked = cut(candidates(reps, layout(reps.count(), similarity), bucket))
    found = cut(_components(reps, rows, checked, words, similarity, block))
    roots = reps.join(found, reps["id"] == found["node"], "left").select(*same, F.coalesce("root", "id").alias("component"))
    return prints.join(roots, same).select(F.col("key").alias(key), "component")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without the rows that are near a row with a smaller key. Rows with a null key stay. Up to _FEW_IDS keys that go are broadcast."""
    p = private(docs)
    gone = cut(near_copies(docs, key=key, **how).filter(F.col(key) != F.col("component")).select(F.col(key).alias(f"{p}key")).distinct())
    gone = F.broadcast(gone) if gone.count() <= _FEW_IDS else gone
    return docs.join(gone, F.col(key) == F.col(f"{p}key"), "left_anti")
