"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (n = 1 to
3, over letters, lower-cased, words apart by one blank), by frequency. A
document's own list is held against each profile: every n-gram costs the
distance between its two ranks, or PROFILE if the profile lacks it. The language
with the smallest sum wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = 400
#: Rows of a language that its profile is learned from, at most; different texts, chosen by a hash of the text.
SAMPLE = 12_000
#: Languages a model may have; bounds what goes to the driver and to every task (3 KB a language).
MOST_LANGUAGES = 20_000
#: Parts that count n-grams while learning.
COUNT_PARTS = 8
#: Letters (as str.isalpha has them) packed at a time; bounds memory for long texts.
BLOCK = 1 << 20


_OTHER = re.compile(r"[\W\d_]+")
#: Signs that stand for numbers: the pattern lets them pass, but they aren't letters.
_SIGNS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha())
_BLANKS = dict.fromkeys(map(ord, _SIGNS), " ")


def _letters(text: str | None) -> str:
    """The letters of a text, lower-cased, with one blank for every run of what isn't a letter; none around them."""
    found = _OTHER.sub(" ", (text or "").lower())
    if not found.isascii() and not _SIGNS.isdisjoint(found):
        found = " ".join(found.translate(_BLANKS).split())
    return found.strip()


def _grams(text: str | None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, each packed into a number, and their counts; whatever the block, the same."""
    letters = _letters(text)
    if not letters:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    letters = f" {letters} "
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(letters), block):
        # the n-grams that end in this block: it starts up to two code points early
        old = min(2, i)
        a = np.frombuffer(letters[i - old : i + block].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        two = a[:-1] | a[1:] << np.uint64(21)
        three = two[:-1] | a[2:] << np.uint64(42)
        one = a[old:]
        new = [one[one != 32], two[max(old - 1, 0) :], three[a[1:-1] != 32]]
        seen.append(np.unique(np.concatenate(new), return_counts=True))
    if len(seen) == 1:
        return seen[0]
    grams, at = np.unique(np.concatenate([g for g, _ in seen]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in seen])).astype(np.int64)


def _top(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, the smaller number first among equals."""
    if len(grams) > 2 * n:
        keep = counts >= np.partition(counts, len(counts) - n)[len(counts) - n]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:n]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            by.setdefault(lang, []).append(_grams(text.as_py()))
        for lang, found in by.items():
            grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The PROFILE most frequent n-grams of each language in this part; a gram is in one part only."""
    most: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), dtype=object)
        grams, counts = batch["gram"].to_numpy(), batch["n"].to_numpy()
        for lang in set(langs):
            mine = langs == lang
            g, n = grams[mine], counts[mine]
            if lang in most:
                g, n = np.concatenate([most[lang][0], g]), np.concatenate([most[lang][1], n])
            order = np.lexsort((g.view(np.uint64), -n))[:PROFILE]
            most[lang] = g[order], n[order]
    for lang, (g, n) in most.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])


class Profiles:
    """Ranked n-grams of some languages."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.langs = sorted(ranked)
        self.grams = np.unique(np.concatenate([ranked[x] for x in self.langs])) if ranked else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.grams, ranked[lang])] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the distance as a share of the largest possible.

        und and 0 for null, for a text without letters and if no language is
        known. Of equally near languages the first by code point.
        """
        own = _top(*_grams(text), PROFILE)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own), dtype=np.int32))).sum(axis=1)
        k = int(apart.argmin())
        return self.langs[k], float(1 - apart[k] / (PROFILE * len(own)))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles of the languages in labelled.

    Rows without text or lang don't count, and rows that repeat both count once.
    A language is learned from `sample` of its texts at most: those with the least
    hashes. No labelled row: a model that knows no language. More than
    `most_languages` labels are refused: their profiles wouldn't fit a task.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return Profiles({})
    by_lang = lambda values: F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))])[F.col("lang")]
    # hashes only: of a share that gives more than enough, the one that is the last to be taken
    place = F.shiftrightunsigned("h", 1)  # under 2^63
    drawn = rows.filter(place < by_lang({k: min(int(1.3 * sample / max(n, 1) * 2**53) << 10, 2**63 - 1) for k, n in sizes.items()}))
    least = drawn.select("lang", place.alias("p")).groupBy("lang").agg(F.sort_array(F.collect_set("p")).alias("p"))
    last = {r["lang"]: r["p"] for r in least.select("lang", F.get("p", F.least(F.size("p"), F.lit(sample)) - 1).alias("p")).collect()}
    if not last:
        return Profiles({})
    # the texts of those, copies merged before they are shuffled, are dealt out by hash and counted where they come to lie
    chosen = rows.filter(place <= by_lang(last)).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, gram bigint, n bigint")
    total = counts.repartition(COUNT_PARTS, "gram").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best: dict[str, list] = {}
    for r in total.mapInArrow(_best, "lang string, gram bigint, n bigint").collect():
        best.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    return Profiles({k: _top(np.array([g for g, _ in v], np.int64).view(np.uint64), np.array([n for _, n in v], np.int64), PROFILE) for k, v in best.items()})


def identify(docs: DataFrame, model: Profiles, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs (all if None), predicted language and score.

    Whole texts are read; null texts are und; empty tables give empty results;
    equal texts and repeated rows get equal answers, null keys too. A column of
    docs called like a new one is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("\x00text"))
    schema = rows.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, *names])

    return rows.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows whose key's CRC-32, modulo 4, is 2: never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
