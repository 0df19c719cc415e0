"""Toxicity by classifier chains.

The categories form a chain. Each has a logistic model over the words of a text
and over the probabilities of the categories before it. While learning, those
come from models that have not seen the row (out of fold), so that a later
model meets probabilities as good, or as bad, as it will meet when it predicts.

A word is its CRC-32; a model keeps the words that tell its category apart best
(by chi-square), and knows whether a text has them, not how often. From what
probability on a text belongs to a category is learned too: where the
out-of-fold probabilities give the best F1. Rare categories seldom come near 1/2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import private

#: Labelled texts that a model is learned from, at most; different ones, chosen by a hash of the text.
SAMPLE = 8_000
FOLDS, WORDS_KEPT, LEAST_TEXTS = 3, 1_000, 3
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> np.ndarray:
    """The different words of a UTF-8 text, as numbers, ascending."""
    return np.unique(np.fromiter(map(zlib.crc32, (text or b"").translate(_LETTERS).split()), np.uint32))


@dataclass
class Linear:
    """A logistic model: words (ascending), a weight each, weights of the categories before, bias."""

    words: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def score(self, found: np.ndarray, before: Sequence[float]) -> float:
        at = np.searchsorted(self.words, found)
        at[at == len(self.words)] = 0
        hit = self.words[at] == found if len(self.words) else np.zeros(0, bool)
        z = self.bias + self.weights[at[hit]].sum() + float(np.dot(self.chained, np.asarray(before)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, steps: int = 200, l2: float = 0.1) -> Linear:
    """A model of y (0 or 1) by words and by the columns of before: gradient descent with one step size a weight."""
    n = len(rows)
    empty = Linear(np.empty(0, np.uint32), np.empty(0), np.zeros(before.shape[1]), 0.0)
    if not n:
        return empty
    base = (y.sum() + 0.5) / (n + 1)
    if y.min() == y.max():
        empty.bias = float(np.log(base / (1 - base)))
        return empty
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    known, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    with_y = np.bincount(at, y[row], len(known))
    expected = df * y.mean()
    chi = (with_y - expected) ** 2 / np.maximum(expected * (1 - y.mean()) * (1 - df / (n + 1)), 1e-9)
    chi[df < LEAST_TEXTS] = 0
    keep = np.sort(np.argsort(-chi, kind="stable")[: min(WORDS_KEPT, int((chi > 0).sum()))])
    new = np.full(len(known), -1)
    new[keep] = np.arange(len(keep))
    use = new[at] >= 0
    row, col = row[use], new[at][use]
    w, c, b = np.zeros(len(keep)), np.zeros(before.shape[1]), float(np.log(base / (1 - base)))
    gw, gc, gb = np.full(len(keep), 1e-8), np.full(len(c), 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(row, w[col], n) + before @ c
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        dw = np.bincount(col, e[row], len(keep)) + l2 * w
        dc, db = before.T @ e + l2 * c, e.sum()
        gw, gc, gb = gw + dw**2, gc + dc**2, gb + db**2
        w, c, b = w - 0.5 * dw / np.sqrt(gw), c - 0.5 * dc / np.sqrt(gc), b - 0.5 * db / np.sqrt(gb)
    return Linear(known[keep], w, c, float(b))


@dataclass
class Chain:
    """Models in their order, and from which probability on a text belongs to each category."""

    categories: tuple[str, ...]
    models: list[Linear]
    cutoffs: tuple[float, ...] = ()

    def predict(self, text: bytes | None) -> list[float]:
        """A probability a category, in the chain's order."""
        found, out = words(text), []
        for m in self.models:
            out.append(m.score(found, out))
        return out


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """Half-way between the two probabilities that part the classes with the best F1; 1/2 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    # texts of equal probability go together
    ends = np.flatnonzero(np.append(p[1:] != p[:-1], True))
    f1 = 2 * hits[ends] / (ends + 1 + y.sum())
    k = int(ends[f1.argmax()])
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


def fit_chain(rows: list[np.ndarray], fold: np.ndarray, labels: np.ndarray, categories: Sequence[str], folds: int = FOLDS) -> Chain:
    """The chain over rows with labels (rows x categories, 0 or 1, -1: unknown)."""
    before = np.zeros((len(rows), 0))
    models, cutoffs = [], []
    for k in range(len(categories)):
        known = labels[:, k] >= 0
        learn = lambda use: fit([rows[i] for i in np.flatnonzero(use)], before[use], labels[use, k].astype(float))  # noqa: B023, E731
        unseen = np.zeros(len(rows))
        for f in range(folds):
            m = learn(known & (fold != f))
            for i in np.flatnonzero(fold == f).tolist():
                unseen[i] = m.score(rows[i], before[i])
        models.append(learn(known))
        cutoffs.append(best_cutoff(unseen[known], labels[known, k]))
        before = np.column_stack([before, unseen])
    return Chain(tuple(categories), models, tuple(cutoffs))


def text_hash(text: Column) -> Column:
    """What samples are drawn by; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))


def learn(labelled: DataFrame, categories: Sequence[str], text: str = "text", sample: int = SAMPLE, hashed: str | None = None) -> Chain:
    """A chain from rows with a text and 0/1 columns named categories, in that order.

    Rows that agree in text and labels count once, so that copies neither weigh
    more nor fill the sample; it has `sample` rows at most, those whose texts have
    the least hashes, whatever the table's size. Equal texts share their fold.
    Null labels are unknown, null texts empty. Without rows every probability is
    1/2. Only the columns named are read.

    hashed: a column with each text's text_hash. Where labelled is a join, give the
    texts' side that column before it: then only keys and hashes, and the texts
    drawn, go through the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t.as_py()).view(np.int32) for t in batch["text"]]
            fold = [zlib.crc32(t.as_py() or b"") >> 3 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(found, pa.list_(pa.int32())), pa.array(fold, pa.int64()), *[batch[c] for c in marks]], ["h", "words", "fold", *marks])

    marks = [f"c{i}" for i in range(len(categories))]
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(m) for c, m in zip(categories, marks, strict=True)], (F.col(hashed) if hashed else text_hash(F.col(text))).alias("h"))
    n = rows.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    # a share that gives more than enough; copies are merged before they are shuffled; then exactly the first by hash
    dice = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    drawn = rows.filter(dice < F.lit(min(1.0, 1.3 * sample / max(n, 1)))).groupBy("h", *marks).agg(F.first("text").alias("text"))
    order = (F.shiftrightunsigned("h", 11), "h", *marks)
    got = drawn.mapInArrow(run, "h bigint, words array<int>, fold bigint, " + ", ".join(f"{c} int" for c in marks)).orderBy(*order).limit(sample).toArrow()
    got = got.sort_by([("fold", "ascending"), ("h", "ascending"), *[(m, "ascending") for m in marks]])
    found = [np.asarray(x.values.to_numpy() if x.values is not None else [], np.int32).view(np.uint32) for x in got["words"]]
    labels = np.column_stack([got[c].to_numpy() for c in marks]) if got.num_rows else np.zeros((0, len(categories)))
    return fit_chain(found, got["fold"].to_numpy() % FOLDS, labels, categories)


def predict(docs: DataFrame, chain: Chain, keep: list[str] | None = None, text: str = "text", prefix: str = "p_") -> DataFrame:
    """The columns keep of docs (all if None) and a probability a category.

    Whole texts are read; null counts as empty. Every row gives a row: repeated
    and null keys too, equal texts equal probabilities; an empty table gives an
    empty one. A column of docs called like a new one is replaced.
    """
    new = [prefix + c for c in chain.categories]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [n.lower() for n in new]]
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias(private(docs) + "text"))
    schema = rows.select(*keep).schema
    for c in new:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([chain.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(chain.categories))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(got[:, i]) for i in range(got.shape[1])]], schema.names)

    return rows.mapInArrow(run, schema)
