"""Retrieval held against clicks, one left out at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.measures import bm25_each, top_k_cosine
from rivulet.streaming.cutting import cut

#: Rank constant of the fusion of two lists.
FUSION = 60
METHODS = ("bm25", "embedding", "hybrid")
#: Documents, their terms and the numbers of their vectors, in all, up to which every task holds them; more are scored in joins.
_HELD = 4_000_000
#: Scores that a task has in memory at a time, about.
_SCORES = 1 << 20


def _first(df: DataFrame, by: list[str], score: str, n) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), "doc")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _scored_sets(docs: DataFrame, left_out: DataFrame, top: int) -> DataFrame:
    """The best documents of every set of query terms: as many as a user's other clicks can hide, and `top` more.

    Documents without a common term score 0 and follow by id; of those only the
    first by id can be among the best.
    """
    sets = cut(left_out.groupBy("query").agg(F.first("terms").alias("terms"), (F.max("m") + top).alias("cutoff")))
    most = sets.agg(F.max("cutoff")).first()[0] or top
    scores = bm25_each(docs, sets.select("query", F.explode("terms").alias("term"))).select("query", "doc", F.round("score", 9).alias("score"))
    # one row with at most `most` ids
    ids = docs.select("doc").orderBy("doc").limit(most).agg(F.sort_array(F.collect_list("doc")).alias("ids"))
    pads = sets.crossJoin(F.broadcast(ids)).select("query", F.explode(F.slice("ids", 1, F.col("cutoff").cast("int"))).alias("doc"), F.lit(0.0).alias("score"))
    both = scores.unionByName(pads).groupBy("query", "doc").agg(F.max("score").alias("score")).join(sets.select("query", "cutoff"), "query")
    return _first(both, ["query"], "score", F.col("cutoff")).select("query", "doc", "score")


@dataclass(frozen=True)
class Index:
    """Documents by ascending id: weights of their terms, by document and by term, and their vectors (zeros where there is none)."""

    doc_ends: np.ndarray
    doc_terms: np.ndarray
    term_ends: np.ndarray
    term_docs: np.ndarray
    term_weights: np.ndarray
    candidate: np.ndarray
    has_vector: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.doc_ends) - 1


def _slices(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all that the entries `at` hold, and the entry (its place in `at`) of each."""
    n = ends[at + 1] - ends[at]
    which = np.repeat(np.arange(len(at)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + ends[at][which], which


def _index(docs: DataFrame, vectors: DataFrame, ids: list) -> Index:
    """docs: doc, terms; ids: the documents in ascending order."""
    terms = docs.select(F.explode(F.array_distinct("terms")).alias("term")).filter("term IS NOT NULL").distinct()
    # a query of one term scores documents by that term's weight
    got = bm25_each(docs, terms.select(F.col("term").alias("query"), "term")).collect()
    place = {d: k for k, d in enumerate(ids)}
    number = {t: k for k, t in enumerate(sorted({r["query"] for r in got}))}
    doc, term = (np.array([of[r[c]] for r in got], np.int64) for of, c in ((place, "doc"), (number, "query")))
    weight = np.array([r["score"] for r in got], np.float64)
    ends = lambda x, n: np.append(0, np.cumsum(np.bincount(x, minlength=n)))
    by_doc, by_term = np.lexsort((term, doc)), np.lexsort((doc, term))
    rows = [(place[r["item_id"]], r["vector"]) for r in vectors.collect()]
    wide = max((len(v) for _, v in rows if v), default=1)
    candidate, has_vector, matrix = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.zeros((len(ids), wide))
    for k, v in rows:
        candidate[k] = True
        if v:
            has_vector[k], matrix[k] = True, v
    return Index(ends(doc, len(ids)), term[by_doc], ends(term, len(number)), doc[by_term], weight[by_term], candidate, has_vector, matrix, np.sqrt((matrix * matrix).sum(axis=1)))


def _ranked(scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the first `top` of each row, the best first, ties by place; -1 where only -inf is left."""
    first = np.argsort(-scores, axis=1, kind="stable")[:, :top]
    return np.where(np.take_along_axis(scores, first, axis=1) > -np.inf, first, -1)


def held_ranks(index: Index, items: np.ndarray, top: int) -> np.ndarray:
    """Ranks of each of a user's items, left out, by each of METHODS: a row an item; 0 where it isn't among the first `top`."""
    m, n = len(items), index.docs
    at, owner = _slices(index.doc_ends, items)
    terms, where, times = np.unique(index.doc_terms[at], return_inverse=True, return_counts=True)
    at_term, _ = _slices(index.term_ends, terms)
    by_terms = np.bincount(index.term_docs[at_term], index.term_weights[at_term], minlength=n)
    # what only the item left out has isn't asked for
    alone = np.flatnonzero(times[where] == 1)
    lone_terms, lone_owner = index.doc_terms[at][alone], owner[alone]
    total, with_vector = index.vectors[items].sum(axis=0), int(index.has_vector[items].sum())
    out = np.zeros((m, len(METHODS)), np.int64)
    step = max(1, _SCORES // max(n, 1))
    for low in range(0, m, step):
        held = items[low : low + step]
        k = len(held)
        hidden = np.zeros(n, bool)
        hidden[items] = True
        hidden = np.repeat(hidden[None, :], k, axis=0)
        hidden[np.arange(k), held] = False
        mine = (lone_owner >= low) & (lone_owner < low + k)
        at_lone, lone = _slices(index.term_ends, lone_terms[mine])
        less = np.bincount((lone_owner[mine][lone] - low) * n + index.term_docs[at_lone], index.term_weights[at_lone], minlength=k * n).reshape(k, n)
        lists = [_ranked(np.where(hidden, -np.inf, np.round(by_terms - less, 9) + 0.0), top)]
        query = total - index.vectors[held]
        scale = np.sqrt((query * query).sum(axis=1))[:, None] * index.norms[None, :]
        near = np.round(np.divide(query @ index.vectors.T, scale, out=np.zeros((k, n)), where=scale > 0), 9) + 0.0
        asked = with_vector - index.has_vector[held] > 0
        lists.append(_ranked(np.where(hidden | ~index.candidate | ~asked[:, None], -np.inf, near), top))
        fused = np.zeros((k, n))
        for found in lists:
            row, rank = np.nonzero(found >= 0)
            fused[row, found[row, rank]] += 1.0 / (rank + 1 + FUSION)
        lists.append(_ranked(np.where(fused > 0, np.round(fused, 12), -np.inf), top))
        for method, found in enumerate(lists):
            row, rank = np.nonzero(found == held[:, None])
            out[low + row, method] = rank + 1
    return out


def _sums_held(clicks: DataFrame, docs: DataFrame, vectors: DataFrame, ids: list, ks: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(method, k, share, hit) and (users, instances), every user's lists made where the user's items are; users with the same items count as one."""
    spark = clicks.sparkSession
    index = spark.sparkContext.broadcast(_index(docs, vectors, ids))
    top = max(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, hit = (np.zeros((len(METHODS), len(ks))) for _ in range(2))
        for batch in batches:
            for items, users in zip(batch["items"], batch["users"].to_pylist(), strict=True):
                ranks = held_ranks(index.value, items.values.to_numpy().astype(np.int64), top)
                n = np.stack([((ranks > 0) & (ranks <= k)).sum(axis=0) for k in ks], axis=1)
                share += users * (n / len(ranks))
                hit += users * (n > 0)
        rows = [(METHODS[a], k, share[a, b], int(hit[a, b])) for a in range(len(METHODS)) for b, k in enumerate(ks) if hit[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.int64()))], ["method", "k", "share", "hit"])

    schema = docs.select(F.col("doc").alias("item_id")).schema.add("place", "integer")
    places = F.broadcast(spark.createDataFrame([(d, k) for k, d in enumerate(ids)], schema))  # up to _HELD rows
    items = clicks.join(places, "item_id").groupBy("user_id").agg(F.sort_array(F.collect_set("place")).alias("items")).filter(F.size("items") >= 2)
    # by number: few bytes are much work
    sets = cut(items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "items").groupBy("items").agg(F.count("*").alias("users")))
    got = sets.mapInArrow(run, "method string, k int, share double, hit bigint").groupBy("method", "k").agg(F.sum("share").alias("share"), F.sum("hit").alias("hit"))
    return got, sets.agg(F.coalesce(F.sum("users"), F.lit(0)).alias("users"), F.sum(F.col("users") * F.size("items")).alias("instances"))


def _sums_joined(clicks: DataFrame, docs: DataFrame, vectors: DataFrame, ks: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The same by joins, for documents that no task can hold: terms and vectors of "all but one" come from a user's totals, less the one, and term sets that several instances share are scored once."""
    top = max(ks)
    known = clicks.select("user_id", "item_id").distinct().join(docs.select(F.col("doc").alias("item_id"), F.array_distinct("terms").alias("own")), "item_id")
    known = known.join(vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector")), "item_id", "left")
    known = cut(known.withColumn("m", F.count("*").over(Window.partitionBy("user_id"))).filter("m >= 2"))

    counts = known.select("user_id", F.explode("own").alias("term")).groupBy("user_id", "term").agg(F.count("*").alias("n"))
    users = counts.groupBy("user_id").agg(F.collect_list(F.struct("term", "n")).alias("all"))
    others = F.filter("all", lambda x: x["n"] > F.array_contains("own", x["term"]).cast("int"))
    terms = F.coalesce(F.sort_array(F.transform(others, lambda x: x["term"])), F.array().cast("array<string>"))
    left_out = known.join(users, "user_id", "left").select("user_id", F.col("item_id").alias("held"), "m", "vector", terms.alias("terms"))
    left_out = cut(left_out.withColumns({"query": F.sha2(F.to_json("terms"), 256), "instance": F.to_json(F.struct("user_id", "held"))}))
    clicked = known.select("user_id", F.col("item_id").alias("doc"))

    def lists(found: DataFrame) -> DataFrame:
        """The first `top` of (instance, user_id, held, doc, score) that aren't the user's other items."""
        hidden = (found["user_id"] == clicked["user_id"]) & (found["doc"] == clicked["doc"]) & (found["doc"] != found["held"])
        return _first(found.join(clicked, hidden, "left_anti"), ["instance"], "score", top)

    by_terms = lists(left_out.select("instance", "user_id", "held", "query").join(_scored_sets(docs, left_out, top), "query").drop("query"))

    each = known.filter("vector IS NOT NULL").select("user_id", F.posexplode("vector").alias("i", "x"))
    totals = each.groupBy("user_id", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total"), F.max("n").alias("with_vector"))
    left = F.col("with_vector") - F.col("vector").isNotNull().cast("int")
    mean = F.transform(F.when(F.col("vector").isNull(), F.col("total")).otherwise(F.zip_with("total", "vector", lambda a, b: a - b)), lambda x: x / left)
    asked = left_out.join(totals, "user_id").filter(left > 0).select(F.col("instance").alias("user_id"), mean.alias("vector"))
    candidates = vectors.join(docs.select(F.col("doc").alias("item_id")), "item_id", "left_semi")
    most = known.agg(F.max("m")).first()[0] or 0
    near = top_k_cosine(asked, candidates, top + most).select(F.col("user_id").alias("instance"), F.col("item_id").alias("doc"), F.round("score", 9).alias("score"))
    by_vector = lists(left_out.select("instance", "user_id", "held").join(near, "instance"))

    found = cut(by_terms.withColumn("method", F.lit("bm25")).unionByName(by_vector.withColumn("method", F.lit("embedding"))).select("method", "instance", "user_id", "held", "doc", "rank"))
    fused = found.groupBy("instance", "user_id", "held", "doc").agg(F.round(F.sum(1.0 / (F.col("rank") + FUSION)), 12).alias("score"))
    hybrid = _first(fused, ["instance"], "score", top).withColumn("method", F.lit("hybrid")).select(*found.columns)
    hits = found.unionByName(hybrid).filter("doc = held").select("method", "user_id", "held", "rank")

    every = known.groupBy("user_id").agg(F.max("m").alias("m"))
    sizes = every.agg(F.count("*").alias("users"), F.sum("m").alias("instances"))
    per = hits.select("method", "user_id", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k")).groupBy("method", "user_id", "k").agg(F.count("*").alias("n"))
    got = per.join(every, "user_id").groupBy("method", "k").agg(F.sum(F.col("n") / F.col("m")).alias("share"), F.count("*").alias("hit"))
    return got, sizes


def leave_one_out(clicks: DataFrame, docs: DataFrame, vectors: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(method, k, recall, hit_rate, users, instances) of bm25, embedding and hybrid retrieval.

    Every item that a user clicked is left out in turn; the user's other items
    make the query (their terms together; the mean of their vectors) and aren't
    candidates. recall: a user's share of items found among the first k, averaged over
    users; hit_rate: the share of users with one found. Users count from two
    different known items on. clicks: user_id, item_id; docs: doc, terms
    array<string>; vectors: item_id, vector. Ties go to the smaller id. Clicks without a
    user are nobody's; null terms are none.

    Documents of up to _HELD numbers in all go to every task, which ranks a user's
    lists in memory: only users and their items are shuffled. More are joined.
    """
    clicks = clicks.filter("user_id IS NOT NULL").select("user_id", "item_id")
    docs = docs.select("doc", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    known = vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector")).join(docs.select(F.col("doc").alias("item_id")), "item_id", "left_semi")
    n, different, terms = docs.agg(F.count("*"), F.count_distinct("doc"), F.sum(F.size("terms"))).first()
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    rows, items, holes, short, long = known.agg(F.count("*"), F.count_distinct("item_id"), F.count_if(odd), *[f(F.expr("nullif(size(vector), 0)")) for f in (F.min, F.max)]).first()
    # vectors of different lengths meet over the shorter one: not in one matrix
    plain = n == different and rows == items and not holes and short == long
    if plain and n + (terms or 0) + n * (long or 0) <= _HELD:
        got, sizes = _sums_held(clicks, docs, known, [r["doc"] for r in docs.select("doc").orderBy("doc").collect()], ks)
    else:
        got, sizes = _sums_joined(clicks, docs, vectors, ks)
    grid = sizes.select("*", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method")).select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    ratio = lambda c: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.col("users")), F.lit(0.0))
    return grid.join(got, ["method", "k"], "left").select("method", "k", ratio("share").alias("recall"), ratio("hit").alias("hit_rate"), "users", F.coalesce("instances", F.lit(0)).alias("instances"))
