"""Leave-one-out retrieval against a plain version."""

import math
import random

from pyspark.sql import functions as F

from rivulet.operators.recall import leave_one_out


def plain(clicks, docs, vectors, ks):
    top, n = max(ks), len(docs)
    mean_len = sum(map(len, docs.values())) / n
    df = {t: sum(t in ts for ts in docs.values()) for ts in docs.values() for t in ts}

    def bm(doc, query):
        s = 0.0
        for t in query:
            f = docs[doc].count(t)
            s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(docs[doc]) / mean_len))
        return round(s, 9)

    def cos(a, b):
        s = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / s, 9) if s else 0.0

    def best(scores):
        return [d for d, _ in sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:top]]

    by = {}
    for u, i in clicks:
        if i in docs:
            by.setdefault(u, set()).add(i)
    by = {u: s for u, s in by.items() if len(s) > 1}
    out = {(m, k): [0.0, 0] for m in ("bm25", "embedding", "hybrid") for k in ks}
    for items in by.values():
        counts = dict.fromkeys(out, 0)
        for held in items:
            others = items - {held}
            cand = [d for d in docs if d not in others]
            a = best({d: bm(d, {t for o in others for t in docs[o]}) for d in cand})
            vs = [vectors[o] for o in others if o in vectors]
            b = best({d: cos([sum(x) / len(vs) for x in zip(*vs, strict=True)], vectors[d]) for d in cand if d in vectors}) if vs else []
            fused = {}
            for ranked in (a, b):
                for r, d in enumerate(ranked):
                    fused[d] = fused.get(d, 0) + 1 / (61 + r)
            for m, ranked in (("bm25", a), ("embedding", b), ("hybrid", best({d: round(s, 12) for d, s in fused.items()}))):
                for k in ks:
                    counts[m, k] += held in ranked[:k]
        for key, c in counts.items():
            out[key][0] += c / len(items)
            out[key][1] += c > 0
    users = len(by)
    return {key: (r / users if users else 0.0, h / users if users else 0.0, users, sum(map(len, by.values()))) for key, (r, h) in out.items()}


def result(spark, clicks, docs, vectors, ks):
    got = leave_one_out(
        spark.createDataFrame(clicks, "user_id string, item_id string"), spark.createDataFrame(list(docs.items()), "doc string, terms array<string>"),
        spark.createDataFrame(list(vectors.items()), "item_id string, vector array<double>"), ks,
    )
    return {(r["method"], r["k"]): (r["recall"], r["hit_rate"], r["users"], r["instances"]) for r in got.collect()}


def test_leave_one_out(spark):
    rng = random.Random(4)
    docs = {f"i{n:02d}": [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))] for n in range(30)}
    vectors = {d: [rng.gauss(0, 1) for _ in range(3)] for d in docs if rng.random() < 0.8} | {"unknown": [1.0, 0.0, 0.0]}
    clicks = [(f"u{rng.randint(0, 7)}", f"i{rng.randint(0, 33):02d}") for _ in range(50)] + [("solo", "i01")]
    got, want = result(spark, clicks, docs, vectors, (2, 5)), plain(clicks, docs, vectors, (2, 5))
    assert got.keys() == want.keys()
    for key in got:
        assert got[key][2:] == want[key][2:] and math.isclose(got[key][0], want[key][0], abs_tol=1e-9) and math.isclose(got[key][1], want[key][1], abs_tol=1e-9), key


def test_nobody_to_leave_out(spark):
    got = result(spark, [("u", "i")], {"i": ["a"]}, {"i": [1.0]}, (5,))
    assert got == {(m, 5): (0.0, 0.0, 0, 0) for m in ("bm25", "embedding", "hybrid")}


def test_scores_of_copies_are_not_shuffled(spark, monkeypatch):
    from rivulet.operators import measures

    rng = random.Random(5)
    names = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))] for _ in range(8)]
    docs = {i: names[i % 8] for i in range(8000)} | {8000: [], 8001: ["z"]}
    df = spark.createDataFrame(list(docs.items()), "doc bigint, terms array<string>").repartition(4)
    asked = [(q, t) for q in range(0, 8000, 100) for t in sorted(set(docs[q]))] + [(8001, None), (8001, "z"), (8002, "no")]
    queries = spark.createDataFrame(asked, "query bigint, term string")
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    held = {t: sum(t in d for d in docs.values()) for t in "abcdefghz"}
    part = lambda t, d: math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean))
    want = {(q, i): sum(part(t, d) for t in set(docs[q]) if t in d) for q in [*range(0, 8000, 100), 8001] for i, d in docs.items() if set(d) & set(docs[q])}
    written = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    measures.bm25(df, queries).write.format("noop").mode("overwrite").save()
    assert written() - before < 1_000_000
    for pairs in (10**6, 0):
        monkeypatch.setattr(measures, "_FEW_PAIRS", pairs, raising=False)
        got = [(r["query"], r["doc"], r["score"]) for r in measures.bm25(df, queries).collect()]
        assert len(got) == len(want) and all(math.isclose(s, want[q, i], abs_tol=1e-9) for q, i, s in got)


def test_scores_of_one_small_file_are_dealt_out(spark, monkeypatch):
    from rivulet.operators import measures

    names = [["a", "b"], ["b", "c", "b"], ["d"], ["c", "a"]]
    docs = spark.createDataFrame([(i, names[i * i % 7 % 4]) for i in range(400)], "doc bigint, terms array<string>").coalesce(1)
    queries = docs.filter("doc % 2 = 0").select(F.col("doc").alias("query"), F.explode(F.array_distinct("terms")).alias("term"))
    want = {(r["query"], r["doc"]): round(r["score"], 6) for r in measures.bm25_each(docs, queries).collect()}
    # one task for all, then tasks of 5,000 pairs and packs of 3 queries, no more tasks than are allowed, and no classes
    for pairs, most, pack, classes, tasks in ((10**9, 100, 1024, 10**6, 1), (5_000, 100, 3, 10**6, 16), (5_000, 7, 3, 10**6, 7), (5_000, 100, 3, 0, None)):
        for name, value in (("_TASK_PAIRS", pairs), ("_MOST_TASKS", most), ("_PACK", pack), ("_FEW_PAIRS", classes)):
            monkeypatch.setattr(measures, name, value, raising=False)
        found = measures.bm25(docs, queries, digits=6)
        assert tasks in (None, found.rdd.getNumPartitions())
        rows = found.collect()
        assert len(rows) == len(want) and {(r["query"], r["doc"]): r["score"] for r in rows} == want


def test_search_rounds_no_row_of_its_result(spark, monkeypatch):
    from rivulet.plans import catalogue

    docs = spark.createDataFrame([(i, "a b" if i % 3 else "a c") for i in range(0, 1000, 50)], "p_partkey bigint, p_name string")
    monkeypatch.setattr(catalogue, "table", lambda *_: docs)
    found = catalogue.QUERIES["bm25_scores"](spark, "")
    rows = found.collect()
    assert len(rows) == 10 * 20 and all(r["score"] == round(r["score"], 6) for r in rows)
    made = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(queries")
    assert len(made) == 2 and "round(" not in made[0] and "round(" in made[1]


def test_lists_are_made_where_the_items_are(spark, monkeypatch):
    from rivulet.operators import recall

    rng = random.Random(6)
    docs = {f"i{n:02d}": [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 8))] for n in range(40)}
    vectors = {d: [rng.gauss(0, 1) for _ in range(3)] for d in docs if rng.random() < 0.8}
    clicks = [(f"u{u}", f"i{n:02d}") for u in range(20) for n in rng.sample(range(44), 12)]
    clicks += [(f"twin{u}", i) for u, i in clicks if u < "u2"]
    want = plain(clicks, docs, vectors, (2, 5))
    # nobody's clicks, and documents without terms
    clicks, docs = clicks + [(None, "i01"), (None, "i02")], {d: ts or None for d, ts in docs.items()}
    written = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    for held, scores in ((10**6, 1 << 20), (10**6, 100), (0, 1)):
        monkeypatch.setattr(recall, "_HELD", held, raising=False)
        monkeypatch.setattr(recall, "_SCORES", scores, raising=False)
        before = written()
        got = result(spark, clicks, docs, vectors, (2, 5))
        assert got.keys() == want.keys() and (not held or written() - before < 40_000), written() - before
        for key in got:
            assert got[key][2:] == want[key][2:] and math.isclose(got[key][0], want[key][0], abs_tol=1e-9) and math.isclose(got[key][1], want[key][1], abs_tol=1e-9), key
