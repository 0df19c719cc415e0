"""Odd inputs of all operators and stages, bounds that must not show, and operators against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rivulet.llm import decontam, langid, linededup, mixing, nearcopies, sharding, simhash, suffixdedup, toxicity, urlfilter, winnowing

WORDS = "the of and anon theon erthe tion blea ndre esin oath wher inan stre edon".split()
#: Columns that operators make themselves, or use inside.
CLASHES = ["_key", "_drops", "kept", "n_lines", "p_toxic", "lang_pred", "score", "slot", "shard", "rv_lang", "rv_score", "key", "bucket", "positions", "h", "own", "line", "_rv_key", "_rv__key", "root", "component", "size", "fingerprint", "host", "rule"]
ITEM = "a benchmark question that is quite long and should not be seen in training"


def words(r, n):
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def long_text(r):
    return words(r, 60_000) + "\n" + "z" * 50_000 + " " * 50_000 + ITEM


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and keys, clashing names."""
    r = random.Random(1)
    same = words(r, 40)
    rows = [(None, None, None, None), (1, "", None, "a"), (2, " \n\t", "en", None), (3, same, "en", "a"), (3, same, "en", "a"), (3, words(r, 30), None, "b"), (None, same, "en", "a"), (None, same, "en", "a"), (4, same, "en", "a"), (5, long_text(r), "en", "b")]
    rows += [(10 + i, words(r, 30), "en" if i % 2 else "fr", "ab"[i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "what is it")], "item_id bigint, text string")


def chain():
    return toxicity.Chain(("toxic",), [toxicity.Linear(np.empty(0, np.uint32), np.empty(0), np.empty(0), 0.0)])


OPERATORS = {
    "language": lambda d, i: langid.identify(d, langid.learn(d)),
    "sharding": lambda d, i: sharding.assign_shards(d),
    "simhash": lambda d, i: simhash.near_duplicates(d),
    "near_copies": lambda d, i: nearcopies.near_copies(d),
    "drop_near_copies": lambda d, i: nearcopies.drop_near_copies(d),
    "winnowing": lambda d, i: winnowing.fingerprint(d),
    "edits": lambda d, i: winnowing.fingerprint_edits(d),
    "leaks": lambda d, i: decontam.find_leaks(d, i),
    "drop_leaks": lambda d, i: decontam.drop_leaks(d, i),
    "lines": lambda d, i: linededup.LineIndex.build(d).dedup(d),
    "plan": lambda d, i: mixing.plan_mix(d),
    "mix": lambda d, i: mixing.mix(d),
    "urls": lambda d, i: urlfilter.judge_urls(d, key="doc_id", url="text"),
    "toxicity": lambda d, i: toxicity.predict(d, toxicity.learn(d.withColumn("toxic", F.lit(1)), ("toxic",))),
    "passages": lambda d, i: suffixdedup.remove_repeats(d),
}
#: Rows that come out of `odd`: as many as went in, but for operators that drop rows.
KEPT = {"near_copies": 19, "drop_near_copies": None, "leaks": None, "drop_leaks": None, "mix": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, items, name):
    got = OPERATORS[name](odd, items).collect()
    want = KEPT.get(name, odd.count())
    assert want is None or len(got) == want
    assert OPERATORS[name](odd.limit(0), items).count() == 0


STAGES = dict(pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_odd_rows(spark, odd, items, tmp_path, name):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = STAGES[name](spark, odd, str(tmp_path))
    rows = got.collect()
    assert rows and STAGES[name](spark, odd.limit(0), str(tmp_path)).count() == 0
    if name != "shards":
        assert got.columns == odd.columns and all(r["_key"] == 7 for r in rows)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    if name == "language":
        assert {k for none, k in ids if not none} == {3, 4, 5, *range(10, 22)} and sum(none for none, _ in ids) == 2
    if name == "near_copies":
        # 1 and 2 have no words; 4 is like 3, both rows of 3 stay, and rows without a key
        assert sorted(k for none, k in ids if not none) == [1, 3, 3, 3, 5, *range(10, 22)] and sum(none for none, _ in ids) == 3
    if name == "benchmark_leaks":
        assert 5 not in {k for _, k in ids} and len(ids) == odd.count() - 1
    if name == "shards":
        assert len(rows) == odd.count() and len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 ½", None), (3, None, None)], "doc_id bigint, text string, lang string")
    with pytest.warns(UserWarning, match="no labelled"):
        assert [r["doc_id"] for r in pipeline.language(spark, docs, "").collect()] == [1]


# --- language


def plain_profile(texts, most=langid.PROFILE):
    from collections import Counter

    n = Counter()
    for t in texts:
        letters = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        if letters.strip():
            for size in (1, 2, 3):
                for i in range(len(letters) - size + 1):
                    g = letters[i : i + size]
                    if not (g == " " or size == 3 and g[1] == " "):
                        n[g] += 1
    packed = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], packed(x[0])))[:most]]


def test_language_equals_out_of_place_distance(spark):
    r = random.Random(4)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "äbcdéfgh"}
    text = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(f"{x}{i}", text(alphabets[x], 30), x) for x in alphabets for i in range(6)]
    model = langid.learn(spark.createDataFrame(rows + rows[:3], "id string, text string, lang string"))
    profiles = {x: plain_profile([t for _, t, k in rows if k == x]) for x in alphabets}
    for _ in range(40):
        t = text(r.choice([*alphabets.values(), "abcdefghijklé"]), r.randint(1, 15)) + r.choice(["", " 12 ½ Ⅷ", "\n\n", "X-Y"])
        own = plain_profile([t])
        far = {x: sum(abs(i - p.index(g)) if g in p else langid.PROFILE for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert model.predict(t) == (best, pytest.approx(1 - far[best] / (langid.PROFILE * len(own))))


@pytest.mark.parametrize("text", ["½", "²", "① ②", "Ⅷ", "12 _ !", "", None, "़"])
def test_signs_are_no_letters(text):
    model = langid.Profiles({"aa": np.array([97], np.uint64)})
    assert model.predict(text) == ("und", 0.0)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_blocks_do_not_show_in_ngrams(block):
    text = "The Émile, the end-of 3 émiles ΣΑΣ " * 5 + "½x" * 9
    want, got = langid._grams(text), langid._grams(text, block)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_samples_are_bounded_and_of_different_texts(spark):
    hot = spark.range(3000).select(F.lit("hot text again").alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("toxic"))
    rest = spark.range(40).select(F.concat(F.lit("text number "), "id").alias("text"), F.lit("en").alias("lang"), F.lit(0).alias("toxic"))
    assert len(langid.learn(hot.union(rest), sample=10).langs) == 1
    seen = []
    real = toxicity.fit_chain
    toxicity.fit_chain = lambda rows, *more, **kw: seen.append(len(rows)) or real(rows, *more, **kw)
    try:
        toxicity.learn(hot.union(rest), ("toxic",), sample=10)
        toxicity.learn(hot.union(rest), ("toxic",))
    finally:
        toxicity.fit_chain = real
    assert seen == [10, 41]


# --- decontamination


@pytest.mark.parametrize("piece", [64, 300, 5000, 1 << 20])
def test_pieces_do_not_show_in_leaks(piece):
    r = random.Random(piece)
    texts, items = [], [(1, ITEM), (2, "What is the capital of France?"), (3, "seven wizards"), (4, "word")]
    for _ in range(30):
        t = words(r, r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            leak = r.choice(items)[1]
            at = r.randint(0, len(t))
            t = t[:at] + r.choice([" ", "x", ""]) + (" " * r.choice([1, 1, 700])).join(leak.split()) + r.choice([" ", "s", "."]) + t[at:]
        texts.append(t.encode())
    index = decontam.Index(items)
    assert list(decontam.matches(index, texts, piece)) == list(decontam.matches(index, texts, 1 << 30))


def test_short_items_stand_word_for_word(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "To be?"), (3, "yes"), (4, "a b")], "item_id bigint, text string")
    rows = [(1, "Q: what is   the CAPITAL of France. Paris"), (2, "what is the capital of Frances"), (3, "to be or not to be"), (4, "yes, no"), (5, "x" * 5000 + " what is the capital of france"), (6, "xa b"), (7, "a b")]
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["length"]) for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items, piece=64).collect()}
    assert got == {(1, 1): (3, 31), (3, 2): (0, 5), (5, 1): (5001, 29), (7, 4): (0, 3)}


def test_leak_across_wide_blanks():
    index = decontam.Index([(1, ITEM)])
    text = ("w " * 500_000 + (" " * 2000).join(ITEM.split()) + " w" * 10).encode()
    assert [(m[1], m[2]) for m in decontam.matches(index, [text])] == [(0, 0)]


# --- toxicity


def test_chain_equals_plain_chain():
    """Models of the chain fitted one by one, with probabilities from folds that leave the row out."""
    r = random.Random(7)
    texts = [" ".join(r.choices(WORDS, k=12) + ["bad"] * (i % 4 == 0) + ["junk"] * (i % 3 == 0)) for i in range(90)]
    rows = [toxicity.words(t.encode()) for t in texts]
    labels = np.array([[int(i % 3 == 0), int(i % 4 == 0) if i % 7 else -1] for i in range(90)])
    fold = np.arange(90) % 3
    chain = toxicity.fit_chain(rows, fold, labels, ("junk", "toxic"))

    def fit(use, k, before):
        return toxicity.fit([rows[i] for i in use], before[use], labels[use, k].astype(float))

    none = np.zeros((90, 0))
    first = fit(np.arange(90), 0, none)
    unseen = np.zeros(90)
    for f in range(3):
        m = fit(np.flatnonzero(fold != f), 0, none)
        for i in np.flatnonzero(fold == f):
            unseen[i] = m.score(rows[i], [])
    known = np.flatnonzero(labels[:, 1] >= 0)
    second = fit(known, 1, unseen[:, None])
    for t in (*texts[:20], "", "bad junk", "words unseen"):
        found = toxicity.words(t.encode())
        p = first.score(found, [])
        assert chain.predict(t.encode()) == [p, second.score(found, [p])]


def test_cutoff_has_the_best_f1():
    r = np.random.default_rng(5)
    for _ in range(30):
        p, y = np.round(r.random(40), 1), r.integers(0, 2, 40)
        f1 = lambda t: 2 * (y[p >= t].sum()) / max(1, (p >= t).sum() + y.sum())  # noqa: B023, E731
        assert y.min() == y.max() or f1(toxicity.best_cutoff(p, y)) == pytest.approx(max(f1(t) for t in np.unique(p)))
    assert toxicity.best_cutoff(np.array([0.1, 0.2]), np.array([0, 0])) == 0.5 == toxicity.best_cutoff(np.empty(0), np.empty(0))


def test_gradient_is_that_of_the_loss():
    """A fitted model is where the penalised log loss hardly falls any more."""
    r = random.Random(3)
    rows = [toxicity.words(" ".join(r.choices(WORDS, k=5) + ["bad"] * (i % 2)).encode()) for i in range(60)]
    y = np.arange(60) % 2
    m = toxicity.fit(rows, np.zeros((60, 0)), y.astype(float), steps=4000)

    def loss(weights, bias):
        total = 0.5 * 0.1 * (weights**2).sum()
        for x, t in zip(rows, y, strict=True):
            z = bias + weights[np.isin(m.words, x)].sum()
            total += math.log1p(math.exp(-z if t else z))
        return total

    base = loss(m.weights, m.bias)
    for i in range(len(m.weights)):
        for step in (-0.05, 0.05):
            other = m.weights.copy()
            other[i] += step
            assert loss(other, m.bias) > base - 5e-3


# --- passages and lines


def test_blocks_do_not_show_in_passages(spark, monkeypatch):
    r = random.Random(2)
    shared = words(r, 60)
    rows = [(i, words(r, 40) + shared + words(r, 40)) for i in range(6)] + [(9, shared * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    take = lambda: sorted(tuple(x) for x in suffixdedup.remove_repeats(df).collect())
    want = take()
    for block in (64, 500):
        whole = list(suffixdedup.blocks((shared * 3).encode()))
        monkeypatch.setattr(suffixdedup, "_BLOCK", block)
        parts = list(suffixdedup.blocks((shared * 3).encode()))
        assert sum(int(p[2].sum()) for p in parts) == sum(int(p[2].sum()) for p in whole)
        monkeypatch.undo()
    assert take() == want


def test_frequent_anchors_change_nothing(spark, monkeypatch):
    r = random.Random(6)
    line = words(r, 12)
    rows = [(i, words(r, 20) + line + words(r, 20)) for i in range(60)] + [(100 + i, words(r, 25) + line) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    take = lambda: sorted(tuple(x) for x in suffixdedup.remove_repeats(df).collect())
    want = take()
    real = suffixdedup._frequent
    found = []
    monkeypatch.setattr(suffixdedup, "_frequent", lambda whole, span: found.append(real(whole, span, 1, 3)) or found[-1])
    assert take() == want and len(found[0])


def test_lines_are_cut_in_linear_time_and_filters_follow_keys(spark):
    lines = [f"a line that is long enough to count, number {i}" for i in range(3000)]
    df = spark.createDataFrame([(k, "\n".join(lines)) for k in (1, 2, 3)], "doc_id bigint, text string")
    index = linededup.LineIndex.build(df, shards=5)
    got = {r["doc_id"]: (r["n_dropped"], len(r["kept"])) for r in index.dedup(df).collect()}
    assert got == {1: (3000, 0), 2: (3000, 0), 3: (0, len("\n".join(lines)))}
    assert index.filters.count() == 5
    assert {r["doc_id"]: r["n_dropped"] for r in index.dedup(df, most_bytes=0).collect()} == {1: 3000, 2: 3000, 3: 0}


def test_filters_hold_all_that_is_put_in():
    r = np.random.default_rng(3)
    for n in (0, 1, 60, 5000, 60_000):
        xs = r.integers(0, 1 << 63, n, dtype=np.uint64)
        f = linededup.FilterSet({0: linededup.CuckooFilter.build(xs).dump()}, 1)
        assert f.contains(xs, np.zeros(n, np.int64)).all()
    assert f.contains(r.integers(0, 1 << 63, 10_000, dtype=np.uint64), np.zeros(10_000, np.int64)).mean() < 0.01


# --- pipeline


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """All five stages over one table, against plain versions applied one after the other."""
    from test_llm import jaccard_components

    r = random.Random(8)
    text = lambda n, letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(n))
    rows = [(i, text(50, "abcdefgh"), "aa", f"s{i % 3}") for i in range(25)] + [(30 + i, text(50, "ijklmnop"), "bb", f"s{i % 3}") for i in range(15)]
    near = rows[4][1].split()
    near[20] = "changed"
    rows += [(50, " ".join(near), "aa", "s1"), (51, rows[7][1].upper(), "aa", None), (52, text(50, "qrstuvwxyz"), None, "s0"), (53, "123 ½", None, "s1"), (54, None, "aa", "s2"), (55, text(20, "abcdefgh") + " " + ITEM + " " + text(20, "abcdefgh"), "aa", "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    profiles = {x: plain_profile([t for _, t, k, _ in rows if k == x and t]) for x in ("aa", "bb")}

    def fits(t):
        own = plain_profile([t or ""])
        far = min((sum(abs(i - p.index(g)) if g in p else langid.PROFILE for i, g in enumerate(own)) for p in profiles.values()), default=0)
        return bool(own) and 1 - far / (langid.PROFILE * len(own)) >= pipeline.LEAST_SCORE

    kept = [x for x in rows if fits(x[1])]
    comp = jaccard_components([x[:2] for x in kept])
    kept = [x for x in kept if comp[x[0]] == x[0]]
    kept = [x for x in kept if re.sub(r"\W+", " ", ITEM) not in re.sub(r"\W+", " ", x[1].lower())]
    plan = {x["doc_id"]: x["copies"] for x in mixing.plan_mix(spark.createDataFrame(kept, df.schema)).collect()}
    assert sorted(x["doc_id"] for x in got) == sorted(k for k, n in plan.items() for _ in range(n)) and {50, 51, 52, 53, 54, 55}.isdisjoint(plan)
    owner = sharding.fill_table(pipeline.SHARDS)
    assert all(x["shard"] == owner[x["slot"]] and x["shard_name"] == pipeline.SHARDS[x["shard"]] for x in got)


def test_edges_to_the_least_connect_the_same():
    import pyarrow as pa

    r = np.random.default_rng(9)
    for _ in range(20):
        edges = sorted({(int(b), int(a)) for a, b in r.integers(0, 30, (60, 2)) if a < b})
        at = r.integers(1, len(edges))
        batches = [pa.RecordBatch.from_arrays([pa.array([a for _, a in x], pa.int64()), pa.array([b for b, _ in x], pa.int64())], ["a", "b"]) for x in (edges[:at], edges[at:])]
        got = [(a, b) for x in nearcopies._to_least(iter(batches)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]

        def roots(pairs):
            up = list(range(30))
            for _ in range(30):
                for a, b in pairs:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        assert roots(got) == roots([(a, b) for b, a in edges]) and all(a < b for a, b in got)


def test_texts_that_are_not_drawn_stay_where_they_are(spark, tmp_path, monkeypatch):
    from rivulet.llm import queries

    r = random.Random(3)
    texts = [(i, " ".join(f"{r.getrandbits(64):x}" for _ in range(200))) for i in range(1500)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1500)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    real = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a, **kw: real(*a, sample=20, **kw))
    written = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert queries.op9_toxicity(spark, str(tmp_path)).count() == 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    size = sum(len(t) for _, t in texts)
    assert 0 < written() - before < size / 4
