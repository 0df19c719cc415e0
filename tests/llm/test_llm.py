"""The corpus operators on small tables with nulls, empties, ties, repeats and clashing names, against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontam, langid, linededup, mixing, nearcopies, sharding, simhash, suffixdedup, toxicity, urlfilter, winnowing
from rivulet.llm.components import connected_components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, slot string"
WORDS = "the of and anon theon erthe tion blea ndre esin oath wher inan stre edon".split()


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, None, 1, "x") for k, t, lang, s in rows], DOC)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    shared = text(40)
    rows = [(i, text(r.randint(1, 200)) + "\n" + text(8), "en", f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, rows[i][1], "en", "s0") for i in range(5)]
    rows += [(50 + i, text(20) + " " + shared + " " + text(20), "en", None) for i in range(6)]
    rows += [(60, None, None, None), (61, "", "en", "s1"), (62, "   \n\t", "en", "s1"), (63, "über straße größe", "de", "s1"), (64, "aaaa" * 400, "en", "s2"), (65, rows[3][1] + " tail", "en", "s2")]
    return rows


def test_language(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8)]
    model = langid.learn(docs(spark, rows))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, [(1, "the dog", None, None), (2, "die hunde und", None, None), (3, None, "en", None), (4, "12 !", "en", None), (5, "the " * 100_000, None, None)]), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.learn(docs(spark, rows).limit(0)).predict("abc") == ("und", 0.0)
    assert langid.identify(docs(spark, rows).limit(0), model).count() == 0


def test_language_profiles_equal_plain_counts():
    text = "The Émile, the end-of 3 émiles"
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            g = letters[i : i + n]
            if not (n == 1 and g == " ") and not (n == 3 and g[1] == " "):
                want[g] = want.get(g, 0) + 1
    grams, counts = langid._grams(text)
    unpack = lambda g: "".join(chr(int(g) >> s & 0x1FFFFF) for s in (0, 21, 42)).rstrip("\0")
    assert {unpack(g): int(n) for g, n in zip(grams, counts, strict=True)} == want


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    t = sharding.fill_table(names, 251)
    sizes = [t.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill_table(names[:6], 251)
    assert sum(a != b for a, b in zip(t, fewer, strict=True) if a != 6) < 251 * 0.25
    for bad in (250, 5):
        with pytest.raises(ValueError):
            sharding.fill_table(names, bad)
    rows = docs(spark, [(1, "a", None, None), (1, "b", None, None), (None, None, None, None)])
    got = sharding.assign_shards(rows, shards=names, slots=251).collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and isinstance(got[0]["slot"], int)
    assert sharding.assign_shards(rows.limit(0), shards=names, slots=251).count() == 0


def components(prints, limit):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit,bucket", [(4, 4096), (4, 16), (3, 64), (1, 4096), (0, 4096)])
def test_links_are_whole(spark, limit, bucket):
    r = random.Random(limit)
    prints = {}
    for c in range(12):
        base = r.getrandbits(64)
        for _ in range(25):
            x = base
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
            prints[len(prints)] = x
    first = {}
    for i, x in prints.items():
        first.setdefault(x, i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    reps = spark.createDataFrame([(i, signed(x)) for x, i in first.items()], "id bigint, print bigint")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(reps, limit, bucket)).collect()}
    want = components({i: x for x, i in first.items()}, limit)
    assert {i: got.get(i, i) for i in want} == want


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tc d e\x0bF ä"
    w = re.findall(r"[^\x20\x09-\x0D]+", text.replace("A", "a").replace("F", "f"))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(b"x y") == xxhash.xxh64_intdigest(b"x y", 42) and simhash.fingerprint(None) == 0 == simhash.fingerprint(b" \n")


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs(spark, corpus)).collect()}
    assert got == components({k: simhash.fingerprint((t or "").encode()) for k, t, *_ in corpus}, 4)
    odd = docs(spark, [(None, "a b c d e", None, None), (None, None, None, None), (7, "a b c d e", None, None)])
    assert sorted((r["doc_id"] or -1, r["component"] or -1) for r in simhash.near_duplicates(odd).collect()) == [(-1, -1), (-1, 7), (7, 7)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def jaccard_components(rows, words=5, least=0.8):
    """Roots by comparing all pairs of word-shingle sets."""
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("bucket,block", [(4096, 4096), (12, 7)])
def test_near_copies(spark, corpus, bucket, block):
    r = random.Random(17)
    rows = [(k, t) for k, t, *_ in corpus]
    for c in range(8):
        base = [r.choice(WORDS) + r.choice(WORDS) for _ in range(150)]
        for i in range(30):
            own = list(base)
            for at in r.sample(range(150), r.randint(0, 2)):
                own[at] = f"other{r.randint(0, 999)}"
            rows.append((100 + c * 40 + i, " ".join(own)))
        # half of the words are new: no near copy
        rows.append((100 + c * 40 + 35, " ".join(base[:75] + [r.choice(WORDS) + r.choice(WORDS) for _ in range(75)])))
    rows += [(600, "few words"), (601, "Few\nWORDS"), (602, "few words more"), (603, rows[0][1].upper())]
    table = docs(spark, [(k, t, "en", "s") for k, t in rows])
    got = {x["doc_id"]: x["component"] for x in nearcopies.near_copies(table, bucket=bucket, block=block).collect()}
    assert got == jaccard_components(rows)
    kept = {x["doc_id"] for x in nearcopies.drop_near_copies(table, bucket=bucket, block=block).collect()}
    assert kept == {k for k, c in got.items() if k == c}
    odd = docs(spark, [(None, "a b c d e", None, None), (None, None, None, None), (7, "a b c d e", None, None), (7, "a b c d e", None, None)])
    assert nearcopies.drop_near_copies(odd).count() == 4 and nearcopies.near_copies(odd.limit(0)).count() == 0
    assert nearcopies.drop_near_copies(odd).columns == odd.columns


def test_near_copies_at_the_similarity():
    """Of random pairs just at 0.8 and at 0.85, how many meet in a bucket within the limit."""
    r = np.random.default_rng(4)
    lay = nearcopies.layout(1)
    for least, new in ((0.95, 111), (0.98, 81)):
        found = 0
        for _ in range(150):
            both = r.integers(0, 1 << 63, 1000, np.uint64)
            sides = [np.unique(np.concatenate([both[new:], r.integers(0, 1 << 63, new, np.uint64)])) for _ in range(2)]
            prints = np.array([nearcopies.wide_print(x)[:-1] for x in sides], np.int64)
            number, one, two = (x.reshape(-1) for x in nearcopies.ring_keys(prints, lay))
            order = np.argsort(number, kind="stable")
            found += any(True for _ in nearcopies.bucket_edges(number[order], one[order], two[order], lay))
        assert found >= least * 150


def test_buckets_are_spanned():
    r = np.random.default_rng(9)
    one = np.repeat(r.integers(0, 1 << 48, 6, np.uint64), 200) ^ np.uint64(1) << r.integers(0, 48, 1200).astype(np.uint64)
    two = np.repeat(r.integers(0, 1 << 63, 6, np.uint64), 200) ^ np.uint64(1) << r.integers(0, 60, 1200).astype(np.uint64)
    for number in (np.zeros(1200, np.int64), np.repeat(np.arange(3), 400), np.sort(r.integers(0, 300, 1200))):
        pairs = {(a, b) for a in range(1200) for b in range(a + 1, 1200) if number[a] == number[b] and a // 200 == b // 200}
        found = list(nearcopies.bucket_edges(number, one, two, nearcopies.Layout(16, 5, 32)))
        assert len(found) < 1200 and all((min(e), max(e)) in pairs for e in found)
        # a forest with as many edges as members less groups spans every group
        assert len(found) == 1200 - len({(number[a], a // 200) for a in range(1200)})


def plain_units(text, long=winnowing.LONG):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        out += [w] if len(w) <= long else list(w)
    return out


def plain_prints(text, k=winnowing.K, window=winnowing.WINDOW, long=winnowing.LONG):
    """(hash, position) of winnowing, from the bytes of the text on: no gram's hash is taken from another's."""
    import xxhash

    h = [xxhash.xxh64_intdigest(u.encode(), 42) for u in plain_units(text, long)]
    turn = lambda x, by: (x << by | x >> (64 - by)) & ((1 << 64) - 1) if by % 64 else x
    grams = []
    for i in range(max(0, len(h) - k + 1) or int(bool(h))):
        g = 0
        for j, x in enumerate(reversed(h[i : i + k])):
            g ^= turn(x, j)
        grams.append(g)
    found = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        at = min(range(i, min(i + window, len(grams))), key=lambda j: (grams[j] >> 33, -j))
        if (at not in [p for _, p in found]):
            found.append((at, at))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(grams[p]), p) for _, p in found]


@pytest.mark.parametrize("k,window,long", [(4, 8, 32), (3, 5, 4), (7, 1, 32), (5, 6, 0)])
def test_winnowing_equals_plain(spark, corpus, k, window, long):
    extra = [(80, "漢字仮名交じり文" * 9, None, None), (81, "a b c", None, None), (82, "x" * 70 + " y z " + "q" * 33, None, None)]
    rows = docs(spark, corpus + extra).select("text", winnowing.chosen(F.col("text"), k, window, long).alias("c")).collect()
    for r in rows:
        text = r["text"] if long else " ".join(c for w in plain_units(r["text"], 10**9) for c in w)
        assert [(x["hash"], x["position"]) for x in r["c"]] == plain_prints(text, k, window, long or 1)


def test_winnowing_of_unspaced_text(spark):
    """One code point more in front leaves nearly all of an unspaced text's fingerprint as it was."""
    r = random.Random(12)
    han = "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(4000))
    both = docs(spark, [(1, han, None, None), (2, "一" + han, None, None)]).select("doc_id", winnowing.hash_set(winnowing.chosen(F.col("text"))).alias("h"))
    a, b = (set(x["h"]) for x in both.orderBy("doc_id").collect())
    assert len(a & b) >= 0.98 * len(a | b)


def test_likeness_equals_plain(spark, corpus):
    got = {r["doc_id"]: r for r in winnowing.fingerprint_edits(docs(spark, corpus)).collect()}
    order = sorted(corpus)
    share = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
    sets = lambda t: {h for h, _ in plain_prints(t)}
    for i, (k, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[k]["near_edited"] == share(sets(t), sets(edited)) and got[k]["near_next"] == share(sets(t), sets(nxt))


def test_edits_wrap_around_and_empty(spark, corpus):
    got = {r["doc_id"]: r for r in winnowing.fingerprint_edits(docs(spark, corpus)).collect()}
    order = sorted(corpus)
    for i, (k, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        assert got[k]["edited"] == t[: len(t) - h] + nxt[:h] and got[k]["n_chars"] == len(t)
        assert 0 <= got[k]["near_edited"] <= 1
    assert got[60]["near_edited"] == 1.0 == got[60]["near_next"]
    assert winnowing.fingerprint_edits(docs(spark, corpus).limit(0)).count() == 0
    assert winnowing.fingerprint_edits(docs(spark, [(1, "ab", None, None)])).first()["edited"] == "aa"
    assert winnowing.fingerprint_edits(docs(spark, [(1, "ab", None, None), (1, "ab", None, None), (None, "x", None, None)])).count() == 3


def edits_within(item, text):
    d = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(d[j - 1] + (c != x), d[j] + 1, new[-1] + 1))
        d = new
    return min(d)


def test_leaks_equal_plain_alignment():
    r = random.Random(5)
    letters = "abcdefgh "
    item = lambda n: "".join(r.choice(letters) for _ in range(n)).strip().replace("  ", " a")
    items = [(i, item(r.randint(45, 120))) for i in range(8)]
    texts = []
    for _ in range(60):
        t = list(r.choice(items)[1])
        for _ in range(r.randint(0, 16)):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], [r.choice(letters)], [t[at], r.choice(letters)]])
        texts.append(item(r.randint(0, 80)) + "".join(t) + item(r.randint(0, 60)))
    index = decontam.Index(items)
    got = {(d, index.ids[i][0]): e for d, i, e, *_ in decontam.matches(index, [t.encode() for t in texts])}
    plain = lambda t: decontam.normal(np.frombuffer(t.encode(), np.uint8))[0].tobytes()
    want = {}
    for d, t in enumerate(texts):
        for k, text in items:
            own = plain(text).strip()
            e = edits_within(own, plain(t))
            if e <= int(index.budget[index.texts.index(own)]):
                want[d, k] = e
    assert got == want


def test_leaks_table(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch."
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (1, item), (4, item.upper())], "item_id bigint, text string")
    rows = docs(spark, [(1, "x " * 30 + item + " y", None, None), (2, item.lower().replace(" ", " \n "), None, None), (3, "nothing here " * 20, None, None), (4, None, None, None), (None, item, None, None), (5, "z " * 900_000 + item, None, None)])
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["edits"], r["start"]) for r in decontam.find_leaks(rows, items, block_bytes=64).collect()))
    assert [g[:3] for g in got] == [(k, i, 0) for k in (0, 1, 2, 5) for i in (1, 4)] and {g[3] for g in got if g[0] == 5} == {1_800_000}
    assert sorted(r["doc_id"] or 0 for r in decontam.drop_leaks(rows, items).collect()) == [0, 3, 4]
    assert decontam.find_leaks(rows, items.limit(0)).count() == 0 and decontam.find_leaks(rows.limit(0), items).count() == 0


def test_cuckoo():
    r = np.random.default_rng(1)
    xs = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = linededup.CuckooFilter.build(xs)
    assert all(int(x) in f for x in xs[:500])
    gone = f.dump()
    assert f.remove(int(xs[0])) and f.add(int(xs[0]))
    g = linededup.CuckooFilter.load(gone)
    others = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert sum(int(x) in g for x in others) < 50
    s = linededup.FilterSet({3: gone}, 8)
    assert s.contains(xs, np.full(5000, 3)).all() and not s.contains(xs, np.full(5000, 4)).any()


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for k, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(k)
    return {k: "\n".join(x for x in (t or "").split("\n") if not (len(held.get(key(x), ())) >= 3 and k != max(held[key(x)]))) for k, t in rows}


def test_lines_and_reversal(spark):
    a, b = "A line that is long enough", "another LINE, long enough too"
    base = [(1, f"{a}\nx\n{a}"), (2, f"  {a.lower()} \n{b}"), (3, b), (4, None), (5, ""), (6, f"é{'ü' * 18}\né{'ü' * 18}"), (7, f"é{'ü' * 19}")]
    more = [(8, f"{a.upper()}\n{b}"), (9, f"é{'ü' * 19}"), (10, f"é{'ü' * 19}\r")]
    df = lambda rows: docs(spark, [(k, t, None, None) for k, t in rows])
    kept = lambda index, rows: {r["doc_id"]: r["kept"] for r in index.dedup(df(rows)).collect()}
    first = linededup.LineIndex.build(df(base), shards=4)
    assert kept(first, base) == plain_lines(base)
    after = first.changed(inserted=df(more))
    assert kept(after, base + more) == plain_lines(base + more)
    back = after.changed(deleted=df(more), held=df(base))
    assert kept(back, base) == plain_lines(base)
    assert kept(first.changed(deleted=df(base[:1]), held=df(base[1:])), base[1:]) == plain_lines(base[1:])
    assert kept(linededup.LineIndex.build(df(base), shards=4), base) == {r["doc_id"]: r["kept"] for r in first.dedup(df(base), most_bytes=0).collect()}
    empty = linededup.LineIndex.build(df(base).limit(0))
    assert empty.dedup(df(base).limit(0)).count() == 0 and kept(empty, base)[1] == base[0][1]


def test_mixing(spark, corpus):
    rows = {r["doc_id"]: r for r in mixing.plan_mix(docs(spark, corpus)).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for k, t, _, s in corpus:
        assert rows[k]["size"] == size(t) and rows[k]["taken"] <= 2 * size(t)
        by.setdefault(s, []).append(k)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(rows[k]["size"] for k in by[s]) for s in by}
    left, goal, open_ = 1.5 * sum(sizes.values()), {}, dict(zip(order, [3, 1, 2, 3], strict=False))
    while open_:  # share out, stop those above, share again
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * sizes[s]]
        for s in over or list(open_):
            goal[s] = 2 * sizes[s] if over else left * open_[s] / sum(open_.values())
        left -= sum(goal[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in goal}
    biggest = max(rows[k]["size"] for k in rows)
    for s in by:
        assert all(abs(rows[k]["target"] - goal[s]) < 1e-6 for k in by[s])
        assert abs(sum(rows[k]["taken"] for k in by[s]) - goal[s]) <= biggest
    stream = [r["doc_id"] for r in mixing.mix(docs(spark, corpus)).collect()]
    assert len(stream) == sum(r["copies"] for r in rows.values()) and mixing.mix(docs(spark, corpus)).columns == docs(spark, corpus).columns
    assert mixing.plan_mix(docs(spark, corpus).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.plan_mix(docs(spark, [(1, None, None, None), (1, " ", None, "a"), (None, "", None, "a")])).collect()} == {0}


def test_urls(spark):
    rules = [("block", "org", "/"), ("allow", "a.org", "/x"), ("block", "b.a.org", "/x/y"), ("block", "com", "/de/"), ("allow", "a-b.org", "/")]
    urls = ["http://a.org/x/1", "https://B.A.ORG/x/yz?q#f", "http://org", "http://org/", "x", None, "http://c.com/de/1", "http://com/DE/", "ftp://aorg/x", "http://a-b.org/x", "://", "http://z.a.org?x/y", "http://.org/", "http://a.org./x"]

    def plain(u):
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S) if u and "://" in u else None
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame([(i, u, 9) for i, u in enumerate(urls)], "page_id bigint, url string, lane int")
    for block in (urlfilter.BLOCK_RULES, 2):
        urlfilter.BLOCK_RULES, old = block, urlfilter.BLOCK_RULES
        got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(df, rules, lanes=3).collect()}
        urlfilter.BLOCK_RULES = old
        assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in urlfilter.judge_urls(df, []).collect()} == {"allow"} and urlfilter.judge_urls(df.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((" ".join(r.choices(WORDS, k=30) + (["moron"] if bad else [])), int(i % 3 == 0), int(bad) if i % 7 else None))
    chain = toxicity.learn(spark.createDataFrame(rows, "text string, junk int, toxic int"), ("junk", "toxic"))
    assert chain.predict(b"the Moron, of and")[1] > 0.5 > chain.predict(b"the of and")[1] and len(chain.predict(None)) == 2
    got = toxicity.predict(docs(spark, [(1, "MORON", None, None), (2, None, None, None), (2, "", None, None)]), chain, ["doc_id"])
    assert got.filter("p_toxic >= 0.5").count() == 1 and got.count() == 3
    none = toxicity.learn(spark.createDataFrame([], "text string, toxic int"), ("toxic",))
    assert none.predict(b"moron") == [0.5]


def plain_removal(rows):
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[k] = (len(b), sum(mark), sum(1 for i in range(len(b)) if mark[i] and (not i or not mark[i - 1])), bytes(c for c, m in zip(b, mark, strict=True) if not m))
    return out


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_passages_equal_plain_removal(spark, corpus, heavy):
    rows = [(k, t) for k, t, *_ in corpus] + [(70, "ab" * 150), (71, "x" + "ab" * 120), (72, "é" * 80)]
    got = {r["key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixdedup.remove_repeats(docs(spark, [(k, t, None, None) for k, t in rows]).withColumnRenamed("doc_id", "key"), key="key", heavy=heavy).collect()}
    assert got == plain_removal(rows)


def test_passages_odd_keys(spark):
    long = "abcdefghij" * 20
    same = docs(spark, [(1, "q" * 10 + hashlib.sha512(b"1").hexdigest(), None, None)] * 2)
    assert {r["n_removed"] for r in suffixdedup.remove_repeats(same).collect()} == {0}
    nulls = docs(spark, [(None, long, None, None), (3, long, None, None)])
    assert sorted(r["n_removed"] for r in suffixdedup.remove_repeats(nulls).collect()) == [0, 190]
    assert suffixdedup.remove_repeats(nulls.limit(0)).count() == 0


def test_deep_shallow_order():
    r = random.Random(4)
    text = "".join(r.choice("ab") for _ in range(300)) * 3 + "\0" * 100
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array(r.sample(range(900), 400))
    order, rank = suffixdedup.deep_shallow(data, at, 100, 16)
    key = lambda i: text[at[i] : at[i] + 100]
    got = [key(i) for i in order]
    assert got == sorted(got)
    assert all((rank[order[i]] == rank[order[i - 1]]) == (got[i] == got[i - 1]) for i in range(1, 400))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7)] + [(i, i + 1) for i in range(100, 130)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {4: 3, 5: 3, 9: 3, 21: 20} | {i: 100 for i in range(101, 131)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(8)
    item = "a benchmark question that is quite long and should not be seen in training"
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    rows = [(i, text(60), "en", f"s{i % 4}", 0) for i in range(30)]
    rows += [(30, rows[2][1], "en", "s1", 0), (31, "123 !!", "en", "s0", 0), (32, None, None, None, 0), (33, text(9) + " " + item, "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    assert not kept & {30, 31, 32, 33} and kept <= set(range(30)) and {"slot", "shard", "shard_name"} <= set(got[0].asDict())
    plan = {x["doc_id"]: x["copies"] for x in mixing.plan_mix(spark.createDataFrame(rows[:30], "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(k for k, n in plan.items() for _ in range(n))


@pytest.mark.parametrize("block", [4096, 200])
def test_near_copies_of_one_base(spark, block):
    """A star: 1,000 copies near the base and, each edited on its own, not near each other."""
    r = random.Random(21)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(404)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):
        own = list(base)
        for at in r.sample(range(9, 395, 7), 6):
            own[at] = f"e{r.randint(0, 10**9)}"
        rows.append((i, " ".join(own)))
    got = {x["doc_id"]: x["component"] for x in nearcopies.near_copies(docs(spark, [(k, t, "en", "s") for k, t in rows]), block=block).collect()}
    assert sum(c == 0 for c in got.values()) >= 999


def test_stars_keep_what_edges_connect():
    r = np.random.default_rng(7)
    for _ in range(20):
        ids = r.permutation(40) * 5
        edges = [tuple(x) for x in r.integers(0, 40, (25, 2)).tolist()]
        node, root = nearcopies.stars(iter(edges), ids)
        want = {int(i): int(i) for i in ids}

        def find(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for a, b in edges:
            x, y = find(int(ids[a])), find(int(ids[b]))
            want[max(x, y)] = min(x, y)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {i: find(i) for i in want if find(i) != i}


def test_layout_follows_the_fingerprints():
    small, large = nearcopies.layout(10**6), nearcopies.layout(10**10)
    assert (small.segment, small.keys) == (16, 112) and large.segment == 25 and large.chain == 125
    r = np.random.default_rng(2)
    prints = r.integers(-(1 << 63), 1 << 63, (50, 4), np.int64)
    number, one, _ = nearcopies.ring_keys(prints, large)
    assert number.shape == (50, large.keys) and (number & np.uint64((1 << 25) - 1) == one >> np.uint64(39)).all()
    assert (nearcopies._apart(one[0] ^ one[0], one[0] ^ one[0], large) == 0).all()


def test_components_are_joined():
    """Random groups of sets, some of them linked only through one member: as if all pairs had been compared."""
    r = np.random.default_rng(1)
    for _ in range(20):
        sets = []
        for _ in range(4):
            base = r.choice(10**6, 60, replace=False)
            for _ in range(12):
                own = base.copy()
                own[r.choice(60, r.integers(0, 9), replace=False)] = r.integers(10**6, 10**7)
                sets.append(np.unique(own))
        n = len(sets)
        prints = np.array([nearcopies.wide_print(x.astype("<u8") * np.uint64(0x9E3779B97F4A7C15))[:-1] for x in sets], np.int64).view(np.uint64)
        ids = r.permutation(n) * 3
        members = nearcopies.Members(ids, prints, sets, 0.8)
        members.join()
        root = dict(zip(ids.tolist(), members.roots().tolist(), strict=True))
        want = {int(i): int(i) for i in ids}

        def find(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for a in range(n):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(int(ids[a])), find(int(ids[b]))
                    want[max(x, y)] = min(x, y)
        assert root == {i: find(i) for i in want}


@pytest.mark.parametrize("block", [4096, 60])
def test_near_copies_on_a_template(spark, block):
    """300 pages that share most of their words: links hide among many pairs that are just not alike."""
    r = random.Random(31)
    page = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        own = list(page)
        own[200:236] = [f"x{r.randint(0, 10**9)}" for _ in range(36)] if i % 10 else [f"same{i // 50}w{j}" for j in range(36)]
        own[r.randrange(400)] = f"y{r.randint(0, 10**9)}"
        rows.append((i, " ".join(own)))
    got = {x["doc_id"]: x["component"] for x in nearcopies.near_copies(docs(spark, [(k, t, "en", "s") for k, t in rows]), block=block).collect()}
    assert got == jaccard_components(rows)


def test_mix_with_null_and_repeated_keys(spark):
    rows = [(k, " ".join(["w"] * n), None, s) for k, n, s in [(None, 5, "a"), (None, 7, "a"), (None, 7, "a"), (None, 9, None), (1, 4, "a"), (1, 4, "a"), (1, 4, "a"), (1, 6, "b"), (2, 8, "b"), (3, 3, None)]]
    table = docs(spark, rows)
    want, got = {}, {}
    for x in mixing.plan_mix(table).collect():
        want[x["doc_id"], x["source"], x["size"]] = want.get((x["doc_id"], x["source"], x["size"]), 0) + x["copies"]
    for x in mixing.mix(table).collect():
        at = x["doc_id"], x["source"], len(x["text"].split())
        got[at] = got.get(at, 0) + 1
    assert got == {k: n for k, n in want.items() if n} and any(k is None for k, *_ in got) and any(k == 1 for k, *_ in got)


def test_pipeline_rejects_other_languages(spark):
    import corpus_pipeline as p

    r = random.Random(6)
    sf = "/root/testdata/sf0.001"
    try:
        known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    except Exception:
        pytest.skip("no test tables")
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(150))
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    extra = spark.createDataFrame([(-1, noise, None), (-2, polish, None), (-3, finnish, None)], "doc_id bigint, text string, lang string")
    kept = {x["doc_id"] for x in p.language(spark, known.unionByName(extra), sf).collect()}
    assert not kept & {-1, -2, -3}
    assert {x["doc_id"] for x in known.filter("text rlike '[a-zA-Z]'").collect()} <= kept


def test_texts_of_near_copies_are_not_shuffled(spark, monkeypatch):
    r = random.Random(41)
    rows = []
    for i in range(80):
        own = [f"{r.getrandbits(32):x}" for _ in range(5000)]
        rows.append((2 * i, " ".join(own)))
        if not i % 20:
            rows.append((2 * i + 1, " ".join(own[:4990] + ["other"] * 10)))
    table = docs(spark, [(k, t, "en", "s") for k, t in rows]).repartition(4).localCheckpoint()
    want = {k for k, _ in rows if not k % 2}
    written = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    assert {x["doc_id"] for x in nearcopies.drop_near_copies(table).collect()} == want
    assert written() - before < 1_500_000, written() - before
    # every text passes such a filter, and the documents go to the keys
    monkeypatch.setattr(nearcopies, "_FILTER_BITS", 64, raising=False)
    monkeypatch.setattr(nearcopies, "_FEW_IDS", 0, raising=False)
    assert {x["doc_id"] for x in nearcopies.drop_near_copies(table).collect()} == want
