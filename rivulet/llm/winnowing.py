"""Document fingerprints by winnowing.

The units of a text are its words, of which those over LONG code points count as
single code points: unspaced scripts, encoded or minified text so have units that
depend on what stands there and not on where it stands. The grams are runs of K
units. Their hashes roll over the text as cyclic polynomials: a gram's hash is
the exclusive or of its units' hashes, each turned by its distance from the
gram's end, and that of 2n units comes from those of its two halves of n. Of
every WINDOW consecutive hashes the least is chosen, of equal ones the rightmost,
and kept with its position. Two texts that share a run of K + WINDOW - 1 units
so share a chosen hash, and nothing shorter than K units is ever matched.

To choose, the top 31 bits of a hash stand above 32 bits that count positions
down, so that the plain minimum is the rightmost of the least; what is kept are
all 64 bits. Texts of up to 2^32 units keep their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import let, private, shuffle_partitions

K, WINDOW, LONG = 4, 8, 32
_LOW = (1 << 32) - 1


def units(text: Column, long: int = LONG) -> Column:
    """The words of a text, longer ones as single code points; null and blanks: none. long = 0: every code point that isn't blank."""
    blank = r"\x20\x09-\x0D"
    word = rf"(?<![^{blank}])[^{blank}]{{1,{long}}}(?![^{blank}])|" if long else ""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{word}[^{blank}]"), F.lit(0))


def _turned(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _rolled(hashes: Column, k: int) -> Column:
    """The hash of every k units in a row, from those of its two halves; there must be k at least."""
    if k == 1:
        return hashes
    low = k // 2

    def joined(left: Column, right: Column, by: int, skip: int) -> Column:
        n = F.size(right) - skip
        return F.zip_with(F.slice(left, 1, n), F.slice(right, skip + 1, n), lambda a, b: _turned(a, by).bitwiseXOR(b))

    def whole(half: Column) -> Column:
        if k == 2 * low:
            return joined(half, half, low, low)
        return joined(joined(hashes, half, low, 1), half, low, low + 1)

    return let(_rolled(hashes, low), whole)


def _grams(text: Column, k: int, long: int = LONG) -> Column:
    """The hash of every gram, in order. Fewer than k units: one gram of all of them."""
    hashes = F.transform(units(text, long), lambda w: F.xxhash64(w))
    every = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: _turned(a, 1).bitwiseXOR(x))
    few = lambda h: F.when(F.size(h) >= k, _rolled(h, k)).when(F.size(h) > 0, F.array(every(h))).otherwise(h)
    return let(hashes, few)


def _window_minima(values: Column, window: int) -> Column:
    """The minimum of every `window` consecutive values (of all, if there are fewer), by doubling."""
    out, have = values, 1
    while have < window:
        step = min(have, window - have)

        out, have = let(out, _wider(step)), have + step
    return out


def _wider(step: int):
    def minima(v: Column) -> Column:
        # a list too short for the step shrinks to one number, its minimum
        n = F.size(v)
        pair = F.zip_with(F.slice(v, 1, n - step), F.slice(v, step + 1, n - step), lambda a, b: F.least(a, b))
        return F.when(n > step, pair).when(n > 1, F.array(F.array_min(v))).otherwise(v)

    return minima


def chosen(text: Column, k: int = K, window: int = WINDOW, long: int = LONG) -> Column:
    """array<struct<hash, position>>: the choices of a text, each once, in order of position.

    Null and texts without words: none. Fewer than k units: the one gram of all
    of them; fewer than window grams: the least of them.
    """

    def pick(grams: Column) -> Column:
        packed = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(F.lit(_LOW) - i.cast("long")))
        place = lambda p: F.lit(_LOW) - p.bitwiseAND(F.lit(_LOW))
        return F.transform(F.array_distinct(_window_minima(packed, window)), lambda p: F.struct(F.get(grams, place(p).cast("int")).alias("hash"), place(p).alias("position")))

    return let(_grams(text, k, long), pick)


def hash_set(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def digest(prints: Column) -> Column:
    """32 hex digits of a fingerprint."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(prints)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), prints)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two hash sets (Jaccard); 1 if both are empty."""
    common = lambda n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n))
    return let(F.size(F.array_intersect(a, b)), common)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW, long: int = LONG, name: str = "fingerprint") -> DataFrame:
    """docs with array<struct<hash, position>>, the choices of each whole text. A column of that name is replaced."""
    return docs.withColumn(name, chosen(F.col(text), k, window, long))


def with_next(docs: DataFrame, key: str, columns: list[str], buckets: int | None = None) -> tuple[DataFrame, Window, str]:
    """docs dealt to ranges of its key, and the window in which the row after each stands right after it.

    The bounds are approximate quantiles of the key, found by halving in every
    row. The first row of each range also stands, marked, at the end of the
    range before (the first range's at the end of the last). Of the driver this
    asks for two numbers a range. Null keys come first.
    """
    spark = docs.sparkSession
    p = private(docs)
    buckets = buckets or 4 * shuffle_partitions(spark)
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    levels = max(1, (buckets - 1).bit_length())
    n = 1 << levels
    bounds = docs.agg(F.percentile_approx(k, [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    bounds += [None] * (n - 1 - len(bounds))
    listed = F.from_json(F.lit(str(bounds).replace("None", "null")), "array<bigint>")
    halves = F.from_json(F.lit(str([n >> i for i in range(1, levels + 1)])), "array<int>")
    bucket = F.aggregate(halves, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(listed, at + s - 1) <= k, F.lit(False)), s).otherwise(0))
    rows = docs.select(*columns, F.lit(False).alias(f"{p}more"), k.alias(f"{p}k"), bucket.alias(f"{p}bucket"))
    firsts = sorted(rows.groupBy(f"{p}bucket").agg(F.min(f"{p}k").alias("k")).collect())
    before = [(firsts[i - 1][0], b, low) for i, (b, low) in enumerate(firsts)]
    ends = spark.createDataFrame(before or [(0, 0, 0)], f"{p}to int, {p}from int, {p}low bigint").limit(len(before))
    ends = rows.join(F.broadcast(ends), (F.col(f"{p}bucket") == F.col(f"{p}from")) & (F.col(f"{p}k") == F.col(f"{p}low")))
    ends = ends.select(*columns, F.lit(True).alias(f"{p}more"), f"{p}k", F.col(f"{p}to").alias(f"{p}bucket"))
    return rows.unionByName(ends), Window.partitionBy(f"{p}bucket").orderBy(f"{p}more", f"{p}k"), f"{p}more"


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Edited: the last floor(n / 2) code points make room for the first as many,
    or all, of the next document by key (after the last: the first). Returns
    key, n_chars, edited (the text), prints, edited_prints, next_prints (choices)
    and near_edited, near_next. Null texts count as empty. Repeated keys keep all
    their rows; which of them follows which is their order by text, and so is it
    for rows without a key, which come first. Rows that share a key, or have none,
    stand in one task. Only the columns key and text are read; an empty table
    gives an empty one.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, over, more = with_next(own, "key", ["key", "text"])
    over = over.orderBy(more, F.coalesce(F.col("key").cast("long"), F.lit(-(2**63))), "text")
    rows = rows.withColumn("prints", chosen(F.col("text"), k, window, long))
    rows = rows.select("*", F.lead("text").over(over).alias("next"), F.lead("prints").over(over).alias("next_prints")).filter(~F.col(more))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = rows.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "prints", "next_prints")
    rows = rows.withColumn("edited_prints", chosen(F.col("edited"), k, window, long))
    sets = rows.select("*", hash_set(F.col("prints")).alias("a"), hash_set(F.col("edited_prints")).alias("b"), hash_set(F.col("next_prints")).alias("c"))
    return sets.select(
        F.col("key").alias(key), "n_chars", "edited", "prints", "edited_prints", "next_prints",
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
