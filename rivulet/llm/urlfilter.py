"""URL filters as a sort-merge range join.

A host is written with its labels reversed and a dot after each, so that a rule
for a host covers its subdomains as one interval of keys: org.example. up to
org.example/ (the slash follows the dot). Such intervals nest or lie apart. A
sweep over the sorted ends of all intervals keeps the stack of rules that are
open; between two ends it doesn't change. URLs and ends are then sorted
together, and the stack of the last end at or before a URL's key runs down to
the URL. Of the rules in the stack, the longest whose path starts the URL's path
wins.

The sweep over URLs goes on in many lanes at once: URLs are dealt to lanes by a
hash of their own, so no host is too hot, and each lane gets every end.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import shuffle_partitions

#: (verdict, host, path): the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What holds where no rule fits.
DEFAULT = "allow"
#: Ends that go to each lane in one pass. Longer lists are swept in blocks of so many rules.
BLOCK_RULES = 5_000
_STACK = "array<struct<rule:string,path:string,verdict:string,length:int>>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    plain = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    host = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    there = F.coalesce(at > 0, F.lit(False))
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def host_key(host: Column) -> Column:
    """org.example.www. for www.example.org; the empty key for no host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def sweep_rules(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[dict]]]:
    """(key, open rules from that key on), sorted by key; the longest rules come first.

    Of rules with the same host and path the last one holds.
    """
    last = {(h.lower(), p): v for v, h, p in rules}
    ends: dict[str, list[tuple[int, str]]] = {}
    for host in {h for h, _ in last}:
        k = _key(host)
        ends.setdefault(k, []).append((1, host))
        if k:
            ends.setdefault(k[:-1] + "/", []).append((-1, host))
    out, stack = [], []
    for k in sorted(ends, key=lambda s: s.encode()):
        for _, host in (e for e in ends[k] if e[0] < 0):
            stack.remove(host)
        stack += [host for _, host in sorted(e for e in ends[k] if e[0] > 0)]
        held = [{"rule": h + p, "path": p, "verdict": v, "length": len(h + p)} for (h, p), v in last.items() if h in stack]
        out.append((k, sorted(held, key=lambda r: (-r["length"], r["rule"]))))
    return out


def judge_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, key: str = "page_id", url: str = "url", lanes: int | None = None) -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of every row of urls.

    Longest means host and path together, in characters; of equal lengths the
    smallest by code point. Rows with equal keys or URLs are judged each on its
    own; null and unparsable URLs have an empty host, which only a rule with an
    empty host fits. No rules: the default for all. The rules are the caller's
    list; only a block of them at a time is sent to the lanes.
    """
    spark = urls.sparkSession
    lanes = lanes or shuffle_partitions(spark)
    host, path = split_url(F.col(url))
    rows = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", host_key(F.col("host")).alias("at"), F.pmod(F.xxhash64(F.col("key").cast("string"), "host", "path"), F.lit(lanes)).cast("int").alias("lane"))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    rows = rows.withColumn("best", none)
    rules = sorted(rules, key=lambda r: _key(r[1].lower()).encode())
    for i in range(0, len(rules), BLOCK_RULES):
        swept = [{"at": k, "stack": s} for k, s in sweep_rules(rules[i : i + BLOCK_RULES])]
        ends = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(swept)), f"array<struct<at:string,stack:{_STACK}>>")))
        ends = ends.select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "at", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), none.alias("best"), F.lit(0).alias("kind"), "stack")
        both = rows.select("*", F.lit(1).alias("kind"), F.lit(None).cast(_STACK).alias("stack")).unionByName(ends)
        run = Window.partitionBy("lane").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        swept_rows = both.withColumn("stack", F.last("stack", ignorenulls=True).over(run)).filter("kind = 1")
        fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
        found = F.when(F.size(fits) > 0, fits[0])
        found = F.when(found.isNotNull(), F.struct(found["length"].alias("length"), found["rule"].alias("rule"), found["verdict"].alias("verdict")))
        better = F.col("best").isNull() | (found["length"] > F.col("best.length")) | ((found["length"] == F.col("best.length")) & (found["rule"] < F.col("best.rule")))
        rows = swept_rows.withColumn("best", F.when(found.isNotNull() & better, found).otherwise(F.col("best"))).drop("kind", "stack")
    return rows.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def sql(rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""WITH r(verdict, h, p) AS (VALUES {listed}),
    s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    u AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
    f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
          FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM u LEFT JOIN f USING (page_id)"""
