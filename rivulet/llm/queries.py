"""Queries of this subpackage over the driver's tables, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontam, langid, linededup, mixing, sharding, simhash, suffixdedup, toxicity, urlfilter, winnowing
from rivulet.llm.common import table

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(rows, model, keep=["doc_id", "held_out"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), shards=SHARDS)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_print(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        winnowing.digest(F.col("prints")).alias("fingerprint"), winnowing.digest(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("prints").cast("long").alias("n_prints"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = linededup.LineIndex.build(docs).dedup(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position")).orderBy("position", "doc_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.withColumn("text_hash", toxicity.text_hash(F.col("text")))
    labelled = hashed.join(table(spark, sf_dir, "labels"), "doc_id").select("text", "text_hash", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.learn(labelled, ("low_quality", "toxic"), hashed="text_hash")
    return toxicity.predict(docs, chain, ["doc_id"]).withColumn("toxic", (F.col("p_toxic") >= chain.cutoffs[1]).cast("int"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_sharding, op3_simhash, op4_winnowing, op5_decontamination, op6_line_dedup, op7_mixing, op8_url_filters, op9_toxicity, op10_suffix_dedup)}

_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    d AS (SELECT k.*, r.last IS NOT NULL AND doc_id <> r.last AS dropped FROM k LEFT JOIN r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

ORACLE_SQL = {
    "op6_line_dedup": _LINES,
    "op2_sharding": sharding.sql(SHARDS),
    "op7_mixing": mixing.sql(),
    "op8_url_filters": urlfilter.sql(),
}
