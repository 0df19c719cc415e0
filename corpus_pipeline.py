"""The documents table made ready for training, in five stages.

Each stage works on all that the one before kept, read back from Parquet in the
folder the session shares. The first three drop rows, the fourth drops and repeats
rows in training order, and the last adds where each row is stored.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontam, langid, mixing, nearcopies, sharding
from rivulet.llm.common import private, shared_dir, table
from rivulet.llm.queries import SHARDS

#: A text whose letters fit no known language better than this is rejected, as is one without letters.
#: On sf0.1 the lowest of 10,000 documents has 0.41; random letters and other languages in Latin script have up to 0.29.
LEAST_SCORE = 0.35
#: Words of a shingle, and the Jaccard similarity from which documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled ones, all columns as they are.

    Null, empty and letterless texts go. Rows that repeat, or have no key, are
    judged by their text alone. Where no row has a label no language is known, and
    every text with letters stays (with a warning). An empty table gives an empty one.
    """
    model = langid.learn(docs)
    if not model.langs:
        warnings.warn("no labelled document: texts in any language stay", stacklevel=2)
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    p = private(docs)
    found = langid.identify(docs, model, names=(f"{p}lang", f"{p}score"))
    return found.filter((F.col(f"{p}lang") != "und") & (F.col(f"{p}score") >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, all columns as they are.

    Rows without a key stay; rows that share the smallest key all stay. An empty
    table gives an empty one.
    """
    return nearcopies.drop_near_copies(docs, words=SHINGLE, similarity=SIMILARITY)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found, all columns as they are.

    A key goes with all its rows if an item is in one of them; rows without a key
    stay. Null texts hold no item; no items, or no rows: docs as they are.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as their source's target asks, in order, all columns as they are.

    Null is a source like others. Rows that repeat, or have no key, are documents
    each. Texts without words are never taken; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream with slot, shard and shard_name of every row; rows with equal keys share a shard, those without a key too."""
    return sharding.assign_shards(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL expresses neither rank-order profiles nor fingerprints; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again; what a stage wrote goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                files.delete(path(f"{base}/{k - 1}-{STAGES[k - 1][0]}"), True)
    return docs
