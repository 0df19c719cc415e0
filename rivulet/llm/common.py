"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but the six ASCII blanks, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session in one JVM (unit tests) that names none gets a temporary folder; on
    a cluster that is an error, since executors couldn't read it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rivulet-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def private(df: DataFrame, *wanted: str) -> str:
    """A column-name prefix that no column of df starts with."""
    prefix = "_rv"
    names = [c.lower() for c in (*df.columns, *wanted)]
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix + "_"
