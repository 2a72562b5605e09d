"""What the operators of this subpackage share: reading, checkpoints, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) is a folder chosen here.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="groupwise-"))
    return jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def word_count(text: Column) -> Column:
    """Words of a text as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def summed(partials: DataFrame, key: str, value: str, width: int = 16) -> dict:
    """{key: sum of its float64 arrays}: ``partials`` has (key, value binary), a few rows for each task.

    Arrays are added in two rounds, each task holding one sum per key, so the driver gets one
    array for each key however many tasks there were.
    """

    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in rows:
            for k, v in zip(pdf[key], pdf[value]):
                a = np.frombuffer(v)
                sums[k] = sums[k] + a if k in sums else a
        if sums:
            yield pd.DataFrame({key: list(sums), value: [a.tobytes() for a in sums.values()]})

    salted = partials.withColumn("salt", F.spark_partition_id() % width)
    some = salted.repartition(width, key, "salt").select(key, value).mapInPandas(add, partials.schema)
    return {r[key]: np.frombuffer(r[value]) for r in some.repartition(width, key).mapInPandas(add, partials.schema).collect()}


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store; those that aren't there are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared store for tables that nothing needs afterwards: it goes in the end, also on failure."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        discard(spark, folder)


def stored(df: DataFrame, name: str = "table", within: str | None = None) -> DataFrame:
    """Write a table into the shared folder (or the folder ``within``) and read it back: compact, with known size, and without lineage.

    In iterations it takes the place of checkpoint(), whose result keeps the size estimated
    for its plan: a table joined with itself again and again is soon estimated at a number so
    long that multiplying it stops the driver.
    """
    path = f"{within or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
