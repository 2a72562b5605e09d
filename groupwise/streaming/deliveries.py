"""A directory of deliveries as a stream: each arriving file is read, checked or merged once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import relational
from ..sources import delivery

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, path: str, glob: str = "*.ags", encoding: str = "utf-8") -> DataFrame:
    """Records of files as they arrive, with their file's time for watermarks."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, at, raw in zip(pdf["path"], pdf["modificationTime"], pdf["content"]):
                yield delivery._rows_of(file, bytes(raw), encoding, "replace").assign(arrived=at)

    return files.select("path", "modificationTime", "content").mapInPandas(run, delivery.ROWS + ", arrived timestamp")


def row_counts(records: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """DATA rows of each group by arrival window; files later than ``late`` are left out."""
    data = records.where("tag = 'DATA'").withWatermark("arrived", late)
    return data.groupBy(F.window("arrived", window), "group").agg(F.count(F.lit(1)).alias("n_rows"))


def upsert(records: DataFrame, group: str, typed: Callable[[DataFrame], DataFrame], target: str, keys: list[str], order: str) -> DataStreamWriter:
    """Keep ``target`` at the latest row of each key: each batch is merged with it and swapped in as a new version.

    ``typed`` turns a batch's records into the group's table. Versions are directories
    ``target/v=N``; readers take the highest that has a _SUCCESS file.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = typed(batch.where(F.col("group") == group))
        if n > 0:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{target}/v={n - 1}"))
        relational.latest_per_key(new, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{target}/v={n}")

    return records.writeStream.foreachBatch(merge)
