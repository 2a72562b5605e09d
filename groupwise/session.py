"""Making this package importable where Spark runs Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "groupwise.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        z.write(file, os.path.relpath(file, os.path.dirname(here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the checkpoint folder that the cluster names, or cached where there is none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist()
        sc.setCheckpointDir(folder)
    return df.checkpoint()
