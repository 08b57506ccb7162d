"""The shared folder: tables written there cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a local folder is made, and set, only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="waymark-")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/waymark/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
