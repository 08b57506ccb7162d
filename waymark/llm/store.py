"""Tables that cut lineage: written once to the shared folder and read back.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only
where that is unset (tests on one machine) a fresh local folder is made and
set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        found = tempfile.mkdtemp(prefix="waymark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/waymark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    A lost executor costs the tasks it was running, never the chain of
    shuffles above the table.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, key: str, parts: int, label: str) -> DataFrame:
    """``df`` written to the shared folder in ``parts`` buckets by ``key``, which has no nulls: joins on the key do not move its rows again.

    There are as many buckets as a shuffle has partitions at least, as Spark
    would deal fewer anew, and as many as Spark allows at most: of a very large
    table each has more.  The table has a name only until it is read.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    parts = min(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), most)
    name = f"waymark_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(parts, key).write.format("parquet").option("path", new_path(spark, label)).option("compression", "zstd")
    try:
        writer.bucketBy(parts, key).sortBy(key).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
