"""Intermediate tables in the shared folder of the cluster.

Iterative and multi-pass operators cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back.  The folder is shared by all executors, so a lost executor never costs the result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it is missing, a temporary folder in local mode (tests)."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back; it is removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
