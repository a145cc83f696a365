"""Intermediate tables in the folder the cluster shares, and contiguous row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``.  Where none is set: a temporary folder in local
    mode; an error on a cluster, whose executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="colforest-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/colforest-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that later plans start from files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Contiguous numbers from 0 in the order of ``order``, without sorting in one task: rows are range
    partitioned, numbered within each part, and shifted by the sizes of the parts before."""
    spot = F.monotonically_increasing_id()
    parts = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", spot), "numbered")
    parts = parts.withColumn("_part", F.shiftright("_spot", 33)).withColumn("_at", F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per part
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_spot", "_part", "_at", "_before")
