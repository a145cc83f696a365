"""Where intermediate tables go: the folder the cluster shares for checkpoints."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where none is set, a temporary folder in local mode (tests);
    on a cluster, whose executors would each write to a disk of their own, an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        set_dir = tempfile.mkdtemp(prefix="colforest-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there,
    so a lost executor costs no more than the stage that was running."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/colforest-{name}-{uuid.uuid4().hex}"


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` once nothing lazy reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if os.path.basename(folder).startswith("colforest-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package even if only ``sys.path`` of the driver knew it."""
    env = spark.sparkContext.environment
    if HERE not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, env.get("PYTHONPATH", "")]))


#: Rows and bytes of an Arrow batch on its way to a Python worker, unless the session sets its own: long
#: texts make a batch of the default 10,000 rows large, on both sides, for each task that runs.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    own = spark.sparkContext.getConf()
    for k, v in BATCH.items():
        if not own.contains(k):
            spark.conf.set(k, v)


def release() -> None:
    """Give back the memory that the allocators of this process still hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and at their end the memory that the allocators of this worker still hold: a worker
    outlives its task, and what one operator needed is not to be kept from the next."""
    try:
        yield from batches
    finally:
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
