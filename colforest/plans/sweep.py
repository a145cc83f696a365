"""Sweeps over data sets, methods and parameters; what is done already is not done again."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as S
from ..sources.delimited import append_results, not_done, read_results
from ..sources.tables import shared_path
from .report import measures

COLUMNS = ["dataset", "method", "original", "size", "seconds"]


def archive_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of an archive's files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def measure(df: DataFrame, method: str, key: str = "row_id", **how) -> tuple[int, int, float]:
    """(bytes of the plain text, bytes stored, wall seconds) of one method on one table."""
    spark, cols = df.sparkSession, [c for c in df.columns if c != key]
    original = df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(len(cols))))).first()[0] or 0
    began = time.perf_counter()
    if method in ("own", "chain", "model", "neural", "autoregressive"):
        path = shared_path(spark, "sweep")
        S.write_archive(df, path, cols, key, forest="chain" if method == "chain" else None, coder="histogram" if method in ("own", "chain") else method, **how)
        size = archive_bytes(spark, path)
    else:
        name, whole = method.removeprefix("columnar "), not method.startswith("columnar ")
        sizes = S.codec_sizes(df, cols, key, [name])
        size = sizes.where((F.col("column") == "*") if whole else (F.col("column") != "*")).agg(F.sum("size")).first()[0]
    return int(original), int(size or 0), time.perf_counter() - began


def compare(spark: SparkSession, datasets: dict[str, DataFrame], path: str, methods: Sequence[str], key: str = "row_id") -> DataFrame:
    """Measure every method on every data set that the result table at ``path`` lacks; the whole table with its ratios."""
    todo = spark.createDataFrame([(d, m) for d in datasets for m in methods], "dataset string, method string")
    try:
        todo = not_done(todo, read_results(spark, path), ["dataset", "method"])
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    for r in todo.orderBy("dataset", "method").collect():
        row = (r.dataset, r.method, *measure(datasets[r.dataset], r.method, key))
        append_results(spark.createDataFrame([row], "dataset string, method string, original long, size long, seconds double"), path, COLUMNS)
    return measures(read_results(spark, path))


def grid(spark: SparkSession, df: DataFrame, rare: Sequence[int] = (1, 2, 5, 10, 20), buckets: Sequence[int] = (1024, 2048, 4096, 8192, 16384), key: str = "row_id") -> DataFrame:
    """(rare, buckets, ratio) of archives over a grid of parameters."""
    out = []
    for r in rare:
        for b in buckets:
            original, size, _ = measure(df, "own", key, rare=r, learn={"mode": "hashed", "buckets": b})
            out.append((r, b, original / size if size else None))
    return spark.createDataFrame(out, "rare int, buckets int, ratio double")
