"""Pair counts over a stream: the histogram is additive, so it can be kept up while rows arrive."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import text_of


def exploded(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    structs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), text_of(columns[i]).alias("x"), text_of(columns[j]).alias("y")) for i, j in combinations(range(len(columns)), 2)]
    return df.select(*keep, F.explode(F.array(*structs)).alias("p")).select(*keep, "p.*")


def running_counts(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, x, y, c) of all rows so far; for the complete or update output mode."""
    return exploded(stream, columns).groupBy("i", "j", "x", "y").agg(F.count("*").alias("c"))


def windowed_counts(stream: DataFrame, columns: Sequence[str], time: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """The same by event-time window; windows are dropped from state once ``late`` behind."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = exploded(timed, columns, [time])
    return rows.groupBy(F.window(time, width), "i", "j", "x", "y").agg(F.count("*").alias("c")).select(F.col("window.start").alias("start"), "i", "j", "x", "y", "c")


def drain(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming count over what there is, and return its table."""
    q = counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return counts.sparkSession.table(name)
