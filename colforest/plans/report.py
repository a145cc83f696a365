"""Tables behind reports: matrices, speed-ups, ratios, and benchmark texts taken apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import parse_bytes, parse_throughput


def matrix(cells: DataFrame, n: int) -> DataFrame:
    """(i, m0, m1, ...): a symmetric matrix of (i, j, value) cells, 0 on the diagonal and where there is none."""
    both = cells.select("i", "j", "value").union(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i").agg(*[F.coalesce(F.max(F.when(F.col("j") == k, F.col("value"))), F.lit(0.0)).alias(f"m{k}") for k in range(n)])


def pivoted(results: DataFrame, methods: Sequence[str], metric: str = "ratio") -> DataFrame:
    """(dataset, one column for each method): 0 where a method has no result."""
    return results.groupBy("dataset").pivot("method", list(methods)).agg(F.first(metric)).fillna(0.0, list(methods))


def measures(results: DataFrame) -> DataFrame:
    """``results`` (dataset, method, original, size, seconds) with ratio, MB per second and ratio per second."""
    ratio = F.when(F.col("size") > 0, F.col("original") / F.col("size"))
    return results.withColumns({"ratio": ratio, "mb_s": F.when(F.col("seconds") > 0, F.col("original") / F.col("seconds") / 1048576.0)}).withColumn("efficiency", F.when(F.col("seconds") > 0, F.col("ratio") / F.col("seconds")).otherwise(0.0))


def speedups(results: DataFrame, own: str) -> DataFrame:
    """Per dataset and method: times faster than the slowest, and how much better ``own`` is than the best other, in percent."""
    w = Window.partitionBy("dataset")
    rows = results.withColumns({
        "speedup": F.when(F.col("seconds") > 0, F.max("seconds").over(w) / F.col("seconds")),
        "best_other": F.max(F.when(F.col("method") != own, F.col("ratio"))).over(w),
        "own": F.max(F.when(F.col("method") == own, F.col("ratio"))).over(w),
    })
    return rows.withColumn("gain_pct", F.when(F.col("best_other") > 0, 100.0 * (F.col("own") - F.col("best_other")) / F.col("best_other"))).select("dataset", "method", "speedup", "gain_pct")


def size_series(results: DataFrame, metric: str) -> DataFrame:
    """(dataset, method, mb, value): points of a metric over the input size, without empty ones."""
    return results.where(F.col(metric).isNotNull() & (F.col(metric) > 0)).select("dataset", "method", (F.col("original") / 1048576.0).alias("mb"), F.col(metric).alias("value"))


def with_and_without(results: DataFrame, base: str, other: str) -> DataFrame:
    """Per dataset: size and seconds of two methods side by side, differences and change of size in percent."""
    side = lambda m, s: results.where(F.col("method") == m).select("dataset", F.col("size").alias(f"size_{s}"), F.col("seconds").alias(f"seconds_{s}"))
    both = side(base, "base").join(side(other, "other"), "dataset")
    return both.withColumns({"size_change": F.col("size_other") - F.col("size_base"), "seconds_change": F.col("seconds_other") - F.col("seconds_base"), "size_pct": 100.0 * (F.col("size_other") - F.col("size_base")) / F.col("size_base")})


def weight_spread(edges: DataFrame, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Edge weights (dataset, w) by dataset: quartiles, and a histogram of ``bins`` equal bins."""
    quartiles = edges.groupBy("dataset").agg(F.count("*").alias("n"), F.percentile("w", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("quartiles"))
    span = edges.groupBy("dataset").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return quartiles, edges.join(span, "dataset").groupBy("dataset", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def edge_weights_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (u, v in either order) with the weight of their edge, null without one."""
    key = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    return pairs.select("*", *key).join(edges.select(*key, "w"), ["a", "b"], "left").drop("a", "b")


def learned_pairs(entropies: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """Per learned edge: information, weight, weight per row, entropy of the child and the share saved."""
    e = entropies.select(F.col("i").alias("u"), F.col("j").alias("v"), "mi_bits", "h_y", "saving")
    return edge_weights_of(e, edges).where("w is not null").withColumn("bits_per_row", F.col("w") / rows)


#: A method's block in a benchmark text: name, size, ratio, time, throughput (fixed format).
BLOCK = r"(?m)^([A-Za-z0-9 +()]+):\s*\n\s+size:\s+([\d.]+\s+(?:B|KB|MB|GB))[\s\S]*?ratio\s+x?([\d.]+)[\s\S]*?time:\s+([\d.]+)s[\s\S]*?throughput:\s+([\d.]+\s+(?:KB/s|MB/s|GB/s))"


def parse_report(texts: DataFrame, text: str = "text") -> DataFrame:
    """(dataset, method, size, ratio, seconds, mb_s): the blocks of benchmark texts as rows; texts without any give none."""
    part = lambda k: F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(k))
    blocks = texts.select("dataset", F.explode(F.arrays_zip(*[part(k).alias(n) for k, n in enumerate(("method", "size", "ratio", "time", "rate"), 1)])).alias("b"))
    return blocks.select("dataset", F.trim("b.method").alias("method"), parse_bytes(F.col("b.size")).alias("size"), F.col("b.ratio").try_cast("double").alias("ratio"), F.col("b.time").try_cast("double").alias("seconds"), parse_throughput(F.col("b.rate")).alias("mb_s"))
