"""Conditional coding by rank: a child value is named by its place among its parent's values by probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import conditional_distribution


def rank_table(dist: DataFrame) -> DataFrame:
    """(p, c, prob, rank): 0 for the likeliest child of a parent value, ties by the child's text."""
    order = Window.partitionBy("p").orderBy(F.desc(F.round("prob", 12)), "c")
    return dist.select("p", "c", "prob", (F.row_number().over(order) - 1).alias("rank"))


def rank_encode(df: DataFrame, parent: str, child: str, ranks: DataFrame) -> DataFrame:
    """``df`` with the rank of its child value; a pair without one is an error, not a guess."""
    from .pairs import text_of

    out = df.withColumns({"_p": text_of(parent), "_c": text_of(child)}).join(ranks.select(F.col("p").alias("_p"), F.col("c").alias("_c"), "rank"), ["_p", "_c"], "left").drop("_p", "_c")
    return out.withColumn("rank", F.when(F.col("rank").isNotNull(), F.col("rank")).otherwise(F.raise_error(F.lit("a pair has no rank"))))


def rank_decode(df: DataFrame, parent: str, ranks: DataFrame, child: str) -> DataFrame:
    """The inverse of :func:`rank_encode`: (parent, rank) back to the child's text."""
    from .pairs import text_of

    back = ranks.select(F.col("p").alias("_p"), "rank", F.col("c").alias(child))
    return df.withColumn("_p", text_of(parent)).join(back, ["_p", "rank"], "left").drop("_p", "rank")


def rank_histogram(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(rank, n): how many rows each rank stands for, from the pair counts alone."""
    dist = conditional_distribution(df, parent, child)
    order = Window.partitionBy("p").orderBy(F.desc(F.round("prob", 12)), "c")
    return dist.withColumn("rank", F.row_number().over(order) - 1).groupBy("rank").agg(F.sum("n").cast("long").alias("n"))


def nll_bits(df: DataFrame, parent: str, child: str, model: DataFrame | None = None, floor: float = 1e-10) -> DataFrame:
    """(n, bits): code length of the child given the parent under a model (p, c, prob), by default its own shares."""
    counts = conditional_distribution(df, parent, child)
    if model is not None:
        counts = counts.drop("prob").join(model.select("p", "c", "prob"), ["p", "c"], "left")
    prob = F.greatest(F.coalesce("prob", F.lit(floor)), F.lit(floor))
    return counts.agg(F.sum("n").cast("long").alias("n"), F.sum(-F.col("n") * F.log2(prob)).alias("bits"))


def mean_model_distribution(scored: DataFrame) -> DataFrame:
    """(p, c, prob): a model's probabilities averaged by parent value."""
    return scored.groupBy("p", "c").agg(F.avg("prob").alias("prob"))
