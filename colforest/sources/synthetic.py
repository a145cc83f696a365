"""Seeded tables with known dependencies, made on the executors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, name: str) -> Column:
    """A number in [0, 1) from the row number, by a digest that any engine has: the same on any number of partitions."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}|{name}"), F.col("row_id").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _pick(seed: int, name: str, n: int) -> Column:
    return F.floor(_uniform(seed, name) * n).cast("int")


def _normal(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.log(1 - _uniform(seed, name + "/r"))) * F.cos(2 * math.pi * _uniform(seed, name + "/a"))


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def noisy_pair(spark: SparkSession, n: int, bits: float, seed: int = 0) -> DataFrame:
    """(row_id, parent, child) of 20 values with about ``bits`` of shared information."""
    most = math.log2(20)
    noise = 0.0 if bits >= most else min(0.95, max(0.0, 1 - bits / most))
    copied = (F.col("parent") + (F.col("row_id") % 3)).cast("int") % 20
    return rows(spark, n).withColumn("parent", _pick(seed, "p", 20)).withColumn("child", F.when(_uniform(seed, "u") < 1 - noise, copied).otherwise(_pick(seed, "c", 20)))


def gaussian_pair(spark: SparkSession, n: int, correlation: float, seed: int = 0) -> DataFrame:
    return rows(spark, n).withColumn("parent", _normal(seed, "p")).withColumn("child", correlation * F.col("parent") + math.sqrt(1 - correlation**2) * _normal(seed, "n"))


def level_tree(spark: SparkSession, n: int, depth: int, branches: int = 2, strength: float = 0.95, seed: int = 0) -> DataFrame:
    """Ten-valued columns: ``branches`` roots, and as many children of each node on every further level."""
    df, level = rows(spark, n), []
    for i in range(branches):
        df = df.withColumn(f"root_{i}", _pick(seed, f"root_{i}", 10))
        level.append(f"root_{i}")
    for d in range(1, depth):
        below = []
        made = {}
        for parent in level:
            for k in range(branches):
                name = f"level_{d}_node_{len(below)}"
                made[name] = F.when(_uniform(seed, name + "/u") < strength, (F.col(parent) * (3 + k) + k) % 10).otherwise(_pick(seed, name, 10)).cast("int")
                below.append(name)
        df, level = df.withColumns(made), below
    return df


def pair_sweep(spark: SparkSession, n: int, pairs: int, seed: int = 0) -> DataFrame:
    """parent_i, child_i with shared information from 0 to 3 bits."""
    df = rows(spark, n)
    for i in range(pairs):
        bits = 3.0 * i / max(1, pairs - 1)
        noise = min(0.95, max(0.0, 1 - bits / math.log2(20)))
        copied = (F.col(f"parent_{i}") + (F.col("row_id") % 3)).cast("int") % 20
        df = df.withColumn(f"parent_{i}", _pick(seed, f"p{i}", 20)).withColumn(f"child_{i}", F.when(_uniform(seed, f"u{i}") < 1 - noise, copied).otherwise(_pick(seed, f"c{i}", 20)))
    return df


def from_tree(spark: SparkSession, n: int, edges: Sequence[tuple[int, int]], columns: int, cardinality: int = 5, categorical: bool = True, seed: int = 42) -> DataFrame:
    """col_0, col_1, ... along given edges: a child copies its parent (85 %), is one more (10 %) or anything;
    numeric ones are correlated at 0.95."""
    parent = {v: u for u, v in edges}
    df, done = rows(spark, n), set()
    while len(done) < columns:
        for i in sorted(set(range(columns)) - done):
            name = f"col_{i}"
            if i not in parent:
                df = df.withColumn(name, _pick(seed, name, cardinality) if categorical else _normal(seed, name))
            elif parent[i] in done:
                p, u = F.col(f"col_{parent[i]}"), _uniform(seed, name + "/u")
                if categorical:
                    value = F.when(u < 0.85, p).when(u < 0.95, (p + 1) % cardinality).otherwise(_pick(seed, name, cardinality)).cast("int")
                else:
                    value = 0.95 * p + math.sqrt(1 - 0.95**2) * _normal(seed, name)
                df = df.withColumn(name, value)
            else:
                continue
            done.add(i)
    return df
