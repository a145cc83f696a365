"""Pair histograms, mutual information and description-length charges over all pairs of columns.

One pass over the table makes every pair's histogram: each row becomes one small struct per pair, which
is summed map-side, so what is shuffled is cells, not rows.  Marginals come from windows over the cells.
Totals of a pair need no window over all its cells: cells are first gathered by their count, of which a
pair has few.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import gamma_bits, golomb_bits, golomb_parameter, hash_bucket

LN2 = 0.6931471805599453
#: Rows that quantile edges are taken from.
EDGE_ROWS = 10_000


def text_of(c: str | Column) -> Column:
    """Cells are compared as text; a missing cell is the empty text."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def pair_histogram(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """(i, j, x, y, c): how often value x of column i stands beside value y of column j, i < j."""
    pairs = list(pairs if pairs is not None else combinations(range(len(columns)), 2))
    cells = df.select(*[text_of(c).alias(f"c{k}") for k, c in enumerate(columns)])
    if not pairs:
        return df.sparkSession.createDataFrame([], "i int, j int, x string, y string, c long")
    structs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, j in pairs]
    return cells.select(F.explode(F.array(*structs)).alias("p")).groupBy("p.i", "p.j", "p.x", "p.y").agg(F.count("*").alias("c"))


def by_count(hist: DataFrame) -> DataFrame:
    """(i, j, c, f, t): f cells of count c; t = sum of c ln(c / (cx cy)) over them."""
    wx, wy = Window.partitionBy("i", "j", "x"), Window.partitionBy("i", "j", "y")
    cells = hist.withColumn("cx", F.sum("c").over(wx)).withColumn("cy", F.sum("c").over(wy))
    term = F.col("c") * F.log(F.col("c") / (F.col("cx").cast("double") * F.col("cy")))
    return cells.groupBy("i", "j", "c").agg(F.count("*").alias("f"), F.sum(term).alias("t"))


def pair_scores(hist: DataFrame, rows: int | None = None) -> DataFrame:
    """(i, j, n, k, mi, bits, w): mutual information in nats, proxy charge in bits, weight of the edge.

    ``rows`` scales the information of a sample to the whole table; by default it is the sample's own n."""
    w = Window.partitionBy("i", "j")
    counts = by_count(hist).withColumns({"n": F.sum(F.col("c") * F.col("f")).over(w), "k": F.sum("f").over(w)})
    mean = F.col("n") / F.col("k")
    bits = F.when((mean > 1) & (mean < 100), golomb_bits(F.col("c"), golomb_parameter(mean))).otherwise(gamma_bits(F.col("c") + 1))
    scored = counts.groupBy("i", "j", "n", "k").agg(F.sum("t").alias("t"), F.sum(F.col("f") * bits).alias("b"))
    mi = F.greatest(F.lit(0.0), F.col("t") / F.col("n") + F.log("n"))
    scored = scored.select("i", "j", "n", "k", mi.alias("mi"), (F.col("b") + gamma_bits(F.col("k"))).cast("double").alias("bits"))
    n = F.lit(rows) if rows is not None else F.col("n")
    return scored.withColumn("w", n * F.col("mi") / LN2 - F.col("bits"))


def hashed(df: DataFrame, columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Each column as a stable hash bucket."""
    return df.select(*[hash_bucket(F.col(c), buckets).alias(c) for c in columns])


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = 256, key: Sequence[str] = (), rows: int = EDGE_ROWS, seed: int = 0) -> dict[str, list[float]]:
    """Inner bin edges of each numeric column: distinct interpolated quantiles (at most ``bins`` - 1 numbers) of at
    most ``rows`` rows, the same for the same seed and ``key`` (by default, the columns themselves)."""
    shares = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key or columns])
    part = df.select(*columns, F.md5(name).alias("_rank")).orderBy("_rank", *columns).limit(rows)
    row = part.agg(*[F.percentile(F.col(c).cast("double"), shares).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or []))[1:-1] for c in columns}


def bin_of(value: Column, edges: Sequence[float], run: int = 16) -> Column:
    """How many of the sorted ``edges`` are not above the value: by runs of edges first, then within one run."""
    if not edges:
        return F.lit(0).cast("long")
    constants = lambda some: F.array(*[F.lit(float(e)) for e in some])
    below = lambda some: F.size(F.filter(some, lambda e: e <= value))
    if len(edges) <= run:
        return below(constants(edges)).cast("long")
    skipped = F.greatest(below(constants(edges[::run])) - 1, F.lit(0)) * run
    return (skipped + below(F.slice(constants(edges), skipped + 1, run))).cast("long")


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int = 256, key: Sequence[str] = ()) -> DataFrame:
    """Each numeric column as the number of its inner edges that are not above the value; a constant column is 0."""
    edges = quantile_edges(df, columns, bins, key)
    return df.select(*[bin_of(F.col(c).cast("double"), edges[c]).alias(c) for c in columns])


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """Exactly ``rows`` rows (or all), the same for the same seed: the smallest keyed hashes."""
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_rank", rank).orderBy("_rank", key).limit(rows).drop("_rank")


def high_cardinality(df: DataFrame, columns: Sequence[str], share: float = 0.5) -> DataFrame:
    """(column, n_rows, n_distinct, skip): columns with distinct values in more than ``share`` of the rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text_of(c).alias("v")) for c in columns])).alias("s")).select("s.*")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("c")).groupBy("column").agg(F.sum("c").cast("long").alias("n_rows"), F.count("*").alias("n_distinct"))
    return counts.withColumn("skip", F.col("n_distinct") > F.floor(F.col("n_rows") * share))


def measured_bits(hist: DataFrame, level: int = 1, small: int = 20) -> DataFrame:
    """(i, j, bits): eight times the bytes of each pair's compressed histogram; pairs of up to ``small``
    cells have the proxy charge.  A pair is compressed in runs of cells by hash, so no task holds a pair."""
    import pandas as pd
    import zlib

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        body = pdf.sort_values(["x", "y"])
        raw = "\x1f".join(body.x).encode() + b"\0" + "\x1f".join(body.y).encode() + b"\0" + body.c.to_numpy("int64").tobytes()
        return pd.DataFrame({"i": [int(pdf.i.iloc[0])], "j": [int(pdf.j.iloc[0])], "b": [8.0 * len(zlib.compress(raw, level))]})

    proxy = pair_scores(hist).select("i", "j", "k", "bits")
    runs = hist.withColumn("run", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    measured = runs.groupBy("i", "j", "run").applyInPandas(size, "i int, j int, b double").groupBy("i", "j").agg(F.sum("b").alias("b"))
    return proxy.join(measured, ["i", "j"]).select("i", "j", F.when(F.col("k") <= small, F.col("bits")).otherwise(F.col("b")).alias("bits"))
