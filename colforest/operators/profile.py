"""Profiles of columns: counts, cardinality, entropy, distributions and their distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import pair_histogram, text_of


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v): every cell as text."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text_of(c).alias("v")) for c in columns])).alias("s")).select("s.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("column", "v").agg(F.count("*").alias("c"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """(column, rank, v, c): the k most frequent values, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("c"), "v")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "rank", "v", "c")


def cardinality(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, n_rows, n_distinct, pct).  The approximate form keeps a sketch per column and never shuffles values."""
    if approximate:
        return long_form(df, columns).groupBy("column").agg(F.count("*").alias("n_rows"), F.approx_count_distinct("v").alias("n_distinct")).withColumn("pct", 100.0 * F.col("n_distinct") / F.col("n_rows"))
    counts = value_counts(df, columns).groupBy("column").agg(F.sum("c").cast("long").alias("n_rows"), F.count("*").alias("n_distinct"))
    return counts.withColumn("pct", 100.0 * F.col("n_distinct") / F.col("n_rows"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, minimum, maximum, mean, deviation)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    return long.groupBy("column").agg(F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"))


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bits).  H = log2 n - (sum of c log2 c) / n, one sum over the value counts."""
    counts = value_counts(df, columns).groupBy("column").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return counts.select("column", (F.log2("n") - F.col("s") / F.col("n")).alias("bits"))


def pair_entropies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, h_x, h_y, h_xy, h_y_given_x, mi_bits, gain, saving) of every pair, all in bits.

    gain = H(Y) / H(Y|X), 0 where the latter is not positive; saving = MI / H(Y)."""
    joint = pair_histogram(df, columns).groupBy("i", "j").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    joint = joint.select("i", "j", (F.log2("n") - F.col("s") / F.col("n")).alias("h_xy"))
    ids = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column string")
    one = entropy(df, columns).join(ids, "column")
    rows = joint.join(one.select(F.col("k").alias("i"), F.col("bits").alias("h_x")), "i").join(one.select(F.col("k").alias("j"), F.col("bits").alias("h_y")), "j")
    given = F.col("h_xy") - F.col("h_x")
    mi = F.col("h_x") + F.col("h_y") - F.col("h_xy")
    return rows.select(
        "i", "j", "h_x", "h_y", "h_xy", given.alias("h_y_given_x"), mi.alias("mi_bits"),
        F.when(F.round(given, 9) > 0, F.col("h_y") / given).otherwise(0.0).alias("gain"), F.when(F.col("h_y") > 0, mi / F.col("h_y")).otherwise(0.0).alias("saving"),
    )


def conditional_distribution(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(p, c, n, prob): share of each child value beside each parent value."""
    counts = df.groupBy(text_of(parent).alias("p"), text_of(child).alias("c")).agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("p")))


def divergence(one: DataFrame, other: DataFrame, floor: float = 1e-10) -> DataFrame:
    """(p, kl): Kullback-Leibler divergence in nats of two conditional distributions, by parent value;
    what the second lacks counts as ``floor``, what the first lacks adds nothing."""
    both = one.select("p", "c", F.col("prob").alias("h")).join(other.select("p", "c", F.col("prob").alias("m")), ["p", "c"], "full_outer")
    h, m = F.coalesce("h", F.lit(0.0)), F.coalesce("m", F.lit(floor))
    return both.groupBy("p").agg(F.sum(F.when(h > 0, h * F.log(h / m)).otherwise(0.0)).alias("kl"))


def mean_divergence(kl: DataFrame) -> DataFrame:
    """(n_parents, mean_kl) over the parents that differ."""
    return kl.where("kl > 0").agg(F.count("*").alias("n_parents"), F.avg("kl").alias("mean_kl"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of a numeric column; rows are numbered in order by a distributed sort, and the driver
    gets the two neighbours of each."""
    from ..sources.tables import numbered

    rows = numbered(df.select(F.col(column).cast("double").alias("v")).where("v is not null"), ["v"], "at")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    spots = [q * (n - 1) for q in shares]
    wanted = sorted({int(s) for s in spots} | {min(n - 1, int(s) + 1) for s in spots})
    v = {r.at: r.v for r in rows.where(F.col("at").isin(wanted)).collect()}
    return [v[int(s)] + (s - int(s)) * (v[min(n - 1, int(s) + 1)] - v[int(s)]) for s in spots]


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mean, population deviation, mean size, percent exact, and the 1st and 99th percentiles to clip at."""
    r = F.col(actual) - F.col(predicted)
    low, high = exact_quantiles(df.select(r.alias("r")), "r", (0.01, 0.99))
    out = df.agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("deviation"), F.avg(F.abs(r)).alias("mean_size"), (100.0 * F.avg((r == 0).cast("double"))).alias("pct_exact"))
    return out.withColumns({"low": F.lit(low).cast("double"), "high": F.lit(high).cast("double")})


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, correlation, slope, intercept) of y on x."""
    return df.agg(F.count("*").alias("n"), F.corr(x, y).alias("correlation"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every two columns, in one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def dominance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, share): the most frequent value, ties to the smallest, and its share."""
    counts = value_counts(df, columns)
    best = counts.groupBy("column").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("mode"), F.max("c").alias("m"), F.sum("c").alias("n"))
    return best.select("column", "mode", (F.col("m") / F.col("n")).alias("share"))


def top_parents(df: DataFrame, parent: str, child: str, k: int = 3) -> DataFrame:
    """(p, n, top_child, kl): the ``k`` most frequent parent values, ties to the smaller, each with its most frequent
    child and the divergence (nats) of its children from those of all rows."""
    dist = conditional_distribution(df, parent, child)
    whole = dist.groupBy("c").agg(F.sum("n").alias("t")).withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy()))
    best = dist.groupBy("p").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "p").limit(k)
    both = dist.join(best, "p").join(whole, "c")
    return both.groupBy("p").agg(F.sum("n").alias("n"), F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("top_child"), F.sum(F.col("prob") * F.log(F.col("prob") / F.col("share"))).alias("kl"))


def characteristics(df: DataFrame) -> DataFrame:
    """One row about a table: rows, columns, bytes of its cells as text, share of numeric columns."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(len(df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.sum(size).alias("bytes")).join(numeric_share(df)).select("n_rows", F.col("n_columns"), "bytes", F.col("share").alias("numeric_share"))  # one row each


def runs(df: DataFrame, column: str, order: str, stripe: str) -> DataFrame:
    """(stripe, n, zero_share, run_share, mean_step): shares of zeros and of cells equal to the one before,
    and the mean absolute step.  Order holds within a stripe, so no task sees more than one stripe."""
    w = Window.partitionBy(stripe).orderBy(order)
    steps = df.select(F.col(stripe).alias("stripe"), F.col(column).alias("v"), F.lag(column).over(w).alias("before"))
    return steps.groupBy("stripe").agg(
        F.count("*").alias("n"), F.avg((F.col("v") == 0).cast("double")).alias("zero_share"),
        F.avg((F.col("v") == F.col("before")).cast("double")).alias("run_share"), F.avg(F.abs(F.col("v") - F.col("before"))).alias("mean_step"),
    )


def prepare(df: DataFrame) -> DataFrame:
    """Raw text cleaned: trimmed, unknown spellings null, columns whose every cell is a number cast to it."""
    from ..functions.codes import INTEGER, NUMBER, cleaned

    clean = df.select(*[cleaned(F.col(c)).alias(c) for c in df.columns])
    ask = [F.struct(F.count(c).alias("n"), F.count_if(F.col(c).rlike(NUMBER)).alias("num"), F.count_if(F.col(c).rlike(INTEGER) & (F.length(c) < 18)).alias("int")).alias(c) for c in df.columns]
    seen = clean.agg(*ask).first()
    kind = lambda s: "bigint" if s["n"] and s["n"] == s["int"] else "double" if s["n"] and s["n"] == s["num"] else "string"
    return clean.select(*[F.col(c).try_cast(kind(seen[c])).alias(c) for c in df.columns])


def numeric_share(df: DataFrame) -> DataFrame:
    """(n_columns, n_numeric, share): how many columns hold numbers only."""
    from ..functions.codes import NUMBER

    row = df.agg(*[(F.count_if(~F.trim(F.col(c).cast("string")).rlike(NUMBER) | F.col(c).isNull()) == 0).alias(c) for c in df.columns])
    yes = sum(F.col(c).cast("int") for c in df.columns)
    return row.select(F.lit(len(df.columns)).alias("n_columns"), yes.alias("n_numeric"), (yes / len(df.columns)).alias("share"))
