"""Column kinds: what the texts of a column stand for, found in one aggregation per table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import INTEGER, NUMBER, decimal_digits, number
from .pairs import text_of

#: Patterns a timestamp may have (fixed values), the first being the one it is written in.
STAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.S", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.S", "yyyy-MM-dd'T'HH:mm:ssZ")
STAMP = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([+-][0-9]{4})?$"
SCALES = (1, 2, 4, 10, 100, 1000, 10000, 100000)
WHOLE_SHARE, STAMP_SHARE, SPARSE_SHARE, MOST_DIGITS = 0.995, 0.70, 0.50, 6


@dataclass(frozen=True)
class Kind:
    """integer, decimal (``digits`` after the point), float, timestamp or categorical."""

    name: str
    digits: int = 0
    scale: int = 1


def whole_at(v: Column, scale: int) -> Column:
    """Whether v times scale is an integer, within the accuracy of a double."""
    back = F.round(v * scale) / scale
    return F.abs(v - back) <= 1e-10 + 1e-9 * F.abs(back)


def kind_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_blank, n_number, n_integer, n_stamp, digits, whole_<scale>...), a row per column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text_of(c).alias("v")) for c in columns])).alias("s")).select("s.*")
    # values first: a column's facts need each distinct value once
    counts = long.groupBy("column", "v").agg(F.count("*").alias("c"))
    v, num = F.col("v"), number(F.col("v"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("long")
    fits = F.trim(v).rlike(INTEGER) & F.trim(v).try_cast("bigint").isNotNull()
    return counts.groupBy("column").agg(
        F.sum("c").cast("long").alias("n_rows"), total(F.trim(v) == "").alias("n_blank"), total(num.isNotNull()).alias("n_number"),
        total(fits | (whole_at(num, 1) & (F.abs(num) < 2.0**53))).alias("n_integer"), total((F.length(v) > 10) & v.rlike(STAMP)).alias("n_stamp"),
        F.coalesce(F.max(F.when(num.isNotNull(), decimal_digits(v))), F.lit(0)).cast("long").alias("digits"),
        *[total(whole_at(num, s)).alias(f"whole_{s}") for s in SCALES],
    )


def kind_column() -> Column:
    """The kind by name, from the columns of :func:`kind_facts`."""
    n = F.col("n_rows")
    scaled = F.greatest(*[F.col(f"whole_{s}") for s in SCALES]) >= WHOLE_SHARE * n
    return (
        F.when((F.col("n_number") == n) & (F.col("n_integer") == n), "integer")
        .when((F.col("n_number") == n) & scaled & (F.col("digits") <= MOST_DIGITS), "decimal")
        .when(F.col("n_number") == n, "float")
        .when(F.col("n_stamp") > STAMP_SHARE * n, "timestamp")
        .otherwise("categorical")
    )


def scale_column() -> Column:
    """The smallest scale at which nearly all rows are whole, null if none is."""
    out = F.lit(None).cast("int")
    for s in reversed(SCALES):
        out = F.when(F.col(f"whole_{s}") >= WHOLE_SHARE * F.col("n_rows"), F.lit(s)).otherwise(out)
    return out


def infer_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, Kind]:
    found = {r.column: r for r in kind_facts(df, columns).select("column", "digits", kind_column().alias("kind"), scale_column().alias("scale")).collect()}
    return {c: Kind(found[c].kind, int(found[c].digits), found[c].scale or 1) if c in found else Kind("categorical") for c in columns}


def parse_stamp(text: Column) -> Column:
    """A timestamp in any of the known patterns."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in STAMPS])


def stamp_seconds(text: Column) -> Column:
    return F.when((F.length(text) > 10) & text.rlike(STAMP), F.unix_timestamp(parse_stamp(text)))


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """(v, code, n): values numbered by first appearance."""
    from ..sources.tables import numbered

    seen = df.groupBy(text_of(column).alias("v")).agg(F.min(order).alias("_first"), F.count("*").alias("n"))
    return numbered(seen, ["_first"], "code").select("v", "code", "n")


def sorted_codes(df: DataFrame, column: str) -> DataFrame:
    """(v, code): values numbered in their order."""
    from ..sources.tables import numbered

    return numbered(df.select(text_of(column).alias("v")).distinct(), ["v"], "code")


def rare_limits(rows: int, vocabulary: int, threshold: int = 1) -> tuple[float, int]:
    """(share, count) below which a value is rare; larger tables and vocabularies have their own."""
    share, most = (0.01, threshold) if rows < 100_000 else (0.002, max(threshold, 4)) if rows < 1_000_000 else (0.0003, max(threshold, 15))
    # (vocabulary above, rows above, share, count at most, vocabulary per count): fixed values
    for above, rows_above, low, cap, per in ((10_000, 100_000, 0.0002, 50, 200), (5_000, 100_000, 0.0005, 30, 300), (2_000, 50_000, 0.002, 15, 250), (1_000, -1, 0.003, 8, 150)):
        if vocabulary > above and rows > rows_above:
            return min(share, low), max(most, min(cap, vocabulary // per))
    return share, most


def rare_rule(rows: int, vocabulary: int, threshold: int = 1) -> Column:
    """Whether value ``v`` of count ``c`` is rare; the empty text and 'nan' never are, nor is any at threshold 0."""
    if threshold == 0:
        return F.lit(False)
    share, most = rare_limits(rows, vocabulary, threshold)
    c, f = F.col("c"), F.col("c") / rows
    rule = ((c <= most) & (f < share)) | ((f < share / 2) & (c <= 2 * most))
    # (vocabulary from, to, count at most, share below): fixed values
    for low, high, count, below in ((10_000, None, 3, 1e-4), (50_000, None, 5, None), (20_000, 50_000, 4, None), (5_000, 10_000, 4, 2e-4), (2_000, 5_000, 3, 5e-4)):
        if vocabulary > low and (high is None or vocabulary <= high):
            rule = rule | ((c <= count) & (f < below) if below else c <= count)
    return rule & ~F.col("v").isin("", "nan")


def rare_values(df: DataFrame, column: str, threshold: int = 1) -> DataFrame:
    """(v, c, rare) of a column's values."""
    from ..sources.tables import kept

    counts = kept(df.groupBy(text_of(column).alias("v")).agg(F.count("*").alias("c")), "counts")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    return counts.withColumn("rare", rare_rule(total[0] or 0, total[1], threshold))


def sparse_sentinel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, share, sparse): whether one value fills so much of a column that the rest is kept as exceptions."""
    from .profile import dominance

    return dominance(df, columns).withColumn("sparse", F.col("share") > SPARSE_SHARE)


def sparse_parts(df: DataFrame, key: str, column: str) -> tuple[str | None, DataFrame]:
    """A sparse column apart: its dominant value, and patches (key, value) for the rows that have another."""
    from .profile import dominance

    row = dominance(df, [column]).first()
    mode = row["mode"] if row else None
    return mode, df.where(text_of(column) != F.lit(mode)).select(key, text_of(column).alias("value"))


def sparse_restored(keys: DataFrame, key: str, column: str, mode: str | None, patches: DataFrame) -> DataFrame:
    """The column again: the dominant value everywhere, but where there is a patch."""
    return keys.join(patches, key, "left").select(*keys.columns, F.coalesce("value", F.lit(mode)).alias(column))


def frequent_values(df: DataFrame, column: str, most: int) -> DataFrame:
    """(v, c): the ``most`` most frequent values of a column, ties to the smaller text."""
    return df.groupBy(text_of(column).alias("v")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "v").limit(most)


def occurrence_index(df: DataFrame, parent: str, order: str, stripe: Column | None = None) -> DataFrame:
    """``df`` with k: the how-manieth row of its parent value this is, within its stripe."""
    df = df.withColumn("stripe", stripe if stripe is not None else F.lit(0))
    return df.withColumn("k", F.row_number().over(Window.partitionBy("stripe", parent).orderBy(order)))
