"""Delimited text in and out, Parquet to text, result tables, and where data sets lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import NUMBER

DELIMITERS = {r"\t": "\t", r"\n": "\n"}
#: File names that are products, not data sets (fixed values).
DERIVED = ("_restored", "_compressed", "_results", "_sample_out")


def delimiter_of(text: str) -> str:
    return DELIMITERS.get(text, text)


def head(spark: SparkSession, path: str, size: int = 8192) -> bytes:
    """The first bytes of a file, read through the file system Spark has for its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def line_ending(spark: SparkSession, path: str) -> str:
    return "\r\n" if b"\r\n" in head(spark, path) else "\n"


def breaks_in_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: some line has an odd number of quotes.  One pass over all lines,
    split like any text."""
    lines = spark.read.text(path)
    return not lines.where((F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1).isEmpty()


def scan(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool | None = None, columns: int | None = None, row_ids: bool = True) -> DataFrame:
    """Every line a row of texts c0, c1, ...; a header is a row like any other.

    The first row sets the number of columns.  Longer rows are left out, shorter ones are filled with the
    empty text, empty cells are the empty text.  ``row_id`` counts the rows that stay, in the order of the files'
    names and within each file.  ``multi_line`` allows line breaks in quoted cells, at the price of reading a file
    in one task; by default it is on only if some line has an odd number of quotes, so that plain files are split."""
    delimiter = delimiter_of(delimiter)
    if multi_line is None:
        multi_line = breaks_in_cells(spark, path)
    reader = spark.read.option("header", False).option("sep", delimiter).option("multiLine", multi_line).option("emptyValue", "").option("nullValue", "\x00none\x00").option("escape", '"')
    if columns is None:
        columns = len(reader.option("inferSchema", False).csv(path).columns)
    names = [f"c{i}" for i in range(columns)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad"]])
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", "_bad").csv(path)
    # rows of another length come with their text: those with more cells go
    cells = F.size(F.split(F.regexp_replace("_bad", '"([^"]|"")*"', "q"), rf"\Q{delimiter}\E"))
    # Spark packs files into tasks by size; a row's place is its file, the block of it, and where it came in its task
    spot = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_spot")]
    rows = rows.select(*names, (F.coalesce(cells, F.lit(0)) > columns).alias("_long"), *spot)
    rows = rows.where(~F.col("_long")).select(*[F.coalesce(n, F.lit("")).alias(n) for n in names], "_file", "_block", "_spot")
    if not row_ids:
        return rows.drop("_file", "_block", "_spot")
    from .tables import numbered

    return numbered(rows, ["_file", "_block", "_spot"]).drop("_file", "_block", "_spot")


def write_text(df: DataFrame, path: str, order: str | None = None, delimiter: str = ",", ending: str = "\n", header: bool = False, one_file: bool = False) -> None:
    """A folder of delimited files; rows in the order of ``order`` from file to file."""
    rows = df.orderBy(order).drop(order) if order else df
    if one_file:
        rows = rows.coalesce(1)
    rows.write.option("sep", delimiter_of(delimiter)).option("lineSep", ending).option("header", header).option("emptyValue", "").option("escape", '"').csv(path)


def parquet_to_text(spark: SparkSession, source: str, target: str, delimiter: str = ",") -> None:
    write_text(spark.read.parquet(source), target, delimiter=delimiter, header=True)


def prepare_file(spark: SparkSession, source: str, target: str, header: bool = False) -> None:
    """A raw file cleaned: delimiter found from its head, unknown spellings empty, numbers as numbers."""
    from ..operators.profile import prepare

    start = head(spark, source).decode("utf-8", "replace").split("\n")[0]
    sep = max([",", ";", "\t", "|"], key=start.count)
    raw = spark.read.option("header", header).option("sep", sep).option("ignoreLeadingWhiteSpace", True).csv(source)
    write_text(prepare(raw), target, header=True)


def read_results(spark: SparkSession, path: str, names: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """A result table: all but the named columns as numbers, null where they are none."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c) if c in names else F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double")).alias(c) for c in raw.columns])


def append_results(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Add rows to a result table, columns in a fixed order."""
    df.select(*columns).coalesce(1).write.mode("append").option("header", True).csv(path)


def not_done(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """What a sweep that is taken up again still has to do."""
    return todo.join(done.select(*on).distinct(), list(on), "left_anti")


def find_datasets(spark: SparkSession, folder: str) -> list[str]:
    """One text file of each subfolder, in any store Spark reads: a sample if there is one, products left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for sub in sorted((s.getPath() for s in store.listStatus(at) if s.isDirectory()), key=lambda p: p.getName()):
        files = sorted(f.getPath().getName() for f in store.listStatus(sub) if f.isFile())
        files = [f for f in files if f.endswith(".csv") and not any(d in f for d in DERIVED)]
        if files:
            out.append(f"{sub}/{next((f for f in files if 'sample' in f), files[0])}")
    return out
