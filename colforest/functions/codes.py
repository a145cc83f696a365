"""Code lengths and other scalar functions, as column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(v: Column) -> Column:
    """Binary digits of a positive integer: exact, unlike a rounded logarithm."""
    return F.length(F.bin(v.cast("long"))).cast("long")


def gamma_bits(v: Column) -> Column:
    """Length of the Elias gamma code; 1 for 0 and below."""
    return F.when(v <= 0, F.lit(1)).otherwise(2 * bit_length(v) - 1).cast("long")


def golomb_bits(v: Column, m: Column) -> Column:
    """Length of the Golomb code with parameter ``m``: unary quotient, truncated binary remainder."""
    v, m = v.cast("long"), m.cast("long")
    width = bit_length(m - 1)
    rest = F.pmod(v, m)
    tail = F.when(rest < F.pow(F.lit(2.0), width).cast("long") - m, width - 1).otherwise(width)
    quotient = ((v - rest) / m).cast("long")
    return F.when(v <= 0, F.lit(1)).when(m <= 1, gamma_bits(v)).otherwise(quotient + 1 + tail).cast("long")


def golomb_parameter(mean: Column) -> Column:
    """The Golomb parameter for counts of a given mean (256 without counts or for means under 1)."""
    return F.when(mean.isNull() | (mean < 1), F.lit(256)).otherwise(F.least(F.greatest(F.floor(0.693 * mean), F.lit(8)), F.lit(8192))).cast("long")


def varint_length(v: Column) -> Column:
    """Bytes of the base-128 code of a non-negative integer."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7)).cast("long")


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def hash_bucket(v: Column, buckets: int) -> Column:
    """A bucket from the first 32 bits of MD5: the same in every session and engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(v.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % buckets).cast("long")


#: Units of byte counts, each 1,024 of the one before.
UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(n: Column, largest: str = UNITS[-1]) -> Column:
    """Bytes as text in the largest fitting unit up to ``largest``, one decimal; null for null.

    ``format_number`` rounds the exact value, ties to even, as C and Python do; ``format_string`` rounds its digits up."""
    def text(power: int) -> Column:
        return F.concat(F.call_function("format_number", n / 1024.0**power, F.lit("0.0")), F.lit(f" {UNITS[power]}"))

    top = UNITS.index(largest)
    out = text(top)
    for power in reversed(range(top)):
        out = F.when(n < 1024.0 ** (power + 1), text(power)).otherwise(out)
    return out


def throughput_text(size: Column, seconds: Column) -> Column:
    """Input bytes per second as text; '-' without a positive time."""
    mb = size / seconds / 1048576.0
    text = F.when(mb < 0.1, F.format_string("%.2f KB/s", mb * 1024)).when(mb < 1000, F.format_string("%.2f MB/s", mb)).otherwise(F.format_string("%.2f GB/s", mb / 1024))
    return F.when(seconds.isNull() | (seconds <= 0), F.lit("-")).otherwise(text)


def _scaled(text: Column, factor: dict[str, float]) -> Column:
    number = F.regexp_extract(text, r"([\d.]+)\s*([A-Za-z/]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([\d.]+)\s*([A-Za-z/]+)", 2)
    rate = F.lit(None).cast("double")
    for name, f in factor.items():
        rate = F.when(unit == name, F.lit(f)).otherwise(rate)
    return number * rate


def parse_bytes(text: Column) -> Column:
    """'3.5 MB' -> bytes, rounded down; null for anything else."""
    return F.floor(_scaled(text, {"B": 1.0, "KB": 1024.0, "MB": 1048576.0, "GB": 1073741824.0})).cast("long")


def parse_throughput(text: Column) -> Column:
    """'3.5 GB/s' -> MB per second; null for anything else."""
    return _scaled(text, {"KB/s": 1 / 1024, "MB/s": 1.0, "GB/s": 1024.0})


def short_label(text: Column, most: int = 15) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


#: Texts of numbers: what a cast may be trusted with (casts alone accept '1d').
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
#: Texts that mean 'unknown' in raw files (fixed values).
UNKNOWN = ("?", "NA", "N/A", "null", "")


def number(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def decimal_digits(text: Column) -> Column:
    """Digits after the point, without trailing zeros."""
    return F.length(F.regexp_extract(F.trim(text), r"[.]([0-9]*?)0*$", 1)).cast("long")


def cleaned(text: Column) -> Column:
    """Trimmed, with the spellings of 'unknown' as null."""
    t = F.trim(text)
    return F.when(t.isin(*UNKNOWN), F.lit(None)).otherwise(t)
