"""Operator 8: a content-addressed archive of web records.

Two tables make an archive.  ``payloads`` holds the bytes of each distinct payload once, under its
SHA-256; ``records`` holds the exact header bytes of every record, its type and the digest it points to.
Original records come back by joining the two.  Digests are verified twice: when writing, a second,
independent digest and the length must agree within each SHA-256; when reading, each response is rebuilt byte
for byte and parsed, and SHA-256 is taken anew from the bytes that follow its header.

Defined results: a null payload is the empty payload; payloads shorter than ``least`` bytes are stored
once too, but all their records are responses; of equal payloads the smallest id is the response (a null
id is larger than any); an empty table gives an empty archive; a null url gives an empty target URI; pages have no time, so all records have the one date given;
repeated rows with one id give one response and otherwise equal records; clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop_stored, new_path, stored

#: Payloads of fewer bytes are never revisits (fixed value of the contract).
LEAST_REVISIT = 100
CRLF = "\r\n"
#: What records say of their time unless told otherwise: pages come without one.
DATE = "1970-01-01T00:00:00Z"


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT, date: str = DATE) -> None:
    """Write the archive of ``pages`` to ``path``/payloads and ``path``/records."""
    page = pages.select(
        F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("body"),
    ).withColumns({"digest": F.sha2("body", 256), "bytes": F.octet_length("body").cast("long")})
    facts = stored(page.select("page_id", "url", "digest", "bytes", F.xxhash64("body").alias("second")), "page-facts")
    # one row per payload leaves each task: copies of one page are summed before the shuffle
    groups = facts.groupBy("digest").agg(
        F.coalesce(F.min("page_id"), F.lit(None)).alias("first_id"), F.min("bytes").alias("bytes"), F.max("bytes").alias("most"),
        F.min("second").alias("second"), F.max("second").alias("other"), F.count("*").alias("copies"),
    )
    groups = groups.select(
        "digest", "first_id", "bytes", "copies",
        F.when((F.col("most") == F.col("bytes")) & (F.col("other") == F.col("second")), True).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), "digest"))).alias("verified"),
    )
    response = (F.col("bytes") < least) | F.col("page_id").eqNullSafe(F.col("first_id"))
    known = facts.select("page_id", "url", "digest").join(groups, "digest").where("verified")
    kind = F.when(response, "response").otherwise("revisit")
    refers = F.when(~response, F.col("first_id"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit(f"{CRLF}WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(f">{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.when(response, F.col("bytes")).otherwise(F.lit(0)).cast("string"), F.lit(CRLF + CRLF),
    )
    records = known.select("page_id", "digest", kind.alias("record_type"), refers.alias("refers_to"), F.encode(head, "UTF-8").alias("header"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    # any copy will do: within a verified digest all are equal, and a task hands on one of each
    page.groupBy("digest").agg(F.first("body").alias("body")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    drop_stored(facts)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, body): the stored payloads."""
    return spark.read.parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the original records, byte for byte: header, payload (responses only), end of record."""
    heads = spark.read.parquet(f"{path}/records")
    end = F.lit(bytearray((CRLF + CRLF).encode()))
    whole = heads.where("record_type = 'response'").join(payloads(spark, path), "digest").select("page_id", F.concat("header", "body", end).alias("record"))
    return whole.unionByName(heads.where("record_type <> 'response'").select("page_id", F.concat("header", end).alias("record")))


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, empty if there is none."""
    return F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def parse(records: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, stated, payload_digest, payload_bytes) of records from their bytes alone; the
    last two are taken from the payload and null for a revisit.  A record that contradicts itself is an error."""
    rows = records.select("page_id", "record", F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1).alias("header"))
    rows = rows.withColumns({
        "record_type": header_field(F.col("header"), "WARC-Type"), "stated": F.regexp_replace(header_field(F.col("header"), "WARC-Payload-Digest"), "^sha256:", ""),
        "refers_to": F.expr("try_cast(nullif(regexp_extract(header, 'WARC-Refers-To: <urn:page:(-?[0-9]+)>', 1), '') as bigint)"),
        "length": header_field(F.col("header"), "Content-Length").cast("int"), "starts": F.octet_length("header") + len(CRLF + CRLF),
    }).withColumn("body", F.col("record").substr(F.col("starts") + 1, F.col("length")))
    whole = (F.octet_length("record") == F.col("starts") + F.col("length") + len(CRLF + CRLF)) & (F.octet_length("body") == F.col("length"))
    response, digest = F.col("record_type") == "response", F.sha2("body", 256)
    return rows.select(
        "page_id", "record_type", "refers_to", "stated",
        F.when(response, checked(whole & (digest == F.col("stated")), digest, "a record's payload is damaged")).alias("payload_digest"),
        F.when(response, F.col("length").cast("long")).alias("payload_bytes"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: what its own bytes say; a revisit has the verified facts of the payload it names."""
    rows = stored(parse(reconstruct(spark, path)), "parsed")
    first = rows.where("record_type = 'response'").groupBy("stated").agg(F.first("payload_bytes").alias("bytes"))
    revisits = rows.where("record_type <> 'response'").join(first, "stated", "left")
    revisits = revisits.select("page_id", "record_type", "refers_to", "stated", checked(F.col("bytes").isNotNull(), F.col("stated"), "a revisit has no response").alias("payload_digest"), F.col("bytes").alias("payload_bytes"))
    return rows.where("record_type = 'response'").unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` into the shared folder and read it back."""
    spark = pages.sparkSession
    path = new_path(spark, "archive")
    write(pages, path)
    return read(spark, path)
