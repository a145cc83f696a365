"""Operator 10: document fingerprints by spot signatures, in DataFrame operations only.

A spot signature is a common word, the anchor, and the chain of content words that follows it, up to CHAIN of
them.  Where content words go on beyond a chain without an anchor, the end of the chain is the next spot, so
texts of few common words have signatures too; there is one rule for all texts, and a changed word changes the
chains up to the next anchor only.  A text of common words alone has its words as its one signature.  The
fingerprint is the sorted set of signature hashes.

Pairs are partitioned by set length: a set's partition is the power of 1 / LEAST below its length, and sets
whose partitions are not neighbours, or whose lengths differ by more than the ratio, cannot have likeness LEAST;
they are never intersected.  A likeness below LEAST counts as 0, whether it was ruled out by length or computed.

``near_duplicates`` is the search over a whole table: classes of equal fingerprints are partitioned by set
length, candidates meet on the rarest parts of their sets, and the survivors are compared in full.

Defined results: a null text is the empty text; one without words has the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0; order among rows is by id, then a hash of the text, null
ids last; the last row is followed by the first, a single row by itself; equal texts have equal fingerprints;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of four languages that serve as anchors (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine für im ist mit und von zu "
    "au de du en est et la le les par pour que qui sur un une "
    "como con del el los las no por se su y"
).split()
CHAIN = 3
HEX = 8
#: Likeness that the report tells from 0.
LEAST = 0.1
#: Rows of an order bucket, on average; buckets at most (their bounds are constants of the plan), in runs of so many.
BUCKET_ROWS, MOST_BUCKETS, RUN = 2_000, 16_384, 128


def _prefix_tree(words: list[str]) -> str:
    """A pattern for exactly these words that looks at each character once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    tails = [c + _prefix_tree(rest) for c, rest in sorted(heads.items())]
    if not tails:
        return ""
    body = tails[0] if len(tails) == 1 and "" not in words else "(?:" + "|".join(tails) + ")"
    return body + ("?+" if "" in words else "")


def plain(text: Column) -> Column:
    """Lower-cased words (ASCII letters, digits and all beyond ASCII), one space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]++", " "), F.lit(" "))


_ANCHOR = _prefix_tree(sorted(set(ANCHORS))) + "(?= )"
_SPOT = rf"(?: {_ANCHOR})?+(?: (?!{_ANCHOR})[^ ]++){{1,{CHAIN}}}+"


def signatures(text: Column) -> Column:
    """Distinct signature hashes of a text, sorted: unsigned 32-bit numbers."""
    words = plain(text)
    spots = F.regexp_extract_all(words, F.lit(_SPOT), F.lit(0))
    found = F.when((F.size(spots) == 0) & (F.trim(words) != ""), F.array(F.trim(words))).otherwise(spots)
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.shiftrightunsigned(F.xxhash64(s), 32))))


def printed(sigs: Column) -> Column:
    """A signature set as text: HEX digits for each."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), HEX, "0")), "")


def fingerprint(text: Column) -> Column:
    return printed(signatures(text))


def partition(size: Column, least: float) -> Column:
    """The length partition of a set of ``size`` elements: sets of likeness ``least`` lie in the same or neighbouring ones."""
    return F.when(size > 0, F.floor(F.log(size) / math.log(1 / least) + 1e-9)).otherwise(-1)


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two signature sets if it is ``least`` or more, else 0; sets whose partitions or lengths
    rule that out are not intersected."""
    n, m = F.size(a), F.size(b)
    apart = (F.abs(partition(n, least) - partition(m, least)) > 1) | (F.least(n, m) < least * F.greatest(n, m))
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (n + m - common)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | apart, 0.0).otherwise(F.when(jaccard >= least, jaccard).otherwise(0.0))


def _bounds(rows: DataFrame) -> list[tuple[int | None, int]]:
    """The first (doc_id, h) of each bucket, in descending order: rows are range partitioned by their short keys
    alone, and each part hands over its greatest."""
    n = rows.count()
    parts = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    keys = rows.select("doc_id", "h").repartitionByRange(parts, F.desc_nulls_last("doc_id"), F.desc("h")).withColumn("part", F.spark_partition_id())
    tops = keys.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()  # MOST_BUCKETS numbers, or as many parts as there are
    return sorted({(r.top.doc_id, r.top.h) for r in tops}, key=lambda t: (t[0] is not None, t[0] or 0, t[1]), reverse=True)


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, guest, doc_id, h, text): rows dealt into buckets of neighbouring ids, descending; the first row of
    each bucket is also handed to the bucket before as a guest, so that no window reaches beyond its bucket.

    The bounds of the buckets are constants of the plan, so texts are shuffled once, to their bucket.  All rows of
    one id and one text are in one bucket."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    tops = _bounds(base)
    if not tops:
        return base.select(F.lit(0).alias("bucket"), F.lit(0).alias("guest"), "doc_id", "h", "text")
    bound = lambda some: F.expr("array(" + ",".join(f"named_struct('doc_id', cast({'null' if i is None else repr(str(i))} as bigint), 'h', cast('{h}' as bigint))" for i, h in some) + ")")
    own = F.struct("doc_id", "h")
    before = lambda some: F.size(F.filter(some, lambda t: t >= own))
    # how many bounds are not below a row: first by runs of them, then within a run
    bounds, run = bound(tops), before(bound(tops[::RUN])) - 1
    dealt = base.withColumn("run", run).withColumn("bucket", F.col("run") * RUN + before(F.slice(bounds, F.col("run") * RUN + 1, RUN)) - 1)
    first = F.element_at(bounds, F.col("bucket") + 1) == own
    at = lambda bucket, guest: F.struct(bucket.alias("b"), F.lit(guest).alias("guest"))
    home, away = at(F.col("bucket"), 0), at(F.pmod(F.col("bucket") - 1, F.lit(len(tops))), 1)
    dealt = dealt.withColumn("at", F.explode(F.when(first, F.array(home, away)).otherwise(F.array(home))))
    return dealt.select(F.col("at.b").alias("bucket"), F.col("at.guest").alias("guest"), "doc_id", "h", "text").repartition("bucket")


def neighbour_window() -> Window:
    return Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("h"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third of code points replaced by as many (or all) of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def neighbour_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likenesses to that and to the next document."""
    w = neighbour_window()
    rows = successors(docs, key, text).withColumn("sigs", signatures(F.col("text")))
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_sigs": F.lead("sigs").over(w)}).where("guest = 0")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        F.col("doc_id").alias(key), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sigs")).alias("fingerprint"), printed(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of fingerprint classes, by their smallest ids, whose likeness is ``least`` or more.

    Equal fingerprints are one class, so copies are never paired.  Sets of likeness t lie in the same or in
    neighbouring length partitions and share one of the rarest (1 - t) n + 1 elements of each.  Only ids and
    lengths meet there, and lengths are tested first; the sets follow for the distinct pairs that are left."""
    classes = docs.select(F.col(key).cast("long").alias("id"), signatures(F.coalesce(F.col(text), F.lit(""))).alias("s")).groupBy("s").agg(F.min("id").alias("id")).where(F.size("s") > 0)
    elements = classes.select("id", F.size("s").alias("n"), F.explode("s").alias("e"))
    rarity = elements.groupBy("e").agg(F.count("*").alias("c"))
    order = Window.partitionBy("id").orderBy("c", "e")
    probes = elements.join(rarity, "e").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    probes = probes.select("id", "n", "e", partition(F.col("n"), least).alias("part"))
    left = probes.select(F.col("id").alias("a"), F.col("n").alias("na"), "e", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = probes.select(F.col("id").alias("b"), F.col("n").alias("nb"), "e", "part")
    pairs = left.join(right, ["e", "part"]).where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = lambda c: classes.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least))
    return both.where(F.col("likeness") >= least).select("a", "b", "likeness")
