"""Operator 4: mixing sources to target weights by Sainte-Laguë apportionment.

The corpus has as many equal-token blocks to give as it has words: a block is one word, at any size of the
corpus, since a larger one would leave out documents, shards and sources that are smaller than it.  Blocks go
to the sources by the highest quotients target / (2 k + 1), none above three times its size.  The corpus is
dealt into shards by a seeded hash of the document; within a shard the documents of one source form a cell.
A source's blocks go to its cells, again by the highest quotients, of the cell's words: integer quotas per
shard, which sum to the source's.  A cell with quota q first repeats all its words while whole passes last
and then takes the leading blocks of its seeded order.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source of its
own, last in order; equal rows and rows of one id are separate documents; an empty table gives an empty result; columns of
the input other than the three it reads are not carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 11
#: Words of a shard: what one window or one apportionment task has to hold in order.
SHARD_WORDS = 1_000_000


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Words for each source: shares by weight of all words, none above ``most`` times its size, the
    excess shared again by weight among the others."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def sainte_lague(weights: Sequence[float], caps: Sequence[int], seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1), ties to the earlier party, none above its cap.

    The seats below a common divisor are found by bisection and the few that are left by sorting the next
    quotients, so the work does not grow with the number of seats."""
    w, cap = np.asarray(weights, float), np.asarray(caps, np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    out = np.zeros(len(w), np.int64)
    seats = min(int(seats), int(cap.sum()))
    if seats <= 0:
        return out
    given = lambda d: np.minimum(cap, np.floor(np.minimum(w / d, 2.0**60) + 0.5).astype(np.int64))
    low, high = 1e-12 * w.max(), 2.0 * w.max() + 1
    for _ in range(200):
        d = (low + high) / 2
        if given(d).sum() > seats:
            low = d
        else:
            high = d
    out = given(high * (1 + 1e-12))  # a little above the divisor, so that ties are broken by quotients, not by rounding
    while (left := seats - int(out.sum())) > 0:
        quotient = np.where(out < cap, w / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[: min(left, int((out < cap).sum()))]] += 1
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, row: str | None = None) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, and how it is taken: ``copies``
    whole passes and the first ``part`` words once more (taken = copies * size + part).  A column that names
    rows may be given as ``row``; it is carried as ``row_name``."""
    spark = docs.sparkSession
    name = F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(name, text, F.lit("order")).alias("lot"), F.xxhash64(name, text).alias("deal"), *([F.col(row).alias("row_name")] if row else []),
    )
    sized = stored(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()  # one row per source
    order = sorted(per_source, key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    aims = targets([r.source_size for r in order], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))])
    total = sum(r.source_size for r in order)
    quotas = sainte_lague(aims, [MOST_REPEATS * r.source_size for r in order], total)
    n_shards = max(1, math.ceil(total / SHARD_WORDS))
    plan = spark.createDataFrame([(r.source, r.source_size, a, int(q), i) for i, (r, a, q) in enumerate(zip(order, aims, quotas))], "p_source string, source_size long, target double, quota long, place int")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    dealt = dealt.withColumn("shard", F.pmod("deal", F.lit(n_shards))).drop("deal")
    cells = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        """All shards of one source, a row for each."""
        pdf = pdf.sort_values("shard")
        words = pdf["words"].to_numpy()
        return pd.DataFrame({"shard": pdf["shard"], "place": pdf["place"], "words": words, "grant": sainte_lague(words, MOST_REPEATS * words, int(pdf["quota"].iloc[0]))})

    grants = cells.groupBy("place").applyInPandas(apportion, "shard long, place int, words long, grant long")
    in_order = Window.partitionBy("shard", "place").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    whole = F.when(F.col("words") > 0, F.expr("grant div words")).otherwise(F.lit(0))
    return (
        placed.join(grants, ["shard", "place"])
        .withColumn("copies", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("grant") - F.col("copies") * F.col("words") - F.col("before"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part", *(["row_name"] if row else []))
    )


def materialise(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: every document as often as the mix repeats it, and
    one more row with the leading words of a document that the last pass takes in part.  Documents
    without words, and those the mix takes nothing of, are left out; a document taken in part keeps its
    own white space up to the cut.  Rows are named before they are mixed, so repeated ids and equal rows are
    taken each as the mix says; columns of ``docs`` may have any names but those that begin with _mix_."""
    row, size, part = "_mix_row", "_mix_size", "_mix_part"
    named = stored(docs.withColumn(row, F.monotonically_increasing_id()), "named")
    taken = mix(named, key, text, source, row=row).where("taken > 0").select(
        F.col("row_name").alias(row), F.col("size").alias(size),
        F.expr("if(part > 0, array_append(array_repeat(size, int(copies)), part), array_repeat(size, int(copies)))").alias(part),
    )
    rows = named.join(taken, row).withColumn(part, F.explode(part))

    names, word = docs.columns, re.compile(WORD)
    place, chars = names.index(text), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            part, size = columns.pop(-2), columns.pop(-1)
            short = np.flatnonzero(part.to_numpy() < size.to_numpy()).tolist()
            if short:
                texts = columns[place].to_pylist()
                lengths = columns[chars].to_pylist() if chars is not None else None
                for i in short:
                    left, end = part[i].as_py(), 0
                    for m in word.finditer(texts[i]):
                        left, end = left - 1, m.end()
                        if left == 0:
                            break
                    texts[i] = texts[i][:end]
                    if lengths is not None:
                        lengths[i] = end
                columns[place] = pa.array(texts, b.schema.field(place).type)
                if lengths is not None:
                    columns[chars] = pa.array(lengths, b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(b.schema)[:-2]))

    return rows.select(*docs.columns, part, size).mapInArrow(cut, docs.schema)
