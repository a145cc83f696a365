"""Operator 7: exact top-k search with a bit-sliced index.

Attributes are fixed-point integers.  A block of rows keeps each attribute, quantised to a few bits, as
bitmaps: slice b of attribute d has a bit for every row.  For a block of queries the quantised inner
products are summed in bitmap arithmetic: a query's integer weight adds shifted slices with a ripple
carry, a negative weight adds complements.  The k-th largest sum is found from the most significant slice
downward.  Rows whose sum lies within the quantisation error of it are the boundary; only these have
their exact inner products taken.  A block of rows makes its slices once and some thousand queries pass
them, a few hundred at a time; the best k of each pair of blocks are merged.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; rows
of a null id take no part; rows are compared with queries of their own length; ties go to the smaller id;
a query has all candidates if there are fewer than k; every row of the query's id is the query's own, and
of repeated ids each row is a candidate of others, while the query is the least of their vectors, the shortest
first, then by components; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, QUERY_EVERY, SCALE = 10, 100, 1024
#: Rows and components of a block, queries that meet it in one task and queries that are summed at once; bits of
#: a quantised attribute.
BLOCK_ROWS, BLOCK_VALUES, BLOCK_QUERIES, BATCH_QUERIES, BITS = 8_192, 1 << 20, 8_192, 256, 7
U = np.uint64


def slices_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (attribute, bit, 64-row word) of non-negative integers (rows, attributes)."""
    rows, dims = x.shape
    words = (rows + 63) // 64
    out = np.zeros((dims, bits, words), dtype=U)
    for b in range(bits):
        set_ = np.zeros((dims, words * 64), dtype=np.uint8)
        set_[:, :rows] = ((x >> b) & 1).T
        out[:, b] = np.packbits(set_, axis=1, bitorder="little").view(U)
    return out


def sums(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bitmaps (query, slice, word) of sum over d of |w_d| times the attribute, or its complement where w_d < 0."""
    dims, bits, words = index.shape
    queries = len(weights)
    most = int(np.abs(weights).sum(axis=1).max(initial=0)) * (2**bits - 1)
    depth = max(1, most.bit_length())
    total = np.zeros((depth, queries, words), dtype=U)
    flip = np.where(weights < 0, ~U(0), U(0))
    size = np.abs(weights)
    for d in range(dims):
        for shift in range(int(size[:, d].max(initial=0)).bit_length()):
            on = np.flatnonzero((size[:, d] >> shift) & 1)
            if not len(on):
                continue
            carry = np.zeros((len(on), words), dtype=U)
            for b in range(shift, depth):
                old = total[b, on]
                if b - shift < bits:
                    add = index[d, b - shift][None, :] ^ flip[on, d, None]
                    half = old ^ add
                    total[b, on] = half ^ carry
                    carry = (old & add) | (half & carry)
                else:
                    total[b, on] = old ^ carry
                    carry &= old
                    if not carry.any():
                        break
    return total


def kth_largest(total: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest sum of each query among its valid rows (the smallest, if there are fewer)."""
    depth, queries, _ = total.shape
    tied = valid.copy()
    above = np.zeros(queries, dtype=np.int64)
    value = np.zeros(queries, dtype=np.int64)
    want = np.minimum(k, np.bitwise_count(valid).sum(axis=1, dtype=np.int64))
    for b in range(depth - 1, -1, -1):
        ones = tied & total[b]
        n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        take = above + n >= want
        value += np.where(take, 1 << b, 0)
        above += np.where(take, 0, n)
        tied = np.where(take[:, None], ones, tied & ~total[b])
    return value


def at_least(total: np.ndarray, floor: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Bitmaps of the valid rows whose sum is at least ``floor`` (by query)."""
    depth = len(total)
    more = np.zeros_like(valid)
    same = valid.copy()
    floor = np.maximum(floor, 0)
    same[floor >= 1 << depth] = 0
    for b in range(depth - 1, -1, -1):
        bit = ((floor >> b) & 1).astype(bool)[:, None]
        more |= np.where(bit, U(0), same & total[b])
        same &= np.where(bit, total[b], ~total[b])
    return more | same


class Index:
    """The slices of a block of rows (integer attributes), made once for all queries that pass."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, bits: int = BITS):
        self.rows, self.ids, self.bits = rows, ids, bits
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.step = max(1, int(np.ceil((int((self.high - self.low).max(initial=0)) + 1) / 2**bits)))
        self.slices = slices_of((rows - self.low) // self.step, bits)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query id, row id, score) of the best k rows of each query, exactly."""
        words, step = self.slices.shape[2], self.step
        # the wider the weights, the deeper the sums: they too are quantised, the error of both is bounded below
        wide = max(1, int(np.ceil(np.abs(queries).max(initial=0) / 2 ** (self.bits - 1))))
        weight = np.sign(queries) * (np.abs(queries) // wide)
        total = sums(self.slices, weight)
        # exact = wide * step * (sum over d of weight times quantised) + terms of the query alone + an error in [lo, hi]
        left, span = queries - wide * weight, (self.high - self.low)
        gap = np.minimum(step - 1, span)[None, :]
        wq = wide * weight
        lo = (np.minimum(left, 0) * span[None, :]).sum(axis=1) + (np.minimum(wq, 0) * gap).sum(axis=1)
        hi = (np.maximum(left, 0) * span[None, :]).sum(axis=1) + (np.maximum(wq, 0) * gap).sum(axis=1)
        margin = -(-(hi - lo) // (wide * step)) + 1
        valid = np.zeros((len(queries), words * 64), dtype=np.uint8)
        valid[:, : len(self.rows)] = self.ids[None, :] != query_ids[:, None]
        valid = np.packbits(valid, axis=1, bitorder="little").view(U)
        kth = kth_largest(total, valid, k)
        boundary = np.unpackbits(at_least(total, kth - margin, valid).view(np.uint8), axis=1, bitorder="little")[:, : len(self.rows)]
        out = []
        for q in range(len(queries)):
            at = np.flatnonzero(boundary[q])
            exact = self.rows[at] @ queries[q]
            best = np.lexsort((self.ids[at], -exact))[:k]
            out.append((np.full(len(best), query_ids[q]), self.ids[at[best]], exact[best]))
        return out


def fixed_point(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): usable vectors as arrays of floor(scale * component)."""
    x = F.col(vector)
    usable = x.isNotNull() & F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(usable).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    from .store import stored

    rows = stored(fixed_point(vectors, key, vector).withColumn("size", F.size("x")), "vectors")
    counts = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.sum("size")).first()
    row_blocks = max(1, -(-counts[0] // BLOCK_ROWS), -(-(counts[2] or 0) // BLOCK_VALUES))
    query_blocks = max(1, -(-counts[1] // BLOCK_QUERIES))
    block = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    stock = rows.withColumn("r", block(row_blocks, "vec_id", "x")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("size", "x")).alias("m")).select("vec_id", "m.size", "m.x")
    asked = asked.withColumn("q", block(query_blocks, "vec_id")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def pair(stock: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        if stock.num_rows and asked.num_rows:
            dims = stock.column("size")[0].as_py()
            flat = lambda t: np.asarray(t.column("x").combine_chunks().flatten(), dtype=np.int64).reshape(-1, dims)
            index = Index(flat(stock), stock.column("vec_id").to_numpy())
            queries, ids = flat(asked), asked.column("vec_id").to_numpy()
            for at in range(0, len(ids), BATCH_QUERIES):
                found += index.search(queries[at : at + BATCH_QUERIES], ids[at : at + BATCH_QUERIES], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(x)) for x in zip(*found)))))

    keys = ["r", "q", "size"]
    best = stock.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
