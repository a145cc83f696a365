"""Operator 3: near-duplicate documents by HyperMinHash registers.

A document is the set of its distinct word shingles.  Each of its K registers keeps the minimum of a
hash as a count of leading zeros and a few mantissa bits: two bytes.  Elements are dealt to registers in
streams, and a register that stays empty is filled by a minimum of its own, so sets of one element and
of a million have full, comparable registers.

1. Documents with equal sets are one class, represented by its smallest id.
2. Bands of registers put representatives into buckets; a bucket is a star around its smallest id.
   Components of the stars are clusters: two documents that share any bucket are in one cluster.
3. Clusters are dealt into blocks of bounded weight, by shingles and by documents.  Within a block, an
   inverted index of the rarest shingles of each set yields candidates: sets that reach the threshold share
   one of them.  Candidates not yet connected whose register estimate, corrected for register collisions,
   reaches the threshold less five standard errors are verified on their full sets; only links that join two
   components are kept.  A block of a large cluster also meets the cluster's pivots.
4. In large clusters, the registers of documents outside the cluster's largest component meet those of every
   block, in chunks; candidates in other components are verified on their texts, so that no link between
   different texts is lost, whatever the size of a group of copies.
5. Components of the links give the result.

With 48 bands of 6 registers a pair at similarity 0.8 shares no bucket with probability below 1e-6.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with
nothing; fewer words than a shingle make one shingle; rows with one id are one document; a null id is
linked with nothing, has a null component and is kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import drop_stored, released, stored
from .textkit import LOWER, U, buffers, mix, slices, windows, words

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 48, 6
K = BANDS * ROWS
STREAMS, MANTISSA, MOST_ZEROS, HASH_BITS = 8, 12, 15, 48
#: Shingles in a block of a cluster, and how many a document counts as besides its own: a block holds 4,000 documents
#: at most; pivots of a large cluster, bytes of a numpy pass.
BLOCK_SHINGLES, DOCUMENT_SHINGLES, PIVOTS, PASS_BYTES = 200_000, 50, 32, 1 << 18
_SALT = np.random.default_rng(77).integers(1, 2**63, size=STREAMS + K, dtype=np.uint64)
_EMPTY = U(2**63)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct 52-bit shingle hashes, cuts by row) of runs of rows."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets, PASS_BYTES):
        for a2 in range(a, b, 4096):
            b2 = min(b, a2 + 4096)
            part = offsets[a2 : b2 + 1] - offsets[a2]
            w = words(data[offsets[a2] : offsets[b2]], part, lower=True)
            h, n = w.hashes(), np.diff(w.first)
            at, value = windows(h, w.first, size)
            row = np.searchsorted(w.first, at, side="right") - 1
            for short in range(1, size):
                few = np.flatnonzero(n == short)
                if len(few):
                    # the words of such a row alone, as one window
                    only = np.concatenate([h[w.first[i] : w.first[i] + short] for i in few])
                    _, v = windows(only, np.arange(0, len(only) + 1, short), short)
                    row, value = np.append(row, few), np.append(value, v)
            keys = np.unique((row.astype(U) << U(52)) | (value >> U(12)))
            cuts = np.searchsorted(keys >> U(52), np.arange(b2 - a2 + 1, dtype=U))
            yield a2, keys & U(2**52 - 1), cuts


def _code(least: np.ndarray, salt: int) -> np.ndarray:
    """Leading zeros and mantissa of 48-bit minima."""
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(HASH_BITS - length, MOST_ZEROS)
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(U)
    mantissa = (least >> shift) & U(2**MANTISSA - 1)
    return ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16) ^ np.uint16(salt * 0x9E37 & 0xFFFF)


def registers(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (rows x K) of sets given as runs of ``values``; rows without elements are zero."""
    rows = len(cuts) - 1
    out = np.zeros(rows * K, np.uint16)
    filled = np.zeros(rows * K, bool)
    sizes = np.diff(cuts)
    row = np.repeat(np.arange(rows), sizes)
    v = values
    for s in range(STREAMS):
        h = mix(v ^ _SALT[s])
        slot = row * K + ((h & U(0xFFFF)) * U(K) >> U(16)).astype(np.int64)
        open_ = ~filled[slot]
        least = np.full(rows * K, _EMPTY)
        np.minimum.at(least, slot[open_], h[open_] >> U(16))
        new = np.flatnonzero(least != _EMPTY)
        out[new] = _code(least[new], s)
        filled[new] = True
        more = ~filled.reshape(rows, K).all(axis=1)
        keep = more[row]
        if not keep.any():
            return out.reshape(rows, K)
        v, row = v[keep], row[keep]
    for r in np.flatnonzero((sizes > 0) & ~filled.reshape(rows, K).all(axis=1)).tolist():
        gaps = np.flatnonzero(~filled[r * K : (r + 1) * K])
        own = values[cuts[r] : cuts[r + 1]]
        least = np.array([int(mix(own ^ _SALT[STREAMS + g]).min() >> U(16)) for g in gaps.tolist()], dtype=U) if len(own) > 4096 else mix(own[:, None] ^ _SALT[STREAMS + gaps][None, :]).min(axis=0) >> U(16)
        out[r * K + gaps] = _code(least, STREAMS)
    return out.reshape(rows, K)


def collision(n: np.ndarray, m: int) -> np.ndarray:
    """Chance that registers of unrelated sets of n and m elements agree: equal zeros, then equal mantissas."""
    z = np.arange(MOST_ZEROS + 2)
    tail = lambda k: 1 - (1 - 2.0 ** -z[None, :]) ** np.maximum(np.asarray(k, float).reshape(-1, 1) / K, 1)
    a, b = tail(n), tail([m])
    return ((a[:, :-1] - a[:, 1:]) * (b[:, :-1] - b[:, 1:])).sum(axis=1) / 2**MANTISSA


def estimate(reg: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """Jaccard estimates of one set against many, corrected for collisions."""
    agree = (reg == one[None, :]).mean(axis=1)
    c = collision(sizes, size)
    return (agree - c) / (1 - c)


def set_key(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set."""
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.zeros(len(values) + 1, U)
        np.cumsum(mix(values ^ U(salt)), out=total[1:])
        out.append(mix(total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key as doc_id, n_shingles, the set's name (k1, k2) and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, values, cuts in shingle_sets(b.column(1), size):
                k1, k2 = set_key(values, cuts)
                reg = registers(values, cuts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, len(k1)).cast(pa.int64()), pa.array(np.diff(cuts)), pa.array(k1), pa.array(k2), pa.array([r.tobytes() for r in reg], pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "registers"],
                )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(lambda batches: released(run(batches)), "doc_id long, n_shingles long, k1 long, k2 long, registers binary")


def _limit(percent: int) -> float:
    """Estimates below this are not looked at: the threshold less five standard errors."""
    share = percent / 100
    return share - 5 * math.sqrt(share * (1 - share) / K)


def _likely(reg: np.ndarray, lens: np.ndarray, x: int, near: np.ndarray, percent: int) -> np.ndarray:
    """Of the rows ``near``, those whose length and registers may reach the threshold with row ``x``."""
    near = near[np.minimum(lens[near], lens[x]) * 100 >= percent * np.maximum(lens[near], lens[x])]
    return near[estimate(reg[near], lens[near], reg[x], int(lens[x])) >= _limit(percent)] if len(near) else near


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("rep").to_numpy(), np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(table.num_rows, K)


def _pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})


def _links(table: pa.Table, percent: int, size: int) -> pa.Table:
    """Links within a block that join components."""
    ids, reg = _rows_of(table)
    n = table.num_rows
    sets: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    for a, values, cuts in shingle_sets(table.column("text"), size):
        for i in range(len(cuts) - 1):
            sets[a + i] = values[cuts[i] : cuts[i + 1]]
    lens = np.array([len(s) for s in sets])
    # shingles by how rare they are in the block: two sets that reach the threshold share one of the first
    # n - ceil(n * percent / 100) + 1 of each in that order
    every, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(every))
    codes = np.split(rank[code], np.cumsum(lens)[:-1])
    heads = [np.sort(c)[: len(c) - -(-len(c) * percent // 100) + 1] for c in codes]
    flat, owner = np.concatenate(heads), np.repeat(np.arange(n), [len(h) for h in heads])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label = np.arange(n)
    pairs: list[tuple[int, int]] = []
    for x in range(n):
        lo, hi = np.searchsorted(flat, heads[x], "left"), np.searchsorted(flat, heads[x], "right")
        run = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum())
        near = owner[at]
        near = np.unique(near[label[near] != label[x]])
        for y in _likely(reg, lens, x, near, percent).tolist():
            if label[y] == label[x]:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (lens[x] + lens[y] - common):
                pairs.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return _pair_table(pairs)


def _visits(table: pa.Table, percent: int) -> pa.Table:
    """Candidates among a block's members for its visitors, in components other than theirs."""
    ids, reg = _rows_of(table)
    visits = np.array(table.column("visits").to_pylist(), bool)
    lens, root = table.column("n").to_numpy(), table.column("root").to_numpy()
    hosts = np.flatnonzero(~visits)
    pairs = []
    for x in np.flatnonzero(visits).tolist():
        pairs += [(int(ids[x]), int(ids[y])) for y in _likely(reg, lens, x, hosts[root[hosts] != root[x]], percent).tolist()]
    return _pair_table(pairs)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The ``pairs`` (u, v) whose full sets reach the threshold; ``texts`` is (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            both = [[values[cuts[i] : cuts[i + 1]] for _, values, cuts in shingle_sets(b.column(c), size) for i in range(len(cuts) - 1)] for c in (2, 3)]
            for i, (x, y) in enumerate(zip(*both)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield b.select([0, 1]).filter(pa.array(keep))

    rows = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("rep").alias("v"), F.col("text").alias("tv")), "v")
    return rows.select("u", "v", "tu", "tv").mapInArrow(lambda batches: released(run(batches)), "u long, v long")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketch = stored(sketches(docs, key, text, size), "sketches")
    classes = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = classes.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "registers", "n_shingles")).alias("m"))
    reps = stored(reps.select("k1", "k2", F.col("m.doc_id").alias("rep"), F.col("m.registers").alias("registers"), F.col("m.n_shingles").alias("n")), "classes")
    width = 2 * ROWS
    banded = reps.select("rep", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(registers, b * {width} + 1, {width})))")).alias("band"))
    from pyspark.sql import Window

    stars = banded.withColumn("v", F.min("rep").over(Window.partitionBy("band"))).where("rep <> v").select(F.col("rep").alias("u"), "v")
    tree = components(stars, "clusters")
    member = tree.select(F.col("v").alias("cluster"), F.col("u").alias("rep")).union(tree.select(F.col("v").alias("cluster"), F.col("v").alias("rep")).distinct())
    member = member.join(reps.select("rep", "registers", "n"), "rep")
    weight = member.groupBy("cluster").agg(F.sum(F.col("n") + DOCUMENT_SHINGLES).alias("w")).withColumn("blocks", F.ceil(F.col("w") / BLOCK_SHINGLES).cast("int"))
    member = member.join(weight.select("cluster", "blocks", "w"), "cluster")
    member = member.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    member = stored(member.join(texts, "rep"), "members")
    total = member.agg(F.sum(F.col("n") + DOCUMENT_SHINGLES)).first()[0] or 0
    small_tasks = total // BLOCK_SHINGLES + 1
    task = F.when(F.col("blocks") == 1, F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(small_tasks)))).otherwise(F.concat_ws("-", "cluster", "block"))
    at_home = member.select(task.alias("task"), "rep", "text", "registers")
    large = member.where("blocks > 1")
    rank = Window.partitionBy("cluster", "block").orderBy(F.xxhash64("rep", F.lit(5)))
    pivots = large.where("block = 0").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PIVOTS)
    guests = pivots.withColumn("to", F.explode(F.expr("sequence(1, blocks - 1)"))).select(F.concat_ws("-", "cluster", "to").alias("task"), "rep", "text", "registers")
    pair_type = "u long, v long"

    def links(t: pa.Table) -> pa.Table:
        return _links(t, percent, size)

    first = stored(at_home.unionByName(guests).groupBy("task").applyInArrow(links, pair_type), "links")
    # what stands outside the largest component of a large cluster meets every block of it
    big = large.select("cluster", "rep", "blocks", "n")
    if big.limit(1).count():
        inner = components(first.join(big.select(F.col("rep").alias("u")).distinct(), "u", "left_semi"), "inner")
        placed = big.join(inner.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        sizes = placed.groupBy("cluster", "root").agg(F.count("*").alias("c"))
        main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
        outside = placed.join(main, "cluster").where("root <> main").select("cluster", "rep", "n")
        chunks = outside.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") + DOCUMENT_SHINGLES) / BLOCK_SHINGLES).cast("int").alias("chunks"))
        outside = outside.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("chunks")).cast("int"))
        placed = large.select("cluster", "rep", "block", "blocks", "n", "registers").join(placed.select("rep", "root"), "rep")
        visitors = placed.join(outside.select("rep", "chunk"), "rep").withColumn("to", F.explode(F.expr("sequence(0, blocks - 1)")))
        visitors = visitors.select(F.concat_ws("-", "cluster", "to", "chunk").alias("task"), "rep", "root", "n", "registers", F.lit(True).alias("visits"))
        hosts = placed.join(chunks, "cluster").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        hosts = hosts.select(F.concat_ws("-", "cluster", "block", "chunk").alias("task"), "rep", "root", "n", "registers", F.lit(False).alias("visits"))
        met = hosts.unionByName(visitors).groupBy("task").applyInArrow(lambda t: _visits(t, percent), pair_type)
        links_in, first = first, stored(first.union(verified(met.distinct(), large.select("rep", "text"), percent, size)), "links")
        drop_stored(links_in, inner)
    root = components(first, "components")
    drop_stored(member, tree, first)
    of_class = reps.select("k1", "k2", "rep").join(root.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of documents that are not the smallest of their component; all columns stay."""
    gone = link_components(docs, key, text, size, percent).where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(stored(gone, "gone"), F.col(key) == F.col("_gone_id"), "left_anti")
