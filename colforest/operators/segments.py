"""An archive of a table: columns coded along their forest, stripe by stripe, restored exactly.

A stripe is a run of STRIPE rows.  Within it a root column is one segment, a child column one segment for
each value of its parent, in row order.  Each segment is stored by the codec that makes it smallest.  A
cell whose canonical text is not its own is kept as an exception, which covers odd spellings, rare values
and parse failures alike.
"""

from __future__ import annotations

import bz2
import json
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.forest import depths
from ..sources.tables import kept, numbered, shared_path
from . import kinds as K
from .models import Net
from .pairs import text_of

STRIPE = 131_072
LEVEL = 3
LEAST_BYTES = 30
#: Shares that make a codec worth trying.
REPEATS, DOMINANT, SMALL_ALPHABET = 0.2, 0.4, 32_768

try:
    import zstandard
except ImportError:  # zlib does
    zstandard = None


def pack(data: bytes) -> bytes:
    """Compressed, or as it is where that is not shorter; the first byte tells."""
    if len(data) >= LEAST_BYTES:
        body = zstandard.ZstdCompressor(level=LEVEL).compress(data) if zstandard else zlib.compress(data, LEVEL)
        if len(body) < len(data):
            return (b"z" if zstandard else b"g") + body
    return b"r" + data


def unpack(data: bytes) -> bytes:
    if data[:1] == b"r":
        return data[1:]
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else zlib.decompress(data[1:])


def varints(v: np.ndarray) -> bytes:
    """Zigzag base-128 codes, vectorised."""
    u = ((v << 1) ^ (v >> 63)).view(np.uint64)
    groups = np.stack([(u >> np.uint64(7 * k)) & np.uint64(127) for k in range(10)], axis=1).astype(np.uint8)
    length = np.maximum(1, 10 - (groups[:, ::-1] != 0).argmax(axis=1))
    length[u == 0] = 1
    place = np.arange(10)[None, :]
    more = place < (length - 1)[:, None]
    return (groups | (more * 128).astype(np.uint8))[place < length[:, None]].tobytes()


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(first, last - first + 1)).astype(np.uint64) * np.uint64(7)
    u = np.add.reduceat((b & 127).astype(np.uint64) << shift, first)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def encode_ints(v: np.ndarray, choice: str = "all") -> tuple[str, bytes]:
    """(codec, payload), the shortest of the codecs that the values make worth trying."""
    v = np.ascontiguousarray(v, dtype=np.int64)
    tried = {"plain": pack(varints(v))}
    if len(v) > 3:
        values, codes, counts = np.unique(v, return_inverse=True, return_counts=True)
        gaps = np.diff(v)
        if len(values) <= SMALL_ALPHABET or counts.max() > DOMINANT * len(v):
            width = np.uint8 if len(values) <= 256 else np.uint16 if len(values) <= 65_536 else np.uint32
            head = varints(np.array([len(values)])) + varints(np.diff(values, prepend=0))
            tried["dict"] = pack(np.array([len(head), np.dtype(width).itemsize], "<u4").tobytes() + head + codes.astype(width).tobytes())
        if choice == "all" or np.mean(gaps == 0) > REPEATS:
            with np.errstate(over="ignore"):
                tried["delta"] = pack(varints(np.diff(v, prepend=np.int64(0))))
            at = np.flatnonzero(np.concatenate([[True], gaps != 0]))
            if len(at) < len(v) * (1 - REPEATS):
                runs = varints(np.diff(np.append(at, len(v))))
                tried["runs"] = pack(np.array([len(runs)], "<u4").tobytes() + runs + varints(v[at]))
    codec = min(tried, key=lambda c: (len(tried[c]), c))
    return codec, tried[codec]


def decode_ints(codec: str, payload: bytes) -> np.ndarray:
    data = unpack(payload)
    if codec == "plain":
        return from_varints(data)
    if codec == "delta":
        with np.errstate(over="ignore"):
            return np.cumsum(from_varints(data))
    if codec == "runs":
        n = int(np.frombuffer(data, "<u4", 1)[0])
        return np.repeat(from_varints(data[4 + n :]), from_varints(data[4 : 4 + n]))
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    values = np.cumsum(from_varints(data[8 : 8 + n])[1:])
    return values[np.frombuffer(data[8 + n :], {1: np.uint8, 2: np.uint16, 4: np.uint32}[width])]


# ---- cells to codes and back -------------------------------------------------------------------------


def _code(kind: K.Kind, v: Column) -> Column:
    """The integer a cell's text stands for, null where it is not of the kind."""
    num = F.trim(v)
    if kind.name == "integer":
        return F.when(num.rlike(K.INTEGER), num.try_cast("bigint"))
    if kind.name == "decimal":
        return F.when(num.rlike(K.NUMBER), (num.try_cast(f"decimal(30,{kind.digits})") * F.lit(10**kind.digits)).try_cast("bigint"))
    if kind.name == "timestamp":
        return K.stamp_seconds(v)
    raise ValueError(kind.name)


def _text(kind: K.Kind, code: Column) -> Column:
    """The canonical text of a code."""
    if kind.name == "integer":
        return code.cast("string")
    if kind.name == "decimal":
        return (code.cast("decimal(30,0)") / F.lit(10**kind.digits)).cast(f"decimal(30,{kind.digits})").cast("string")
    return F.date_format(F.timestamp_seconds(code), K.STAMPS[0])


def tokenise(df: DataFrame, columns: Sequence[str], key: str, kinds: dict[str, K.Kind], rare: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes: row_id, c0, c1, ...; dictionary: col_id, code, value; exceptions: col_id, row_id, value)."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("row_id"), *[F.col(c).cast("string").alias(f"v{k}") for k, c in enumerate(columns)])
    dictionary, text_columns = None, []
    for k, c in enumerate(columns):
        if kinds[c].name in ("categorical", "float"):
            text_columns.append(k)
            seen = rows.where(F.col(f"v{k}").isNotNull()).groupBy(F.col(f"v{k}").alias("v")).agg(F.count("*").alias("c"), F.min("row_id").alias("first"))
            seen = kept(seen, "values")
            total = seen.agg(F.sum("c"), F.count("*")).first()
            common = seen.where(~K.rare_rule(total[0] or 0, total[1], rare)) if kinds[c].name == "categorical" else seen
            coded = numbered(common, ["first"], "code").select(F.lit(k).alias("col_id"), "code", F.col("v").alias("value"))
            dictionary = coded if dictionary is None else dictionary.unionByName(coded)
    dictionary = kept(dictionary, "dictionary") if dictionary is not None else spark.createDataFrame([], "col_id int, code long, value string")
    coded = rows
    for k, c in enumerate(columns):
        if k in text_columns:
            part = dictionary.where(F.col("col_id") == k).select(F.col("value").alias(f"v{k}"), F.col("code").alias(f"c{k}"))
            coded = coded.join(part, f"v{k}", "left")
        else:
            code = _code(kinds[c], F.col(f"v{k}"))
            coded = coded.withColumn(f"c{k}", F.when(_text(kinds[c], code) == F.col(f"v{k}"), code))
    coded = kept(coded, "codes")
    odd = [F.struct(F.lit(k).alias("col_id"), "row_id", F.col(f"v{k}").alias("value"), F.col(f"c{k}").isNull().alias("odd")) for k in range(len(columns))]
    exceptions = coded.select(F.explode(F.array(*odd)).alias("e")).select("e.*").where("odd").drop("odd")
    codes = coded.select("row_id", *[F.coalesce(f"c{k}", F.lit(-1)).cast("long").alias(f"c{k}") for k in range(len(columns))])
    return codes, dictionary, exceptions


#: Models by column: the columns that one is told from, and its stored bytes.
Nets = dict[int, tuple[list[int], bytes]]


def _rank_order(net: Net, given: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row -> its combination of given values, combination -> class numbers from the likeliest down).

    Both coder and decoder score the sorted distinct combinations, in double precision and rounded, so they
    agree on every order."""
    combos, row = np.unique(np.stack(given, axis=1), axis=0, return_inverse=True)
    z = np.round(np.log(np.maximum(net.probabilities(net.ids([list(map(str, combos[:, k].tolist())) for k in range(combos.shape[1])])), 1e-30)), 6)
    return row.ravel(), np.argsort(-z, axis=1, kind="stable")


def ranks_of(net: Net, given: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    row, order = _rank_order(net, given)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    known = np.array(list(map(int, net.children)), dtype=np.int64)
    by = np.argsort(known)
    at = by[np.minimum(np.searchsorted(known[by], v), len(known) - 1)]
    # a value that the model has never seen stands beyond all ranks, as itself
    return np.where(known[at] == v, place[row, at], len(known) + ((v << 1) ^ (v >> 63)))


def values_of(net: Net, given: list[np.ndarray], r: np.ndarray) -> np.ndarray:
    row, order = _rank_order(net, given)
    known = np.array(list(map(int, net.children)), dtype=np.int64)
    u = r - len(known)
    return np.where(u < 0, known[order[row, np.minimum(r, len(known) - 1)]], (u >> 1) ^ -(u & 1))


def learn_nets(codes: DataFrame, parents: Sequence[int], coder: str, **how) -> Nets:
    """Models for an archive: ``model`` where one beats the histogram, ``neural`` for every child column,
    ``autoregressive`` for every column but the first, from up to eight columns before it."""
    from . import models as M

    nets: Nets = {}
    for j in range(len(parents)):
        if coder == "autoregressive" and j:
            given = list(range(max(0, j - M.MOST_PARENTS), j))
            net = M.train(codes, [f"c{k}" for k in given], f"c{j}", "row_id", **how)
        elif coder in ("model", "neural") and parents[j] >= 0:
            given = [parents[j]]
            if coder == "model":
                chosen = M.choose(codes, f"c{parents[j]}", f"c{j}", "row_id", **how)
                net = chosen["net"] if chosen["use_model"] else None
            else:
                net = M.train(codes, [f"c{parents[j]}"], f"c{j}", "row_id", **how)
        else:
            net = None
        if net is not None and len(net.children) > 1:
            nets[j] = (given, net.to_bytes())
    return nets


def segments(codes: DataFrame, parents: Sequence[int], stripe: int = STRIPE, choice: str = "all", nets: Nets | None = None) -> DataFrame:
    """(col_id, stripe, parent_code, n, codec, payload); parent_code is null for roots and columns told by a model."""
    n, nets = len(parents), nets or {}

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        at, out = int(pdf["stripe"].iloc[0]), []
        for j in range(n):
            v = pdf[f"c{j}"].to_numpy(np.int64)
            if j in nets:
                v = ranks_of(Net.from_bytes(nets[j][1]), [pdf[f"c{k}"].to_numpy(np.int64) for k in nets[j][0]], v)
            if parents[j] < 0 or j in nets:
                out.append((j, at, None, len(v), *encode_ints(v, choice)))
                continue
            p = pdf[f"c{parents[j]}"].to_numpy(np.int64)
            order = np.argsort(p, kind="stable")
            values, first = np.unique(p[order], return_index=True)
            for code, part in zip(values.tolist(), np.split(v[order], first[1:])):
                out.append((j, at, code, len(part), *encode_ints(part, choice)))
        return pd.DataFrame(out, columns=["col_id", "stripe", "parent_code", "n", "codec", "payload"]).astype({"parent_code": "Int64"})

    striped = codes.withColumn("stripe", F.expr(f"row_id div {stripe}"))
    return striped.groupBy("stripe").applyInPandas(encode, "col_id int, stripe long, parent_code long, n long, codec string, payload binary")


def decode_segments(table: DataFrame, parents: Sequence[int], stripe: int = STRIPE, nets: Nets | None = None) -> DataFrame:
    """(row_id, c0, c1, ...) from segments: every column once those that it is told from are there."""
    n, nets = len(parents), nets or {}
    needs = {j: nets[j][0] if j in nets else [parents[j]] if parents[j] >= 0 else [] for j in range(n)}
    order: list[int] = []
    while len(order) < n:
        order += [j for j in range(n) if j not in order and all(k in order for k in needs[j])]

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["stripe"].iloc[0])
        done: dict[int, np.ndarray] = {}
        for j in order:
            own = pdf[pdf.col_id == j]
            if parents[j] < 0 or j in nets:
                done[j] = decode_ints(own.codec.iloc[0], own.payload.iloc[0])
                if j in nets:
                    done[j] = values_of(Net.from_bytes(nets[j][1]), [done[k] for k in nets[j][0]], done[j])
                continue
            p = done[parents[j]]
            places = np.argsort(p, kind="stable")
            parts = [decode_ints(r.codec, r.payload) for r in own.sort_values("parent_code").itertuples()]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if len(flat) != len(p):
                raise ValueError(f"stripe {at}, column {j}: {len(flat)} values for {len(p)} rows")
            v = np.empty(len(p), np.int64)
            v[places] = flat
            done[j] = v
        rows = len(next(iter(done.values())))
        return pd.DataFrame({"row_id": at * stripe + np.arange(rows), **{f"c{j}": done[j] for j in range(n)}})

    schema = "row_id long, " + ", ".join(f"c{j} long" for j in range(n))
    return table.groupBy("stripe").applyInPandas(decode, schema)


# ---- archives ----------------------------------------------------------------------------------------


def write_archive(df: DataFrame, path: str, columns: Sequence[str] | None = None, key: str | None = None, forest=None, rare: int = 1, stripe: int = STRIPE, learn: dict | None = None, coder: str = "histogram", timer: Callable[[str], None] | None = None, **how) -> None:
    """Archive ``df`` (cells as text) under ``path``.  ``key`` gives the order of the rows; ``coder`` is
    histogram, model, neural or autoregressive; ``timer`` hears the name of each stage that has ended."""
    from ..plans.forest import Forest, chain, learn_forest, maximum_forest

    if coder not in ("histogram", "model", "neural", "autoregressive"):
        raise ValueError(f"unknown coder {coder!r}")
    tick = timer or (lambda stage: None)
    spark = df.sparkSession
    columns = list(columns or [c for c in df.columns if c != key])
    order = [key] if key else columns
    rows = kept(numbered(df.select(*dict.fromkeys([*order, *columns])), order, "_row").select("_row", *[F.col(c).cast("string").alias(c) for c in columns]), "rows")
    tick("load")
    if forest is None:
        forest = learn_forest(rows, columns, key="_row", screen=True, **(learn or {})) if len(columns) > 1 else Forest(columns, [], [])
    elif forest == "chain":
        forest = Forest(columns, maximum_forest(len(columns), chain(len(columns))), [])
    tick("forest")
    kinds = K.infer_kinds(rows, columns)
    parents = forest.parents
    codes, dictionary, exceptions = tokenise(rows, columns, "_row", kinds, rare)
    tick("codes")
    nets = learn_nets(codes, parents, coder, **how)
    tick("models")
    deep = depths(parents)
    manifest = [(k, c, kinds[c].name, kinds[c].digits, parents[k], deep[k]) for k, c in enumerate(columns)]
    save = lambda t, name: t.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    save(spark.createDataFrame(manifest, "col_id int, name string, kind string, digits int, parent_id int, depth int").coalesce(1), "manifest")
    save(dictionary, "dictionary")
    save(exceptions, "exceptions")
    save(segments(codes, parents, stripe, nets=nets), "segments")
    save(spark.createDataFrame([(j, g, bytearray(b)) for j, (g, b) in nets.items()], "col_id int, given array<int>, net binary").coalesce(1), "models")
    save(forest.edge_table(spark).coalesce(1), "edges")
    save(spark.createDataFrame([("stripe", json.dumps(stripe)), ("columns", json.dumps(columns)), ("version", "1")], "key string, value string").coalesce(1), "options")
    tick("write")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, the columns): every cell as it was written, in its text form, null where it was null."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    manifest = sorted(read("manifest").collect())
    options = {r.key: json.loads(r.value) for r in read("options").collect()}
    nets = {r.col_id: (list(r.given), bytes(r.net)) for r in read("models").collect()}  # a few, of bounded size
    rows = decode_segments(read("segments"), [r.parent_id for r in manifest], options["stripe"], nets)
    dictionary = read("dictionary")
    for r in manifest:
        if r.kind in ("categorical", "float"):
            part = dictionary.where(F.col("col_id") == r.col_id).select(F.col("code").alias(f"c{r.col_id}"), F.col("value").alias(f"t{r.col_id}"))
            rows = rows.join(part, f"c{r.col_id}", "left")
        else:
            rows = rows.withColumn(f"t{r.col_id}", _text(K.Kind(r.kind, r.digits), F.col(f"c{r.col_id}")))
    odd = read("exceptions").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "value"))).alias("odd"))
    rows = rows.join(odd, "row_id", "left")
    cell = lambda r: F.when(F.coalesce(F.map_contains_key("odd", F.lit(r.col_id)), F.lit(False)), F.element_at("odd", F.lit(r.col_id))).otherwise(F.col(f"t{r.col_id}"))
    return rows.select("row_id", *[cell(r).alias(r.name) for r in manifest])


def round_trip(df: DataFrame, key: str, columns: Sequence[str] | None = None, stripe: int = STRIPE, **how) -> DataFrame:
    path = shared_path(df.sparkSession, "archive")
    write_archive(df, path, columns, key, stripe=stripe, **how)
    return read_archive(df.sparkSession, path)


def archive_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row about an archive: kinds, edges, dictionaries, exceptions, payload."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    m = read("manifest").agg(F.count_if(F.col("kind") != "categorical").alias("n_numeric"), F.count_if(F.col("kind") == "categorical").alias("n_categorical"), F.max("depth").alias("depth"))
    e = read("edges").agg(F.count("*").alias("n_edges"), F.avg("w").alias("avg_w"), F.max("w").alias("max_w"))
    d = read("dictionary").groupBy("col_id").agg(F.count("*").alias("v")).agg(F.avg("v").alias("avg_vocabulary"), F.max("v").alias("max_vocabulary"))
    x = read("exceptions").agg(F.count("*").alias("n_exceptions"), F.count_distinct("col_id").alias("columns_with_exceptions"))
    s = read("segments").agg(F.count("*").alias("n_segments"), F.sum(F.length("payload")).alias("payload_bytes"))
    return m.join(e).join(d).join(x).join(s)  # one row each


def segment_statistics(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(p, n, n_distinct, distinct_share): the segments a child column falls into."""
    return df.groupBy(text_of(parent).alias("p")).agg(F.count("*").alias("n"), F.count_distinct(text_of(child)).alias("n_distinct")).withColumn("distinct_share", F.col("n_distinct") / F.col("n"))


# ---- plain compressors to compare with ---------------------------------------------------------------

CODECS = {"gzip": lambda b: zlib.compress(b, 6), "bzip2": lambda b: bz2.compress(b, 9), "zstd": lambda b: zstandard.ZstdCompressor(level=19).compress(b) if zstandard else zlib.compress(b, 9)}


def codec_sizes(df: DataFrame, columns: Sequence[str], order: str, methods: Sequence[str] = tuple(CODECS), stripe: int = STRIPE) -> DataFrame:
    """(method, column, original, size): bytes of each column, and of whole rows (column '*'), before and after; compressed stripe by stripe."""
    rows = numbered(df.select(order, *columns), [order], "_row").select(F.expr(f"_row div {stripe}").alias("stripe"), "_row", *[text_of(c).alias(c) for c in columns])

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        bodies = {c: "\n".join(pdf[c]).encode() for c in columns}
        bodies["*"] = "\n".join(pdf[list(columns)].agg(",".join, axis=1)).encode()
        return pd.DataFrame([(m, c, len(b), len(CODECS[m](b))) for c, b in bodies.items() for m in methods], columns=["method", "column", "original", "size"])

    parts = rows.groupBy("stripe").applyInPandas(sizes, "method string, column string, original long, size long")
    return parts.groupBy("method", "column").agg(F.sum("original").alias("original"), F.sum("size").alias("size"))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often: sums of row hashes, no sort."""
    mark = lambda d: d.select(*sorted(d.columns)).agg(F.count("*"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(30,0)")), F.sum(F.hash(*sorted(d.columns)).cast("long"))).first()
    return mark(a) == mark(b)
