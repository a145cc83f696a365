"""A small learned model of a column given others: embeddings, hidden layers, softmax; trained in numpy.

Training reads a bounded sample (``max_rows``).  Parameters are quantised to 16 bits before anything is
ranked, so what is coded is what is stored.  With one parent the whole model is a (parent x child) table;
with several, rows are scored where they lie.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairs import sample_rows, text_of
from .profile import conditional_distribution
from .ranker import nll_bits, rank_table

LEAST_ROWS, MOST_CLASSES, MOST_PARENTS = 100, 10_000, 8
#: Values of a parent with an embedding of their own: the most frequent; all others share one.  Rows scored at once.
MOST_VALUES, SCORED = 4_096, 64


@dataclass
class Net:
    """Embeddings of each parent, joined; dense layers with GELU; logits over the child's values."""

    parents: list[list[str]]
    children: list[str]
    weights: dict[str, np.ndarray]

    def hidden(self, ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        x = np.concatenate([self.weights[f"e{k}"][ids[:, k]] for k in range(ids.shape[1])], axis=1)
        kept, layer = [x], 0
        while f"w{layer}" in self.weights:
            z = x @ self.weights[f"w{layer}"] + self.weights[f"b{layer}"]
            x = z * _gate(z)
            kept += [z, x]
            layer += 1
        return kept, x @ self.weights["out"] + self.weights["out_b"]

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.hidden(ids)[1]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        z = self.logits(ids).astype(np.float64)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def ids(self, columns: Sequence[Sequence[str]]) -> np.ndarray:
        """Parent values as numbers; values not seen in training are the last, common one."""
        maps = [{v: i for i, v in enumerate(p)} for p in self.parents]
        return np.stack([np.array([m.get(v, len(m)) for v in c], dtype=np.int64) for m, c in zip(maps, columns)], axis=1)

    @property
    def model_bits(self) -> int:
        """Sixteen bits a parameter, a scale each tensor, and the values' texts."""
        text = sum(len(v.encode()) + 1 for p in [*self.parents, self.children] for v in p)
        return 16 * sum(w.size for w in self.weights.values()) + 32 * len(self.weights) + 8 * text

    def to_bytes(self) -> bytes:
        tensors = {k: (w.shape, float(np.abs(w).max(initial=0)) or 1.0) for k, w in self.weights.items()}
        body = b"".join(np.round(w / tensors[k][1] * 32767).astype("<i2").tobytes() for k, w in self.weights.items())
        head = json.dumps({"parents": self.parents, "children": self.children, "tensors": tensors}).encode()
        return len(head).to_bytes(8, "little") + head + body

    @staticmethod
    def from_bytes(data: bytes) -> Net:
        n = int.from_bytes(data[:8], "little")
        spec, at, weights = json.loads(data[8 : 8 + n]), 8 + n, {}
        for k, (shape, scale) in spec["tensors"].items():
            size = int(np.prod(shape))
            weights[k] = (np.frombuffer(data, "<i2", size, at).astype(np.float32) * np.float32(scale / 32767)).reshape(shape)
            at += 2 * size
        return Net(spec["parents"], spec["children"], weights)


def _gate(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))


def fit(parents: Sequence[Sequence[str]], child: Sequence[str], width: int = 16, hidden: Sequence[int] = (64,), epochs: int = 15, batch: int = 2048, rate: float = 0.01, seed: int = 0, most_values: int = MOST_VALUES) -> Net | None:
    """Train on aligned columns of texts; None with too few rows or too many classes.  The result is quantised."""
    child = np.asarray(child, dtype=object)
    classes = sorted(set(child))
    if len(child) < LEAST_ROWS or len(classes) > MOST_CLASSES or not parents or len(parents) > MOST_PARENTS:
        return None
    rng = np.random.default_rng(seed)
    # the most frequent values, ties to the smaller text
    values = [sorted(sorted((c := Counter(p)), key=lambda v: (-c[v], v))[:most_values]) for p in parents]
    if len(parents) > 4:
        width, hidden = max(4, width // 2), tuple(max(8, h // 2) for h in hidden)
    w: dict[str, np.ndarray] = {f"e{k}": rng.normal(0, 0.1, (len(v) + 1, width)) for k, v in enumerate(values)}
    size = width * len(values)
    for i, h in enumerate(hidden):
        w[f"w{i}"], w[f"b{i}"], size = rng.normal(0, np.sqrt(2 / size), (size, h)), np.zeros(h), h
    w |= {"out": rng.normal(0, np.sqrt(1 / size), (size, len(classes))), "out_b": np.zeros(len(classes))}
    net = Net(values, classes, {k: v.astype(np.float32) for k, v in w.items()})
    ids, place = net.ids(parents), {v: i for i, v in enumerate(classes)}
    y = np.array([place[c] for c in child])
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    best, worse, step = np.inf, 0, 0
    for _ in range(max(1, epochs)):
        total = 0.0
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            kept, z = net.hidden(ids[rows])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            total -= np.log(np.maximum(p[np.arange(len(rows)), y[rows]], 1e-10)).sum()
            p[np.arange(len(rows)), y[rows]] -= 1
            d = p / len(rows)
            grad = {"out": kept[-1].T @ d, "out_b": d.sum(axis=0)}
            d = d @ net.weights["out"].T
            for i in reversed(range(len(hidden))):
                x, zi = kept[2 * i], kept[2 * i + 1]
                g = _gate(zi)
                slope = g + zi * 2 * g * (1 - g) * 0.7978845608 * (1 + 3 * 0.044715 * zi**2)
                d = d * slope
                grad[f"w{i}"], grad[f"b{i}"] = x.T @ d, d.sum(axis=0)
                d = d @ net.weights[f"w{i}"].T
            for k in range(len(values)):
                grad[f"e{k}"] = np.zeros_like(net.weights[f"e{k}"])
                np.add.at(grad[f"e{k}"], ids[rows, k], d[:, k * width : (k + 1) * width])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-12)) + 1e-4 * net.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        worse = 0 if total < best - 1e-3 * len(y) else worse + 1
        rate = rate / 2 if worse == 2 else rate
        best = min(best, total)
        if worse >= 5:
            break
    return Net.from_bytes(net.to_bytes())


def train(df: DataFrame, parents: Sequence[str], child: str, key: str, max_rows: int = 50_000, **how) -> Net | None:
    """Fit on at most ``max_rows`` rows, the same for the same key."""
    part = sample_rows(df.select(key, *[text_of(p).alias(f"p{k}") for k, p in enumerate(parents)], text_of(child).alias("c")), key, max_rows).toPandas()
    return fit([part[f"p{k}"].tolist() for k in range(len(parents))], part["c"].tolist(), **how)


def scores(net: Net, columns: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(row -> its combination of parent values, combination -> class numbers from the likeliest down).

    Combinations are scored SCORED at a time, the last ones padded, in double precision and rounded, so an order
    does not depend on the batch a row came in: what one task codes, another decodes."""
    ids, row = np.unique(net.ids(columns), axis=0, return_inverse=True)
    padded = np.concatenate([ids, np.zeros((-len(ids) % SCORED, ids.shape[1]), ids.dtype)])
    prob = np.concatenate([net.probabilities(padded[a : a + SCORED]) for a in range(0, len(padded), SCORED)])[: len(ids)]
    return row.ravel(), np.argsort(-np.round(np.log(np.maximum(prob, 1e-30)), 6), axis=1, kind="stable")


def model_table(spark: SparkSession, net: Net) -> DataFrame:
    """(p, c, prob) of a model with one parent; the driver sends the parents, tasks make the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SCORED):
                p = b["p"].iloc[at : at + SCORED].to_numpy()
                prob = net.probabilities(net.ids([p]))
                yield pd.DataFrame({"p": np.repeat(p, prob.shape[1]), "c": np.tile(np.array(net.children, dtype=object), len(p)), "prob": prob.ravel()})

    return spark.createDataFrame([(p,) for p in net.parents[0]], "p string").mapInPandas(run, "p string, c string, prob double")


def model_ranks(spark: SparkSession, net: Net) -> DataFrame:
    """The rank table of a one-parent model, for rank_encode and rank_decode."""
    return rank_table(model_table(spark, net))


def with_ranks(df: DataFrame, parents: Sequence[str], child: str, net: Net) -> DataFrame:
    """``df`` with the rank of its child value under a model of several parents, scored batch by batch.  A value that
    the model has never seen has the rank beyond all others and stands as itself in ``unseen`` (null otherwise)."""
    rows = df.withColumns({**{f"_p{k}": text_of(p) for k, p in enumerate(parents)}, "_c": text_of(child)})
    names, n = df.columns, len(parents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {v: i for i, v in enumerate(net.children)}
        for b in batches:
            if not len(b):
                continue
            row, order = scores(net, [b[f"_p{k}"] for k in range(n)])
            y = b["_c"].map(place)
            new = y.isna().to_numpy()
            at = np.empty_like(order)
            np.put_along_axis(at, order, np.arange(order.shape[1])[None, :], axis=1)
            rank = np.where(new, len(place), at[row, y.fillna(0).to_numpy(np.int64)])
            yield b[names].assign(rank=rank.astype("int64"), unseen=b["_c"].where(new, None).astype(object))

    return rows.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("rank", T.LongType()), T.StructField("unseen", T.StringType())]))


def from_ranks(df: DataFrame, parents: Sequence[str], child: str, net: Net) -> DataFrame:
    """The inverse of :func:`with_ranks`."""
    rows = df.withColumns({f"_p{k}": text_of(p) for k, p in enumerate(parents)})
    names, n = [c for c in df.columns if c not in ("rank", "unseen")], len(parents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.array(net.children, dtype=object)
        for b in batches:
            if not len(b):
                continue
            row, order = scores(net, [b[f"_p{k}"] for k in range(n)])
            rank = b["rank"].to_numpy()
            known = values[order[row, np.minimum(rank, len(values) - 1)]]
            yield b[names].assign(**{child: np.where(rank < len(values), known, b["unseen"].to_numpy(object))})

    fields = [f for f in df.schema.fields if f.name in names]
    return rows.mapInPandas(run, T.StructType([*fields, T.StructField(child, T.StringType())]))


def choose(df: DataFrame, parent: str, child: str, key: str, margin: float = 0.0, **how) -> dict:
    """Whether a model or the histogram codes a column in fewer bits; the histogram wins ties within ``margin``."""
    from .pairs import pair_histogram, pair_scores

    spark = df.sparkSession
    hist_model = pair_scores(pair_histogram(df, [parent, child])).first()["bits"]
    hist_data = nll_bits(df, parent, child).first()["bits"]
    net = train(df, [parent], child, key, **how)
    out = {"histogram_bits": hist_model + hist_data, "model_bits": None, "use_model": False, "net": net}
    if net is not None:
        data = nll_bits(df, parent, child, model_table(spark, net)).first()["bits"]
        out["model_bits"] = net.model_bits + data
        out["use_model"] = out["model_bits"] + margin < out["histogram_bits"]
    return out


def averaged(df: DataFrame, parents: Sequence[str], child: str, net: Net) -> DataFrame:
    """(p, c, prob): a model's probabilities averaged over the rows of each value of the first parent."""
    combos = df.groupBy(*[text_of(p).alias(f"p{k}") for k, p in enumerate(parents)]).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prob = net.probabilities(net.ids([b[f"p{k}"] for k in range(len(parents))]))
            yield pd.DataFrame({"p": np.repeat(b["p0"].to_numpy(), prob.shape[1]), "c": np.tile(net.children, len(b)), "n": np.repeat(b["n"].to_numpy(), prob.shape[1]), "q": prob.ravel()})

    scored = combos.mapInPandas(run, "p string, c string, n long, q double")
    return scored.groupBy("p", "c").agg((F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("prob"))


def compare_distributions(df: DataFrame, parent: str, child: str, net: Net, floor: float = 1e-10) -> DataFrame:
    """(p, c, share, prob): the histogram's share and the model's probability side by side."""
    hist = conditional_distribution(df, parent, child).select("p", "c", F.col("prob").alias("share"))
    both = hist.join(model_table(df.sparkSession, net), ["p", "c"], "full_outer")
    return both.select("p", "c", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("prob", F.lit(floor)).alias("prob"))
