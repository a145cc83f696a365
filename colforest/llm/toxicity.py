"""Operator 6: toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the first bytes of longer words, hashed to 32 bits; a document has
each term or not.  Training takes a bounded sample of labelled rows and keeps the terms whose presence goes
with the label, alone or beside another term: an exclusive-or of two terms keeps both, though neither says
anything alone.  It fits a logistic factorization machine: a weight and a short vector for each term, so that
a pair of terms can say more than the two do apart.  Scoring is one pass over whole texts.

Defined results: a null, empty or wordless text gets the score of no terms; labels of null or of an
unknown document are not used; several labels of one document count as toxic if any is; with labels of
one class only, or none, every score is their smoothed share; equal rows get equal scores; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, released
from .textkit import ALNUM, U, buffers, slices, words

#: Labelled documents to train on, at most: the only bound, from which that of the terms follows; size of the term vectors.
TRAIN_ROWS, FACTORS = 8_000, 8
#: Lengths in bytes of the word beginnings that are terms.
PREFIXES = (4, 5, 6)
#: Evidence that a term goes with the label (standard errors): alone, with so many documents that have it, and beside
#: another, among so many that have both; a pair is looked at if each of its terms is in such a share of the sample.
LEAST_DOCS, LEAST_Z, LEAST_BOTH, LEAST_PAIR_Z, LEAST_SHARE = 3, 5.0, 20, 7.0, 0.02
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 256, 0.1, 2e-5, 5
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
PASS_BYTES = 1 << 18


def document_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 32-bit term) of every occurrence."""
    w = words(data, offsets, lower=True, inside=ALNUM)
    doc = np.searchsorted(w.first, np.arange(len(w.starts)), side="right") - 1
    docs, terms = [doc], [w.hashes() >> U(32)]
    for n in PREFIXES:
        at, h = w.prefixes(n)
        docs.append(doc[at])
        terms.append((h >> U(32)) ^ U(n * 0x9E3779B1 & 0xFFFFFFFF))
    return np.concatenate(docs), np.concatenate(terms).astype(np.uint32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of v_i . v_j), over the terms present."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the model, -1 for others: a table by low bits first, the whole hash after."""
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << 20, bool)
            self._table[self.terms & 0xFFFFF] = True
        at = np.full(len(terms), -1)
        maybe = np.flatnonzero(self._table[terms & 0xFFFFF])
        if len(maybe) and len(self.terms):
            i = np.minimum(np.searchsorted(self.terms, terms[maybe]), len(self.terms) - 1)
            ok = self.terms[i] == terms[maybe]
            at[maybe[ok]] = i[ok]
        return at

    def raw(self, doc: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of vectors, for distinct (document, place) pairs."""
        v = self.vector[place]
        sums = np.stack([np.bincount(doc, weights=v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(doc, weights=np.einsum("pf,pf->p", v, v), minlength=n)
        linear = np.bincount(doc, weights=self.weight[place], minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, terms = document_terms(data, offsets)
        place = self.find(terms)
        keep = place >= 0
        pairs = np.unique(doc[keep] * len(self.terms) + place[keep]) if keep.any() else np.zeros(0, np.int64)
        z, _ = self.raw(pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms)), n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(bad: np.ndarray, all_bad: np.ndarray | int, has: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Two-proportion z: toxic shares of the documents that have something and of those that have not."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = all_bad / n
        z = (bad / has - (all_bad - bad) / (n - has)) / np.sqrt(share * (1 - share) * (1 / has + 1 / (n - has)))
    return np.nan_to_num(z, posinf=0.0, neginf=0.0)


def in_pairs(sets: list[np.ndarray], toxic: np.ndarray, frequent: np.ndarray, block: int = 512) -> np.ndarray:
    """For each of the ``frequent`` terms, whether it stands in a pair that says more than its other term does:
    among the documents that have one term, the other goes with the label.  All pairs are counted, as products
    of blocks of the matrix of documents and terms."""
    x = np.zeros((len(sets), len(frequent)), bool)
    for i, s in enumerate(sets):
        x[i, np.searchsorted(frequent, s[np.isin(s, frequent)])] = True
    found = np.zeros(len(frequent), bool)
    has, bad = x.sum(axis=0).astype(float), x[toxic].sum(axis=0).astype(float)
    # a term that matters by itself is kept for that; it makes no pair of every term beside it
    alone = np.abs(evidence(bad, float(toxic.sum()), has, len(toxic))) >= LEAST_Z

    def beside(given: slice, other: slice, both: np.ndarray, both_bad: np.ndarray) -> None:
        n, k = has[given, None], bad[given, None]
        strong = (np.abs(evidence(both_bad, k, both, n)) >= LEAST_PAIR_Z) & (both >= LEAST_BOTH) & (n - both >= LEAST_BOTH) & ~alone[None, other]
        found[given] |= strong.any(axis=1)
        found[other] |= strong.any(axis=0)

    parts = [slice(a, a + block) for a in range(0, len(frequent), block)]
    for i, a in enumerate(parts):
        left = x[:, a].astype(np.float32)
        for b in parts[i:]:
            right = x[:, b].astype(np.float32)
            both, both_bad = left.T @ right, left[toxic].T @ right[toxic]
            beside(a, b, both.astype(float), both_bad.astype(float))
            beside(b, a, both.T.astype(float), both_bad.T.astype(float))
    return found


def fit(sets: list[np.ndarray], toxic: np.ndarray, seed: int = SEED) -> Machine:
    """Fit on distinct terms of each document and its label."""
    n, pos = len(sets), int(toxic.sum())
    base = (pos + 1) / (n + 2)
    none = Machine(np.zeros(0, np.uint32), float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, FACTORS)))
    if pos == 0 or pos == n:
        return none
    terms, has = np.unique(np.concatenate(sets), return_counts=True)
    of_toxic, count = np.unique(np.concatenate([x for x, t in zip(sets, toxic) if t]), return_counts=True)
    bad = np.zeros(len(terms))
    bad[np.searchsorted(terms, of_toxic)] = count
    keep = (np.abs(evidence(bad, pos, has, n)) >= LEAST_Z) & (has >= LEAST_DOCS)
    frequent = has >= max(LEAST_BOTH, LEAST_SHARE * n)
    keep[frequent] |= in_pairs(sets, toxic, terms[frequent])
    if not keep.any():
        return none
    m = none
    m.terms = terms[keep]
    rng = np.random.default_rng(seed)
    m.weight, m.vector = np.zeros(len(m.terms)), rng.normal(0, 0.1, (len(m.terms), FACTORS))
    places = [np.searchsorted(m.terms, s[np.isin(s, m.terms)]) for s in sets]
    gw, gv, gb = np.full(len(m.terms), 1e-6), np.full(m.vector.shape, 1e-6), 1e-6
    # both classes pull alike, so that the score is not drawn down by the rarer one's share
    gain = np.where(toxic, n / (2 * pos), n / (2 * (n - pos)))
    for _ in range(EPOCHS):
        shuffled = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = shuffled[at : at + BATCH]
            doc = np.repeat(np.arange(len(rows)), [len(places[i]) for i in rows])
            place = np.concatenate([places[i] for i in rows])
            zed, s = m.raw(doc, place, len(rows))
            g = (1 / (1 + np.exp(-np.clip(zed, -30, 30))) - toxic[rows]) * gain[rows] / len(rows)
            per = lambda x: np.bincount(place, weights=x, minlength=len(m.terms))
            own = g[doc]
            used = per(np.ones(len(place))) > 0
            dw = np.where(used, per(own) + DECAY * m.weight, 0.0)
            # each term's vector is drawn by the sum of the others'
            dv = np.stack([per(own * s[doc, f]) for f in range(FACTORS)], axis=1) - per(own)[:, None] * m.vector
            dv = np.where(used[:, None], dv + DECAY * m.vector, 0.0)
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            m.weight -= RATE * 4 * dw / np.sqrt(gw)
            m.vector -= RATE * dv / np.sqrt(gv)
            m.bias -= RATE * 4 * g.sum() / np.sqrt(gb)
    return m


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of their id."""
    ids = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_toxic"))
    ids = ids.orderBy(F.xxhash64(F.col("_id"), F.lit(SEED)), "_id").limit(rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for a, e in slices(offsets, PASS_BYTES):
                doc, t = document_terms(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                pairs = np.unique((doc.astype(U) << U(32)) | t.astype(U))
                cuts = np.searchsorted(pairs >> U(32), np.arange(e - a + 1, dtype=U))
                low = pairs.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array([low[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()), b.column(2).slice(a, e - a)], names=["id", "terms", "toxic"])

    # the id list is bounded by ``rows``, whatever the corpus
    chosen = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id").select(F.col("_id").cast("string"), "_text", F.col("_toxic").cast("int"))
    found = sorted(chosen.mapInArrow(lambda batches: released(terms(batches)), "id string, terms binary, toxic int").collect())
    machine = fit([np.frombuffer(r.terms, np.uint32) for r in found], np.array([r.toxic == 1 for r in found], bool))
    del found
    release()
    return machine


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # its size is bounded by the terms of TRAIN_ROWS documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            s = [model.value.score(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]) for a, e in slices(offsets, PASS_BYTES)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["key", "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text))
    return rows.mapInArrow(lambda batches: released(run(batches)), f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def reject(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the machine calls toxic; all columns and rows else stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(place))
            s = [model.value.score(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]) for a, e in slices(offsets, PASS_BYTES)]
            if s:
                yield b.filter(pa.array(np.concatenate(s) < THRESHOLD))

    return docs.mapInArrow(lambda batches: released(run(batches)), docs.schema)
