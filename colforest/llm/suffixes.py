"""Operator 5: repeated passages by a sparse suffix array.

Suffixes are retained at minimisers only: the smallest hash of BLOCK words among SPAN neighbouring ones.
Which positions these are depends on the words alone, so a passage retains the same suffixes wherever it
stands.  A suffix is compared by its leading DEPTH blocks; within a bucket, where all suffixes with equal
first blocks meet, suffixes are sorted and neighbours compared.  With BLOCK * DEPTH + SPAN - 1 = 50, any
passage of 50 words that occurs twice has a retained suffix that agrees with a neighbour to full depth.
From there matches are extended left and right, window by window, to the maximal repeats.

How it runs: as operator 1, chunks of documents ask hash buckets and get one bit for each distinct suffix
or window; no pair of suffixes is ever formed, and a passage counts once in a chunk.

Result: one row for each maximal repeat, that is for each longest run of words in a document whose every
window of 50 words occurs elsewhere, the same document included: key, start_word and end_word (from 0, end
exclusive), n_words, span_sha256 of its words joined by single spaces.

Defined results: documents without a repeat, with null or empty texts or fewer words have no row; equal
rows are separate documents that repeat each other; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .anchors import _Chunk, _word_hashes, exchange
from .textkit import U, windows

LEAST = 50
BLOCK, DEPTH, SPAN = 7, 5, 16
WIDTH = 4 * DEPTH


class _Suffixes(_Chunk):
    """A chunk whose probes are retained suffixes."""

    def __init__(self, table: pa.Table, text: str, size: int, buckets: int):
        if size < BLOCK * DEPTH + SPAN - 1:
            raise ValueError(f"a repeat of {size} words may hold no suffix of full depth")
        self.size, self.buckets, self.reach = size, buckets, size - BLOCK * DEPTH
        self.runs = list(_word_hashes(table, text))
        self.at, records, bucket = [], [np.zeros((0, DEPTH), np.uint32)], [np.zeros(0, U)]
        for _, _, h, first in self.runs:
            at, v = windows(h, first, BLOCK)
            keep = self.retained(at, v)
            # a suffix needs its full depth within the document
            ends = first[np.searchsorted(first, at[keep], side="right")]
            keep = keep[at[keep] + BLOCK * DEPTH <= ends]
            self.at.append(at[keep])
            records.append((v[keep[:, None] + BLOCK * np.arange(DEPTH)[None, :]] >> U(32)).astype(np.uint32))
            bucket.append(v[keep] % U(buckets))
        self.cuts = np.cumsum([0, *map(len, self.at)])
        self.record, self.bucket = np.concatenate(records), np.concatenate(bucket)
        order = np.lexsort((*self.record.T[::-1], self.bucket))
        r, b = self.record[order], self.bucket[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]).any(axis=1) | (b[1:] != b[:-1])
        self.inverse = np.empty(len(r), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.distinct, self.count = r[new], np.bincount(self.inverse) if len(r) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(b[new], np.arange(buckets + 1, dtype=U))

    @staticmethod
    def retained(at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places (in ``at``) of minimisers: the leftmost smallest of each SPAN blocks in a row."""
        if len(v) < SPAN:
            return np.zeros(0, np.int64)
        whole = np.flatnonzero(at[SPAN - 1 :] - at[: len(at) - SPAN + 1] == SPAN - 1)  # within one document
        best, place = v[whole].copy(), whole.copy()
        for k in range(1, SPAN):
            less = v[whole + k] < best
            best = np.where(less, v[whole + k], best)
            place = np.where(less, whole + k, place)
        return np.unique(place)

    def probe_mail(self) -> Iterator[tuple[int, bytes]]:
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            s = slice(self.bounds[b], self.bounds[b + 1])
            yield b, self.distinct[s].tobytes() + np.packbits(self.count[s] > 1).tobytes()

    def hits(self, mail: dict[int, bytes]) -> np.ndarray:
        return self._answers(len(self.distinct), self.bounds, mail)[self.inverse] if len(self.distinct) else np.zeros(0, bool)


def _neighbours(table: pa.Table) -> pa.Table:
    """A bucket's suffixes sorted and compared with their neighbours; bit i tells a chunk that its i-th agrees to full depth."""
    records, twice, sizes = [], [], []
    for body in table.column("body").to_pylist():
        n = 8 * len(body) // (8 * WIDTH + 1) + 1
        while n * WIDTH + (n + 7) // 8 > len(body):
            n -= 1
        records.append(np.frombuffer(body, np.uint32, n * DEPTH).reshape(n, DEPTH))
        twice.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=n * WIDTH), count=n).astype(bool))
        sizes.append(n)
    every = np.concatenate(records)
    order = np.lexsort(every.T[::-1])
    s = every[order]
    # blocks in common with the suffix before
    agree = np.cumprod(s[1:] == s[:-1], axis=1).sum(axis=1) if len(s) > 1 else np.zeros(0, np.int64)
    deep = np.concatenate(twice)[order]
    deep[1:] |= agree == DEPTH
    deep[:-1] |= agree == DEPTH
    hit = np.empty(len(s), bool)
    hit[order] = deep
    cuts = np.cumsum([0, *sizes])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "body": pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = LEAST) -> DataFrame:
    """The maximal repeats of ``size`` words or more."""

    def spans(c: _Chunk, rows: pa.Table, mail: dict[int, bytes]) -> pa.Table:
        texts, row, begin, end, digest = rows.column("text"), [], [], [], []
        for (a, _, _, first), start in zip(c.runs, c.repeated(mail)):
            if not len(start):
                continue
            doc = np.searchsorted(first, start, side="right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(start) != 1) | (doc[1:] != doc[:-1])
            opens, closes = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(start)) - 1
            seen, ws = -1, []
            for o, e in zip(opens.tolist(), closes.tolist()):
                d = int(doc[o])
                if d != seen:
                    seen, ws = d, (texts[a + d].as_py() or "").encode("utf-8").split()
                x, y = int(start[o] - first[d]), int(start[e] - first[d]) + c.size
                row.append(a + d)
                begin.append(x)
                end.append(y)
                digest.append(hashlib.sha256(b" ".join(ws[x:y])).hexdigest())
        x, y = np.array(begin, np.int64), np.array(end, np.int64)
        return pa.table({"key": rows.column("key").take(pa.array(row, pa.int64())), "start_word": pa.array(x), "end_word": pa.array(y), "n_words": pa.array(y - x), "span_sha256": pa.array(digest, pa.string())})

    fields = [T.StructField("key", docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("start_word", "end_word", "n_words")], T.StructField("span_sha256", T.StringType())]
    return exchange(docs, key, text, lambda t, buckets: _Suffixes(t, "text", size, buckets), _neighbours, spans, fields)
