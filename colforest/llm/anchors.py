"""Operator 1: substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of B words; a block is an anchor.  All
rolling windows of B words probe the anchors.  With B = (L + 1) / 2, any repeated run of L words holds a
whole block of one of its occurrences, so every such run is hit at an anchor that occurs twice.  Around
the hits, the windows of L words that hold an anchor are compared; adjoining repeated ones make up the
maximal exact repeats, and their words are removed.

How it runs: documents are dealt once, by a hash of their row, into chunks of a few MB of text.  A chunk
sends to each hash bucket its distinct probe hashes, packed in one array, and so one value however often
a passage occurs in it.  A bucket answers with one bit for each.  No pair of occurrences is ever formed.
The number of chunks and of buckets follows the size of the corpus, so neither grows in size; a chunk has at
most one message for each bucket and no more messages than distinct probes.  A probe's 32 bits beside its
bucket only choose windows to compare; windows are equal if two independent 64-bit hashes of them are.

Defined results: a null or empty text has no words, n_removed 0 and the digest of the empty text; texts
shorter than the window stay whole; equal rows are separate documents that repeat each other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import U, buffers, second_names, slices, windows, words

WINDOW = 35
#: Bytes of text in a chunk and in one numpy pass, and probes in a bucket, on average.
CHUNK_BYTES, PASS_BYTES, BUCKET_PROBES = 3 << 20, 1 << 20, 1_500_000
CHUNKS_PER_TASK = 2
_MAIL = "chunk int, bucket int, body binary"


def _word_hashes(table: pa.Table, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) of runs of rows."""
    data, offsets = buffers(table.column(text))
    for a, b in slices(offsets, PASS_BYTES):
        part = offsets[a : b + 1] - offsets[a]
        w = words(data[offsets[a] : offsets[b]], part)
        yield a, b, w.hashes(), w.first


class _Chunk:
    """A chunk's probes, and the windows that its hits leave; the same for the same rows in any order of stages."""

    def __init__(self, table: pa.Table, text: str, size: int, buckets: int):
        block = (size + 1) // 2
        self.size, self.block, self.buckets, self.reach = size, block, buckets, size - block
        self.runs = list(_word_hashes(table, text))
        probes, marks = [np.zeros(0, U)], [np.zeros(0, bool)]
        self.at, self.extent = [], []
        for _, _, h, first in self.runs:
            at, p = windows(h, first, block)
            doc = np.searchsorted(first, at, side="right") - 1
            probes.append(p)
            marks.append((at - first[doc]) % block == 0)
            self.at.append(at)
        self.cuts = np.cumsum([0, *map(len, probes[1:])])
        self.probe = np.concatenate(probes)
        self.mark = np.concatenate(marks)

    def _by_bucket(self, hashes: np.ndarray, rest: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First places of distinct values (``rest``, and ``second`` if there is one) by the bucket of the hash, where
        each occurrence falls, how often, and cuts by bucket."""
        bucket = hashes % U(self.buckets)
        order = np.argsort((bucket << U(32)) | rest, kind="stable") if second is None else np.lexsort((second, rest, bucket))
        bucket, rest = bucket[order], rest[order]
        new = np.ones(len(rest), bool)
        new[1:] = (rest[1:] != rest[:-1]) | (bucket[1:] != bucket[:-1])
        if second is not None:
            second = second[order]
            new[1:] |= second[1:] != second[:-1]
        rank = np.cumsum(new) - 1
        inverse = np.empty(len(rest), np.int64)
        inverse[order] = rank
        cuts = np.searchsorted(bucket[new], np.arange(self.buckets + 1, dtype=U))
        return order[new], inverse, np.bincount(rank, minlength=0), cuts

    def probe_mail(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket: distinct probes, which of them occur twice here, and which are anchors."""
        distinct, inverse, count, cuts = self._by_bucket(self.probe, self.probe >> U(32))
        anchor = np.zeros(len(distinct), bool)
        anchor[inverse[self.mark]] = True
        low = (self.probe[distinct] >> U(32)).astype(np.uint32)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[b], cuts[b + 1])
            yield b, low[s].tobytes() + np.packbits(count[s] > 1).tobytes() + np.packbits(anchor[s]).tobytes()

    def _answers(self, n: int, cuts: np.ndarray, mail: dict[int, bytes]) -> np.ndarray:
        hit = np.zeros(n, bool)
        for b, body in mail.items():
            a, e = cuts[b], cuts[b + 1]
            hit[a:e] = np.unpackbits(np.frombuffer(body, np.uint8), count=e - a).astype(bool)
        return hit

    def hits(self, mail: dict[int, bytes]) -> np.ndarray:
        """By probe: whether it is an anchor that occurs elsewhere."""
        distinct, inverse, _, cuts = self._by_bucket(self.probe, self.probe >> U(32))
        return self._answers(len(distinct), cuts, mail)[inverse] if len(distinct) else np.zeros(0, bool)

    def candidates(self, mail: dict[int, bytes]) -> None:
        """Windows of the full size that hold an anchor that occurs elsewhere."""
        hit = self.hits(mail)
        self.starts, full, second = [], [np.zeros(0, U)], [np.zeros(0, U)]
        for i, (_, _, h, first) in enumerate(self.runs):
            at = self.at[i][hit[self.cuts[i] : self.cuts[i + 1]]]
            cover = np.zeros(len(h) + 1, np.int32)
            np.add.at(cover, np.maximum(at - self.reach, 0), 1)
            np.add.at(cover, at + 1, -1)
            near = np.cumsum(cover[:-1]) > 0
            start, w = windows(h, first, self.size)
            keep = near[start]
            self.starts.append(start[keep])
            full.append(w[keep])
            second.append(second_names(h, start[keep], self.size))
        self.window, self.second = np.concatenate(full), np.concatenate(second)

    def window_mail(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket: the 128-bit names of distinct windows, and which of them occur twice here."""
        distinct, _, count, cuts = self._by_bucket(self.window, self.window, self.second)
        names = np.stack([self.window[distinct], self.second[distinct]], axis=1)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[b], cuts[b + 1])
            yield b, names[s].tobytes() + np.packbits(count[s] > 1).tobytes()

    def repeated(self, mail: dict[int, bytes]) -> list[np.ndarray]:
        """For each run of rows: the first words of windows that occur again."""
        distinct, inverse, _, cuts = self._by_bucket(self.window, self.window, self.second)
        hit = self._answers(len(distinct), cuts, mail)[inverse] if len(distinct) else np.zeros(0, bool)
        out, done = [], 0
        for starts in self.starts:
            out.append(starts[hit[done : done + len(starts)]])
            done += len(starts)
        return out

    def removed(self, mail: dict[int, bytes]) -> list[tuple[int, np.ndarray]]:
        """For each run of rows: its first row and, by word, whether a repeated window covers it."""
        out = []
        for (a, _, h, _), start in zip(self.runs, self.repeated(mail)):
            cover = np.zeros(len(h) + 1, np.int32)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + self.size, -1)
            out.append((a, np.cumsum(cover[:-1]) > 0))
        return out


def _mail_table(chunk: int, mail: Iterator[tuple[int, bytes]]) -> pa.Table:
    rows = list(mail)
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "body": pa.array([x for _, x in rows], pa.binary())})


def _chunk_id(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def _repeats(width: int, with_anchor: bool):
    """A bucket's answer: bit i tells a chunk that its i-th value, of 4 or 16 bytes, occurs more than once in the corpus
    (and is an anchor)."""
    kind = np.dtype(np.uint32 if width == 4 else np.uint64)
    parts = width // kind.itemsize

    def answer(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        values, twice, anchor, sizes = [], [], [], []
        for body in bodies:
            # n values and one or two bit sets of n bits
            n = 8 * len(body) // (8 * width + 1 + with_anchor) + 1
            while n * width + (1 + with_anchor) * ((n + 7) // 8) > len(body):
                n -= 1
            values.append(np.frombuffer(body, kind, n * parts).reshape(n, parts))
            bits = np.frombuffer(body, np.uint8, offset=n * width)
            half = (n + 7) // 8
            twice.append(np.unpackbits(bits[:half], count=n).astype(bool))
            if with_anchor:
                anchor.append(np.unpackbits(bits[half:], count=n).astype(bool))
            sizes.append(n)
        every = np.concatenate(values)
        order = np.argsort(every[:, 0], kind="stable") if parts == 1 else np.lexsort((every[:, 1], every[:, 0]))
        s = every[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        repeated = np.logical_or.reduceat(np.concatenate(twice)[order], first) | (np.diff(np.append(first, len(s))) > 1)
        if with_anchor:
            repeated &= np.logical_or.reduceat(np.concatenate(anchor)[order], first)
        hit = np.empty(len(s), bool)
        hit[order] = repeated[group]
        cuts = np.cumsum([0, *sizes])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "body": pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return answer


def exchange(docs: DataFrame, key: str, text: str, make: Callable[[pa.Table, int], _Chunk], answer: Callable[[pa.Table], pa.Table], report: Callable[[_Chunk, pa.Table, dict[int, bytes]], pa.Table], fields: list[T.StructField]) -> DataFrame:
    """Chunks ask buckets twice: which of their probes, then which of their windows, occur again; ``report``
    turns a chunk and the last answers into rows."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_chunks = max(1, total // CHUNK_BYTES + 1)
    buckets = max(1, total // 6 // BUCKET_PROBES + 1)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text", F.lit(3)), F.lit(n_chunks)).cast("int")).repartition(max(1, n_chunks // CHUNKS_PER_TASK), "chunk")

    def probes(table: pa.Table) -> pa.Table:
        return _mail_table(_chunk_id(table), make(table, buckets).probe_mail())

    def letters(table: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: x for b, x, k in zip(*(table.column(c).to_pylist() for c in ("bucket", "body", "kind"))) if k == kind}

    def extend(rows: pa.Table, mail: pa.Table) -> pa.Table:
        c = make(rows, buckets)
        c.candidates(letters(mail, 1))
        return _mail_table(_chunk_id(rows), c.window_mail())

    def last(rows: pa.Table, mail: pa.Table) -> pa.Table:
        c = make(rows, buckets)
        c.candidates(letters(mail, 1))
        return report(c, rows, letters(mail, 2))

    by_chunk = dealt.groupBy("chunk")
    hits = by_chunk.applyInArrow(probes, _MAIL).groupBy("bucket").applyInArrow(answer, _MAIL).withColumn("kind", F.lit(1))
    runs = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend, _MAIL)
    repeats = runs.groupBy("bucket").applyInArrow(_repeats(16, False), _MAIL).withColumn("kind", F.lit(2))
    return by_chunk.cogroup(hits.unionByName(repeats).groupBy("chunk")).applyInArrow(last, T.StructType(fields)).withColumnRenamed("key", key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""

    def cut(c: _Chunk, rows: pa.Table, mail: dict[int, bytes]) -> pa.Table:
        texts = rows.column("text")
        n_words, n_removed, digest, kept = [], [], [], []
        for (a, b, _, first), (_, gone) in zip(c.runs, c.removed(mail)):
            for i, t in enumerate(texts.slice(a, b - a).to_pylist()):
                ws = (t or "").encode("utf-8").split()
                g = gone[first[i] : first[i + 1]]
                left = ws if not g.any() else [w for w, x in zip(ws, g.tolist()) if not x]
                body = b" ".join(left)
                n_words.append(len(ws))
                n_removed.append(len(ws) - len(left))
                digest.append(hashlib.sha256(body).hexdigest())
                if keep_text:
                    kept.append(body.decode("utf-8"))
        out = {"key": rows.column("key"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if keep_text:
            out["kept_text"] = pa.array(kept, pa.string())
        return pa.table(out)

    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] * keep_text
    return exchange(docs, key, text, lambda t, buckets: _Chunk(t, "text", size, buckets), _repeats(4, True), cut, fields)
