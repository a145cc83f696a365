"""Operator 9: BPE encoding and decoding with a published merge table, by a pair occurrence index.

All words that a batch needs for the first time lie in one linked symbol list.  An index maps each
mergeable pair, by its rank, to all its positions.  Ranks are taken in ascending order from a heap; a
rank merges its positions from left to right, and every merge puts the two pairs it makes on their own
lists.  Words met of late come from bounded tables, so a word is merged once, not once per occurrence.

Defined results: a null or empty text has no ids and decodes to ''; special-token strings in a text
become their ids, as the library does by default; repeated rows give repeated results; other columns,
whatever their names, are passed through by :func:`encode` and :func:`decode`.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import released

#: Pre-tokenizer of the vocabulary, and its white-space class (fixed values, as in the vocabulary file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for ASCII in lower case, where the classes are short enough to be written out.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Entries in one generation of a worker's tables. It bounds memory and changes no result.
CACHE_WORDS = 250_000
SLICE_DOCS = 512


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower case character by character, without the context rule for a final sigma."""
    return text.lower() if text.isascii() else "".join(c.lower() for c in text)


def runs(text: str) -> list[str]:
    """Runs of a text between ASCII white space; str.split is quicker, but cuts at U+001C to U+001F too."""
    if text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
        return text.split(None)
    return re.split(r"[ \t\n\r\x0b\x0c]+", text)


class Recent:
    """A table of the entries used of late, in two generations: when the newer is full, the older goes."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that are in neither generation; the others are in the newer one from then on."""
        need = keys - self.new.keys()
        if len(self.new) + len(need) > CACHE_WORDS:
            self.old, self.new = self.new, {}
            need = keys
        held = need & self.old.keys()
        self.new.update(zip(held, map(self.old.__getitem__, held)))
        return need - held


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.base = np.array([[vocab[c] for c in alphabet], [vocab[c + suffix] for c in alphabet]])
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.rank = {vocab[a] * size + vocab[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        self.rule = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.decimal = [str(i) for i in range(size)]
        top = int(self.base.max()) + 1
        self.base_rank = np.full((top, top), -1, dtype=np.int32)
        for k, r in self.rank.items():
            if k // size < top and k % size < top:
                self.base_rank[k // size, k % size] = r
        self.words, self.known = Recent(), Recent()

    def pieces(self, word: str) -> list[str | int]:
        """Pre-tokens (as byte-level text to come) and special ids of a run without ASCII white space."""
        parts = self.split_special.split(word) if self.split_special and "<|" in word else [word]
        out: list[str | int] = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                out += ASCII_PIECES.findall(p.lower()) if p.isascii() else PIECES.findall(lower_each(unicodedata.normalize("NFC", p)))
        return out

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token as int32 bytes, all merged together through the pair occurrence index."""
        raw = [p.encode("utf-8") for p in pieces]
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        n, size, rank, rule = len(flat), self.size, self.rank, self.rule
        first = self.base[0][flat]
        first[ends - 1] = self.base[1][flat[ends - 1]]
        following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        preceding[np.concatenate([[0], ends[:-1]])] = -1
        # the index: rank -> positions of its pair, from the left
        pair = self.base_rank[first[:-1], first[1:]]
        pair[ends[:-1] - 1] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        ranks, cuts = np.unique(pair[at], return_index=True)
        places = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        active = [*places]
        symbol, after, before = first.tolist(), following.tolist(), preceding.tolist()
        pop, push, find = heapq.heappop, heapq.heappush, rank.get
        while active:
            r = pop(active)
            left, right, new = rule[r]
            held = places.pop(r)
            held.sort()
            base = new * size
            for i in held:
                if symbol[i] != left or (j := after[i]) < 0 or symbol[j] != right:
                    continue  # another merge has taken one of the two
                symbol[i] = new
                symbol[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (m := find(base + symbol[k])) is not None:
                        if m in places:
                            places[m].append(i)
                        else:
                            places[m] = [i]
                            push(active, m)
                if (h := before[i]) >= 0 and (m := find(symbol[h] * size + new)) is not None:
                    if m in places:
                        places[m].append(h)
                    else:
                        places[m] = [h]
                        push(active, m)
        done = np.array(symbol, dtype=np.int32)
        alive = done >= 0
        last = np.cumsum(alive)[ends - 1] * 4
        ids = done[alive].tobytes()
        return [ids[a:b] for a, b in zip([0, *last.tolist()], last.tolist())]

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words into the table of words."""
        cut = [(w, (w.lower(),) if w.isascii() and w.isalpha() else self.pieces(w)) for w in words]
        new = [*self.known.missing({p for _, ps in cut for p in ps if isinstance(p, str)})]
        known, into = self.known.new, self.words.new
        if new:
            known.update(zip(new, self.merged(new)))
        for w, ps in cut:
            into[w] = known[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else b"".join([known[p] if isinstance(p, str) else np.int32(p).tobytes() for p in ps])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        split = [runs(t or "") for t in texts]
        self.learn(self.words.missing(set().union(*split)))
        get = self.words.new.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype=np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by single spaces: the vocabulary file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` without cycle collection while they last: coding makes no cycles, and scanning its caches
    for some would be half the cost.  The worker's later tasks collect again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from released(batches)
    finally:
        if was:
            gc.enable()


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[str | None]]]:
    column = batch.column(batch.schema.get_field_index(text))
    for at in range(0, batch.num_rows, SLICE_DOCS):
        yield at, column.slice(at, SLICE_DOCS).to_pylist()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text in a new column (an existing one of that name is replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at, texts in _texts(b, text):
                found = c.encode(texts)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int32()))
                rows = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, ids])

    kept = docs.drop(ids)
    return kept.mapInArrow(lambda batches: _uncollected(run(batches)), T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in a new column; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            column = pa.array([c.decode(x or ()) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, out])

    kept = encoded.drop(out)
    return kept.mapInArrow(lambda batches: _uncollected(run(batches)), T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; per row the key, the token count and digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at, texts in _texts(b, text):
                found = [x.tolist() for x in c.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(c.decimal.__getitem__, x)).encode()).hexdigest() for x in found]),
                        pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in found]),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    key_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(key, text).mapInArrow(lambda batches: _uncollected(run(batches)), schema)
