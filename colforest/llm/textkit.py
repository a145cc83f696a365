"""Vectorised word and window hashing straight on Arrow text buffers.

A batch of texts is one run of UTF-8 bytes plus offsets.  Words, word hashes and hashes of
word windows come from a handful of numpy passes over those bytes, so no Python object is made
per word.  Hashes are 64-bit polynomials over random byte values, finished by an avalanche step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: The word breaks of every contract: space and the controls 09 to 0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]
_STEP_BYTE = 0x9E3779B97F4A7C15 | 1
_STEP_WORD = 0xD1342543DE82EF95 | 1
_STEP_SECOND = 0x2545F4914F6CDD1D | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse modulo 2**64 for i below at least n."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        with np.errstate(over="ignore"):
            made = []
            for base in (step, pow(step, -1, 2**64)):
                p = np.full(size, U(base))
                p[0] = U(1)
                made.append(np.multiply.accumulate(p))
        have = _powers[step] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: each output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # no chunk at all
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte bounds, the first word of each document (n_docs + 1), running sums of
    byte values for hashing any stretch of bytes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self) -> np.ndarray:
        return mix((self.sums[self.ends] - self.sums[self.starts]) * self.inverse[self.starts])

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than n bytes and hashes of their first n bytes."""
        at = np.flatnonzero(self.ends - self.starts > n)
        s = self.starts[at]
        return at, mix((self.sums[s + n] - self.sums[s]) * self.inverse[s])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are no white space (or that ``inside`` marks), never across documents."""
    n = len(data)
    part = (inside if inside is not None else ~SPACE)[data]
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    closes = part.copy()
    closes[:-1] &= ~part[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = part[edges]
    closes[edges - 1] = part[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    power, inverse = powers(_STEP_BYTE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((BYTE_VALUE_LOWER if lower else BYTE_VALUE)[data] * power[:n], out=sums[1:])
    return Words(starts, ends, first, sums, inverse)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words that lie in one document, and the windows' hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = powers(_STEP_WORD, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    fits = np.zeros(n + 1, dtype=np.int32)
    lengths = np.diff(first)
    long = lengths >= size
    np.add.at(fits, first[:-1][long], 1)
    np.add.at(fits, first[1:][long] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    return at, mix((sums[at + size] - sums[at]) * inverse[at] + U(size))


def second_names(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows that begin ``at``, by another polynomial than :func:`windows`: the two together name a
    window by 128 bits."""
    power, inverse = powers(_STEP_SECOND, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)) * power[: len(hashes)], out=sums[1:])
    return mix((sums[at + size] - sums[at]) * inverse[at])


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes, one document at least."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out
