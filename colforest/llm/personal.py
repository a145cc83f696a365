"""Operator 2: personal data by patterns and a character-level BiLSTM-CRF.

Base spans come from four patterns and their checks.  A small bidirectional LSTM over characters, with
CRF transitions between begin/inside tags of the four kinds, adds spans of other spellings.  It is
trained in numpy from labelled spans: seeded templates of each kind in filler text, with numbers and codes
that are none as counter-examples.  A text is read in overlapping windows; each is decoded by Viterbi, and
a weighted choice of non-overlapping spans over the whole document reconciles them.

A span needs a digit, an @ or a bracketed "at", so windows without any cannot add one and are not decoded:
this skips work, never a span.  Added spans must not touch base spans.

Defined results: a null text is the empty text; a text without personal data has counts 0, empty span
lists and the digest of the empty string; positions are code points, ends exclusive; equal rows get equal
results; an empty table gives an empty result; :func:`redact` keeps all columns, others are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, released

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the contract (fixed values); the e-mail pattern is applied around each @.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAY_HOLD = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.IGNORECASE)

#: What stands for the two marks of an address.
AT, DOT = re.compile(r"@|[(\[{] ?at ?[)\]}]", re.IGNORECASE), re.compile(r"\.|[(\[{] ?dot ?[)\]}]", re.IGNORECASE)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    """Whether a run of digits is at most 255; however long it is, no more than three digits are read as a number."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at an @, the run of local characters before it that no earlier match has taken."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1 if start == at else max(done, start)
        at = text.find("@", max(at + 1, done if m else 0))


def base_spans(text: str) -> list[Span]:
    """Spans of the contract's patterns, by start, then kind as listed."""
    out: list[Span] = []
    if not MAY_HOLD.search(text):
        return out
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(at_most_255(p) for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- the network -------------------------------------------------------------------------------------

#: Window and step in characters: a span of up to 63 characters, more than any template has, lies inside a window; hidden and embedding sizes; training steps and batch.
WINDOW, STEP = 128, 64
HIDDEN, EMBED, STEPS, BATCH, RATE, SEED = 24, 12, 200, 32, 0.012, 3
#: Log-odds per span over leaving it untagged that an added span needs.
LEAST_GAIN = 6.0
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_CLASSES = 72


def classes(text: str) -> np.ndarray:
    """Character classes: ASCII letters (case folded), each digit alike, common marks, other letters, the rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out = np.full(len(code), 70)
    low = code < 128
    out[low] = _ASCII[code[low]]
    out[(code >= 192) & (code < 0x2000)] = 71
    return out


_ASCII = np.full(128, 70)
for _c in range(26):
    _ASCII[97 + _c] = _ASCII[65 + _c] = 1 + _c
_ASCII[48:58] = 27
_ASCII[[32, 9, 10, 13]] = 28
for _i, _c in enumerate("@.+-()_%/:;,=\"'[]{}<>#*&!?|~$"):
    _ASCII[ord(_c)] = 29 + _i


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions between tags, and first tags, that make sense: an inside tag follows its own kind."""
    n = len(TAGS)
    go, begin = np.zeros((n, n)), np.zeros(n)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            begin[j] = -1e4
            for i, s in enumerate(TAGS):
                if s == "O" or s[2:] != t[2:]:
                    go[i, j] = -1e4
    return go, begin


class Tagger:
    """Parameters, forward pass, gradients and Viterbi decoding."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        g = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
        self.p = {"embed": g(_CLASSES, EMBED), "out": g(len(TAGS), 2 * HIDDEN), "out_b": np.zeros(len(TAGS), np.float32), "go": np.zeros((len(TAGS), len(TAGS)), np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": g(4 * HIDDEN, EMBED), f"h{side}": g(4 * HIDDEN, HIDDEN), f"b{side}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1
        self.mask, self.begin = _allowed()

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)

    def _lstm(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """x: (time, batch, embed) in reading order of the side -> hidden states."""
        time, batch, _ = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        pre = x @ self.p[f"x{side}"].T + self.p[f"b{side}"]
        out = np.empty((time, batch, HIDDEN), np.float32)
        for t in range(time):
            z = pre[t] + h @ self.p[f"h{side}"].T
            gates = self._sig(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, batch, tags) from (batch, time) classes."""
        x = self.p["embed"][ids.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        hid = np.concatenate([self._lstm(x, "f", kf), self._lstm(x[::-1], "b", kb)[::-1]], axis=2)
        if keep is not None:
            keep |= {"x": x, "f": kf, "b": kb, "hid": hid}
        return hid @ self.p["out"].T + self.p["out_b"]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative CRF log-likelihood of a batch and its gradient."""
        keep: dict = {}
        e = self.emissions(ids, keep).astype(np.float64)
        time, batch, n = e.shape
        go = self.p["go"] + self.mask
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.begin
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, time):
            alpha[t] = lse(alpha[t - 1][:, :, None] + go[None], 1) + e[t]
        for t in range(time - 2, -1, -1):
            beta[t] = lse(go[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        y = tags.T
        rows = np.arange(batch)
        gold = np.take_along_axis(e, y[:, :, None], axis=2).sum(axis=(0, 2)) + go[y[:-1], y[1:]].sum(axis=0)
        d = np.exp(alpha + beta - z[None, :, None])
        dgo = np.exp(alpha[:-1, :, :, None] + go + (e + beta)[1:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        np.add.at(dgo, (y[:-1], y[1:]), -1)
        np.subtract.at(d, (np.arange(time)[:, None], rows[None, :], y), 1)
        d = (d / batch).astype(np.float32)
        hid, x = keep["hid"], keep["x"]
        grad = {"out": np.tensordot(d, hid, ((0, 1), (0, 1))), "out_b": d.sum(axis=(0, 1)), "go": (dgo / batch).astype(np.float32)}
        dhid = d @ self.p["out"]
        dx = np.zeros_like(x)
        for side, part, flip in (("f", slice(0, HIDDEN), 1), ("b", slice(HIDDEN, None), -1)):
            dh_out, xs = dhid[:, :, part][::flip], x[::flip]
            wh = self.p[f"h{side}"]
            dz_all = np.empty((time, batch, 4 * HIDDEN), np.float32)
            h_all = np.stack([k[6] for k in keep[side]])
            dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t in range(time - 1, -1, -1):
                i, f, o, g, before, tc, _ = keep[side][t]
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                dh, dc = dz @ wh, dc * f
            grad[f"x{side}"] = np.tensordot(dz_all, xs, ((0, 1), (0, 1)))
            grad[f"h{side}"] = np.tensordot(dz_all, h_all, ((0, 1), (0, 1)))
            grad[f"b{side}"] = dz_all.sum(axis=(0, 1))
            dx += (dz_all @ self.p[f"x{side}"])[::flip]
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], ids.T, dx)
        return float((z - gold).mean()), grad

    def decode(self, ids: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
        """Best spans of each window with their gain: how much more they score than the same stretch untagged."""
        e = self.emissions(ids).astype(np.float64)
        time, batch, _ = e.shape
        go = self.p["go"] + self.mask
        best = e[0] + self.begin
        back = np.empty((time, batch, len(TAGS)), np.int64)
        for t in range(1, time):
            step = best[:, :, None] + go[None]
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + e[t]
        path = np.empty((time, batch), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            path[t - 1] = back[t][np.arange(batch), path[t]]
        out: list[list[tuple[int, int, str, float]]] = []
        for w in range(batch):
            spans, t = [], 0
            while t < time:
                if path[t, w] == 0:
                    t += 1
                    continue
                a, kind = t, TAGS[path[t, w]][2:]
                t += 1
                while t < time and TAGS[path[t, w]] == f"I-{kind}":
                    t += 1
                y = path[a:t, w]
                on = e[np.arange(a, t), w, y].sum() + go[y[:-1], y[1:]].sum() + (go[0, y[0]] if a else 0) + (go[y[-1], 0] if t < time else 0)
                off = e[a:t, w, 0].sum() + go[0, 0] * (t - a - 1 + (a > 0) + (t < time))
                spans.append((a, t, kind, float(on - off)))
            out.append(spans)
        return out


# ---- labelled spans ----------------------------------------------------------------------------------


_LETTERS = np.array(list("etaoinshrdlucmfwypvbgkjqxzéèüöáñ"))
_SHARES = np.cumsum(np.linspace(2, 0.2, len(_LETTERS)) / np.linspace(2, 0.2, len(_LETTERS)).sum())


def _filler(rng: np.random.Generator, n: int) -> str:
    """Some words of letters by their shares."""
    sizes = rng.integers(2, 9, n)
    text = "".join(_LETTERS[np.minimum(np.searchsorted(_SHARES, rng.random(int(sizes.sum()))), len(_LETTERS) - 1)].tolist())
    ends = np.cumsum(sizes).tolist()
    return " ".join(text[a:b] for a, b in zip([0, *ends], ends))


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    body = str(rng.integers(3, 7)) + _digits(rng, int(rng.choice([14, 14, 14, 12])))
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + check


def sample_span(rng: np.random.Generator, kind: str) -> str:
    """One spelling of a kind."""
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == "email":
        name = pick(f"{word()}.{_digits(rng, 2)}", f"{word()}.{word()}", word(), f"{word()}_{word()}")
        host = pick(f"mail{rng.integers(1, 9)}.example", f"{word()}", f"{word()}-{word()}")
        return f"{name}{pick('@', ' @ ', '@ ', ' (at) ', '(at)', ' [at] ', '[at]', ' {at} ')}{host}{pick('.', '.', ' . ', ' (dot) ', '[dot]', ' [dot] ')}{pick('com', 'org', 'net', 'fr', 'de')}"
    if kind == "ip":
        part = [str(rng.integers(0, 256)) for _ in range(4)]
        return pick(".", ".", " . ", "[.]").join(part)
    if kind == "card":
        c = _card(rng)
        return pick(c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), "-".join(c[i : i + 4] for i in range(0, len(c), 4)), ".".join(c[i : i + 4] for i in range(0, len(c), 4)))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return pick(f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"00{rng.integers(1, 99)} {a} {b} {c}")


def sample_none(rng: np.random.Generator) -> str:
    """Numbers and codes that are not personal data."""
    pick = lambda *x: x[rng.integers(len(x))]
    hexa = "".join(rng.choice(list("0123456789abcdef"), int(rng.choice([16, 32, 40]))))
    key = "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
    return pick(f"Version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"password={hexa[:16]}", f'token = "{hexa}"', key, str(rng.integers(1900, 2030)), f"{rng.integers(1, 999)}", f"{rng.integers(0, 9)}.{_digits(rng, 3)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}", f"{rng.integers(1, 99)}%", f"BY-NC {rng.integers(1, 9)}.0", _digits(rng, int(rng.integers(5, 25))), f"@{_filler(rng, 1)}", f"{_filler(rng, 1)}{_digits(rng, 3)}", f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_filler(rng, 1)} @ {_filler(rng, 1)}", f"({_filler(rng, 1)}) {_filler(rng, 1)}.", f"[{_filler(rng, 1)}]")


def sample_window(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window of filler with spans and counter-examples, and its tags."""
    text, tags = "", []
    while len(text) < 2 * WINDOW:
        f = _filler(rng, int(rng.integers(1, 6))) + " "
        text, tags = text + f, tags + [0] * len(f)
        if rng.random() < 0.5:
            s = sample_none(rng)
            text, tags = text + s + " ", tags + [0] * (len(s) + 1)
        else:
            k = int(rng.integers(4))
            s = sample_span(rng, KINDS[k])
            end = str(rng.choice([" ", " ", ", ", ". "]))
            text, tags = text + s + end, tags + [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1) + [0] * len(end)
    at = int(rng.integers(0, len(text) - WINDOW))
    y = np.array(tags[at : at + WINDOW])
    for i in range(WINDOW):  # a window that opens inside a span starts it anew
        if y[i] and y[i] % 2 == 0:
            if i == 0:
                y[i] -= 1
        else:
            break
    return classes(text)[at : at + WINDOW], y


@functools.lru_cache(maxsize=2)
def train(steps: int = STEPS, seed: int = SEED) -> Tagger:
    """Adam on freshly drawn labelled windows; the same seed gives the same tagger."""
    rng, tagger = np.random.default_rng(seed), Tagger(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.p.items()}
    for s in range(1, steps + 1):
        ids, tags = map(np.stack, zip(*(sample_window(rng) for _ in range(BATCH))))
        _, grad = tagger.loss(ids, tags)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - s / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            tagger.p[k] -= (rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)).astype(np.float32)
    release()
    return tagger


def plausible(kind: str, text: str) -> bool:
    """What any spelling of a kind must have."""
    digits = sum(c.isdigit() and c.isascii() for c in text)
    if kind == "email":
        return bool(AT.search(text) and DOT.search(text)) and len(text) >= 6
    if kind == "ip":
        return len(re.findall(r"[0-9]+", text)) == 4 and all(map(at_most_255, re.findall(r"[0-9]+", text)))
    if kind == "card":
        return 12 <= digits <= 19 and luhn(re.sub("[^0-9]", "", text))
    return 9 <= digits <= 15


def chosen_spans(found: dict[Span, float]) -> list[Span]:
    """The non-overlapping spans with the greatest sum of gains, over a whole document."""
    spans = sorted(found, key=lambda s: (s[1], s[0], KINDS.index(s[2])))
    ends = [s[1] for s in spans]
    best, choice = [0.0], []
    for i, s in enumerate(spans):
        before = bisect.bisect_right(ends, s[0], 0, i)
        take = best[before] + found[s]
        choice.append((take > best[-1], before))
        best.append(max(take, best[-1]))
    out, i = [], len(spans)
    while i:
        take, before = choice[i - 1]
        if take:
            out.append(spans[i - 1])
            i = before
        else:
            i -= 1
    return out[::-1]


def added_spans(text: str, base: list[Span], tagger: Tagger) -> list[Span]:
    """Spans that the tagger adds to a text's base spans."""
    n = len(text)
    marks = np.array([m.start() for m in MAY_HOLD.finditer(text)])
    if not len(marks):
        return []
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    near = np.searchsorted(marks, starts + WINDOW) > np.searchsorted(marks, starts)
    starts = starts[near]
    ids = classes(text)
    padded = np.concatenate([ids, np.full(WINDOW, 28)])
    found: dict[Span, float] = {}
    for i in range(0, len(starts), 256):
        part = starts[i : i + 256]
        for at, spans in zip(part.tolist(), tagger.decode(np.stack([padded[s : s + WINDOW] for s in part.tolist()]))):
            for a, b, kind, gain in spans:
                a, b = at + a, min(at + b, n)
                # a span that touches the window's edge may go on beyond it; another window has it whole
                if (a == at and at > 0) or (b == at + WINDOW and b < n):
                    continue
                while b > a and text[b - 1] in " .,;:\t\n":
                    b -= 1
                if gain >= LEAST_GAIN and plausible(kind, text[a:b]) and all(b <= s or a >= e for s, e, _ in base):
                    whole = (a == 0 or not text[a - 1].isalnum()) and (b == n or not text[b].isalnum())
                    if whole:
                        found[(a, b, kind)] = max(gain, found.get((a, b, kind), 0.0))
    return chosen_spans(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base counts by kind, the digest of the base spans, and all spans."""
    model = docs.sparkSession.sparkContext.broadcast(train())  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 512):
                for t in b.column(1).slice(at, 512).to_pylist():
                    base = base_spans(t or "")
                    count = {k: 0 for k in KINDS}
                    for _, _, k in base:
                        count[k] += 1
                    rows.append((*count.values(), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added_spans(t or "", base, model.value))))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
                names=["key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(lambda batches: released(run(batches)), f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("key", key)


def replaced(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; of spans that overlap or lie in one another nothing is left."""
    out, done = [], 0
    for a, e, k in sorted(spans):
        if a > done:
            out.append(text[done:a])
        out.append(f"<{k}>")
        done = max(done, e)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and n_chars (if there) set anew."""
    model = docs.sparkSession.sparkContext.broadcast(train())
    place = docs.columns.index(text)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(place).to_pylist():
                if t and MAY_HOLD.search(t):
                    base = base_spans(t)
                    t = replaced(t, base + added_spans(t, base, model.value))
                texts.append(t)
            columns = list(b.columns)
            columns[place] = pa.array(texts, b.schema.field(place).type)
            if chars is not None:
                n = pa.array([None if t is None else len(t) for t in texts], b.schema.field(chars).type)
                columns[chars] = n
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(lambda batches: released(run(batches)), docs.schema)
