"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colforest.llm import anchors, archive, bitsliced, bpe, components, mixture, neardup, personal, registry, spotsigs, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Ünïcode", "日本"]


def make_docs(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empties, and repeated words."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(VOCAB) for _ in range(k))
    passage, line = text(60), text(36)
    rows = []
    for i in range(n):
        t = text(rng.choice([3, 20, 80, 200]))
        if i % 5 == 1:
            t = t + "\n" + passage + " " + t
        if i % 7 == 2:
            t = "\t" + line + "  " + line
        rows.append(t)
    base = text(120).split(" ")
    for _ in range(25):  # a group of near copies
        c = list(base)
        for _ in range(rng.randint(0, 6)):
            c[rng.randrange(len(c))] = rng.choice(VOCAB)
        rows.append(" ".join(c))
    rows += [rows[0]] * 6 + [rows[61].upper(), None, "", " \n\t ", "one", "one", "ONE two", "same " * 120, "same " * 121]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3 + 1, rows[j], "en", [None, "a", "b", "é", "z"][i % 5], len(rows[j] or "")) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """The same rows with columns named like the operators' own."""
    for c in ("chunk", "bucket", "size", "key", "rep", "component_id", "ids", "h", "spans", "score"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs


# ---- 1 -----------------------------------------------------------------------------------------------


def removed_brute(rows, size):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (k, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        left = [x for x, g in zip(w, gone) if not g]
        out.append((k, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size,chunk,probes", [(35, 3 << 20, 1_500_000), (35, 4_000, 300), (7, 2_000, 200)])
def test_anchors(docs, rows, monkeypatch, size, chunk, probes):
    monkeypatch.setattr(anchors, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(anchors, "BUCKET_PROBES", probes)
    got = sorted(tuple(r) for r in anchors.deduplicate(docs, size=size).collect())
    assert got == removed_brute(rows, size)


def test_anchors_edges(spark, docs, rows):
    assert anchors.deduplicate(empty(spark)).count() == 0
    assert sorted(tuple(r) for r in anchors.deduplicate(clashing(docs)).collect()) == removed_brute(rows, 35)
    only = spark.createDataFrame([(1, None), (None, " ".join(map(str, range(40)))), (None, " ".join(map(str, range(40))))], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in anchors.deduplicate(only, keep_text=True).collect())
    assert got == Counter({(1, 0, 0): 1, (None, 40, 40): 2})


# ---- 2 -----------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base_brute(t):
    t = t or ""
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(float(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), m.end(), "card") for m in personal.CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and personal.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in personal.PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2])))


PRIVATE = ["mail bob.x@a-b.example.com, or @x.y@c.d.e", "é 10.0.0.1 and 1.2.3.400 and 1.2.3.4.5", "4111 1111 1111 1111 4111111111111112", "+1 (988) 555-2485.", "call (988) 555-2485 now", None, "", "a@b", "@" * 50, "1" * 3000, "x" * 5000 + "@y.z", "1.2.3." + "0" * 5000, "0" * 5000 + "9.1.2.255", "0" * 6000 + ".0.0.0"]


def test_patterns():
    rng = random.Random(2)
    texts = PRIVATE + ["".join(rng.choice("a1.@-+ %2b..@@1é()") for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    for t in texts:
        assert personal.base_spans(t or "") == base_brute(t)


@pytest.fixture(scope="module")
def tagger():
    return personal.train()


def test_personal(spark, tagger):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)] + [(0, PRIVATE[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in personal.find(df).collect()}
    for i, t in enumerate(PRIVATE):
        base = base_brute(t)
        r, count = got[i], Counter(k for *_, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in personal.KINDS)
        joined = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}
    assert "phone:5:19" in got[4].spans
    assert personal.find(empty(spark)).count() == 0
    clean = personal.redact(spark.createDataFrame([(1, PRIVATE[3], "en", None, 18), (2, None, None, None, None)], DOCS)).orderBy("doc_id").collect()
    assert clean[0].text == "<phone>." and clean[0].n_chars == 8 and clean[1].text is None


def test_redact_nested(spark):
    texts = ["call +1.2.3.4 555 1234 now", "bob.10.0.0.1@corp-name.example.com", "to a@b.example, or c@d.example."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in personal.redact(df).orderBy("doc_id").collect()]
    assert got == ["call <phone><ip> now", "<email><ip>", "to <email>, or <email>."]
    assert personal.replaced("abcdefgh", [(1, 5, "x"), (3, 7, "y")]) == "a<x><y>h"


def test_redact_zeros(spark):
    df = spark.createDataFrame([(1, "at 1.2.3." + "0" * 5000 + " now", "en", "s", 3)], DOCS)
    for t in (df, clashing(df), df.union(df)):
        assert {r.text for r in personal.redact(t).collect()} == {"at <ip> now"}


def test_other_spellings(tagger):
    for t, want in (("mail me: bob[at]corp-x[dot]org, thanks", "email"), ("call (988) 555-2485 now", "phone")):
        assert [k for *_, k in personal.added_spans(t, personal.base_spans(t), tagger)] == [want]
    assert not personal.added_spans("I was (at) home. Then left.", [], tagger)


def test_viterbi_and_choice(tagger):
    """The decoder against all paths of a short window, the choice of spans against all subsets."""
    ids = personal.classes("+1 5@a")[None, :]
    e = tagger.emissions(ids).astype(float)[:4, 0]
    go, first = tagger.p["go"] + tagger.mask, tagger.begin
    value = lambda y: first[y[0]] + e[0, y[0]] + sum(go[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(y, y[1:])))
    best = max(itertools.product(range(len(personal.TAGS)), repeat=4), key=value)
    short = personal.Tagger(1)
    short.p = dict(tagger.p)
    short.emissions = lambda ids, keep=None: e[:, None, :]
    spans = short.decode(ids[:, :4])[0]
    got = [0] * 4
    for a, b, k, _ in spans:
        for t in range(a, b):
            got[t] = personal.TAGS.index(("B-" if t == a else "I-") + k)
    assert tuple(got) == best
    rng = random.Random(4)
    for _ in range(60):
        found = {}
        for _ in range(rng.randint(0, 7)):
            a = rng.randrange(12)
            found[(a, a + rng.randint(1, 6), rng.choice(personal.KINDS))] = rng.random() * 9 + 0.1
        apart = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))
        most = max(sum(found[s] for s in c) for n in range(len(found) + 1) for c in itertools.combinations(found, n) if apart(c))
        chosen = personal.chosen_spans(found)
        assert apart(chosen) and sum(found[s] for s in chosen) == pytest.approx(most)


def test_tagger_held_out(tagger):
    rng, hit, want, wrong = np.random.default_rng(99), 0, 0, 0
    for _ in range(150):
        kind = personal.KINDS[int(rng.integers(4))]
        span = personal.sample_span(rng, kind)
        text = f"{personal._filler(rng, 8)} {span} {personal._filler(rng, 8)}"
        at = text.index(span)
        if personal.plausible(kind, span) and not personal.base_spans(text):
            want += 1
            hit += (at, at + len(span), kind) in personal.added_spans(text, [], tagger)
        none = f"{personal._filler(rng, 8)} {personal.sample_none(rng)} {personal._filler(rng, 8)}"
        wrong += bool(personal.added_spans(none, personal.base_spans(none), tagger))
    assert want > 20 and hit >= 0.7 * want and wrong <= 5


def test_tagger_gradient():
    t = personal.Tagger(1)
    ids, tags = map(np.stack, zip(*(personal.sample_window(np.random.default_rng(s)) for s in range(3))))
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    loss, grad = t.loss(ids, tags)
    for name, at in (("out", (1, 3)), ("go", (0, 1)), ("hf", (5, 2)), ("xb", (30, 1)), ("bb", (7,))):
        old = t.p[name][at]
        t.p[name][at] = old + 1e-2
        up = t.loss(ids, tags)[0]
        t.p[name][at] = old - 1e-2
        down = t.loss(ids, tags)[0]
        t.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grad[name][at]), rel=0.05, abs=0.02)


# ---- 3 -----------------------------------------------------------------------------------------------


def sets_of(t):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w = WORD.findall(w)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def linked_brute(rows):
    sets = {k: sets_of(t) for k, t, *_ in rows}
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in sets)


@pytest.mark.parametrize("block", [200_000, 700])
def test_neardup(docs, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    got = sorted(tuple(r) for r in neardup.link_components(docs).collect())
    assert got == linked_brute(rows)


def test_neardup_edges(spark, docs, rows):
    assert neardup.link_components(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (9, "A b c d e"), (9, "A b c d e"), (3, None)], "doc_id long, text string")
    got = Counter(tuple(r) for r in neardup.link_components(df).collect())
    assert got == Counter({(None, 2, None, True): 1, (7, 2, 7, True): 1, (9, 2, 7, False): 2, (3, 0, 3, True): 1})
    kept = {r.doc_id for r in neardup.keep_one(clashing(docs)).collect()}
    assert kept == {k for k, _, _, keep in linked_brute(rows) if keep}


def planted(seed=8, groups=70):
    """Texts and edited copies whose similarity is just above the threshold, and some just below."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([40, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(2):
            c = list(base)
            for at in range(len(c) // rng.choice([40, 44, 48, 60]) + 1):
                c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(c))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_neardup_recall(spark):
    """Pairs at similarity 0.80 to 0.85 are all found, and none below 0.80."""
    rows = planted()
    sets = [sets_of(t) for _, t in rows]
    near = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a & b]
    assert sum(0.8 <= x <= 0.85 for x in near) >= 20 and sum(0.75 <= x < 0.8 for x in near) >= 10
    got = sorted(tuple(r) for r in neardup.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == linked_brute(rows)


def test_neardup_many_short(spark):
    """Thousands of short documents in one cluster: blocks are bounded by documents too."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(9_000):
        c = list(base)
        c[rng.randrange(2)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    got = neardup.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    # a change of the first word leaves five of six shingles; of the second, four
    assert len(got) == len(rows) and {r.component_id for r in got} == {r.component_id for r in got if r.kept}
    brute = linked_brute(rows[:300])
    few = sorted(tuple(r) for r in neardup.link_components(spark.createDataFrame(rows[:300], "doc_id long, text string")).collect())
    assert few == brute


def test_registers_estimate():
    rng = np.random.default_rng(4)
    for n, share in ((40, 0.9), (400, 0.8), (5_000, 0.5), (1, 1.0)):
        pool = rng.integers(0, 2**52, size=2 * n, dtype=np.uint64)
        common = int(n * share)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        reg = neardup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        got = neardup.estimate(reg[1:], np.array([len(b)]), reg[0], len(a))[0]
        assert got == pytest.approx(true, abs=0.12)


@pytest.mark.parametrize("hub", [5_000, 7])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB_EDGES", hub)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1_000, 1_060)] + [(2_000 + i, 2_000) for i in range(80)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(k, find(k)) for k in list(root) if find(k) != k}
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


# ---- 4 -----------------------------------------------------------------------------------------------


def test_sainte_lague_brute():
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.choice([0.0, rng.random() * 50, float(rng.randint(1, 9))]) for _ in range(rng.randint(1, 6))]
        caps = [rng.randint(0, 40) for _ in w]
        seats = rng.randint(0, 60)
        out = [0] * len(w)
        for _ in range(min(seats, sum(c for c, x in zip(caps, w) if x > 0))):
            i = max((i for i in range(len(w)) if out[i] < caps[i] and w[i] > 0), key=lambda i: (w[i] / (2 * out[i] + 1), -i))
            out[i] += 1
        got = mixture.sainte_lague(w, caps, seats)
        assert sum(got) == sum(out) and sorted(round(x / (2 * g + 1), 6) for x, g in zip(w, got)) == pytest.approx(sorted(round(x / (2 * g + 1), 6) for x, g in zip(w, out)), abs=1e-5)


def test_mixture(spark, docs, rows):
    got = mixture.mix(docs).collect()
    again = mixture.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {k: len(WORD.findall(t or "")) for k, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == sizes
    total, taken, aim = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
        total[r.source] += r.size
        aim[r.source] = r.target
        assert r.source_size == sum(sizes[x.doc_id] for x in got if x.source == r.source)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    assert sum(aim.values()) == pytest.approx(sum(total.values()))
    for s, w in zip(names, (5, 2, 1, 5, 2)):
        assert aim[s] <= 3 * total[s] + 1e-6
        assert abs(taken[s] - aim[s]) <= max(2, 0.01 * aim[s])
    out = mixture.materialise(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == Counter({r.doc_id: r.taken for r in got if r.taken})
    assert mixture.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_words", [4, 40, 1_000])
def test_mixture_many_shards(spark, monkeypatch, shard_words):
    monkeypatch.setattr(mixture, "SHARD_WORDS", shard_words)
    # spread thin: a small source that is to be repeated, and one that is to be taken in small part
    source = lambda i: "a" if i % 40 == 0 else "b" if i % 3 else "c"
    df = spark.createDataFrame([(i, "one two three"[: 3 + 4 * (i % 2)], source(i)) for i in range(1_200)], "doc_id long, text string, source string")
    taken, aim = Counter(), {}
    for r in mixture.mix(df).collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        aim[r.source] = r.target
    assert set(aim) == {"a", "b", "c"} and all(abs(taken[s] - aim[s]) <= 0.5 + 1e-6 for s in aim), (taken, aim)


def test_mixture_brute(spark, docs, rows):
    """Row by row: quotas by the highest quotients, then leading words of the seeded order, from the operator's own
    lot and shard columns but with plain loops."""
    got = mixture.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    aim = {s: rs[0].target for s, rs in by.items()}
    names = sorted(by, key=lambda s: (s is None, s or ""))
    out = {s: 0 for s in names}
    for _ in range(sum(r.size for r in got)):  # one block after another
        s = max((s for s in names if out[s] < 3 * by[s][0].source_size and aim[s] > 0), key=lambda s: (aim[s] / (2 * out[s] + 1), -names.index(s)))
        out[s] += 1
    assert {s: sum(r.taken for r in rs) for s, rs in by.items()} == out
    for s, rs in by.items():  # one shard: whole passes over all, then a prefix of the order: at most one document in part
        copies = {r.copies for r in rs if r.size}
        assert len(copies) <= 1 and sum(0 < r.part < r.size for r in rs) <= 1


def test_mixture_repeats_and_names(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f g", "s"), (None, "h i", "s"), (None, "j", None), (2, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("part", "copies", "size", "_part", "_size", "_key", "row_name", "shard", "lot"):
        df = df.withColumn(c, F.lit(c))
    got = mixture.mix(df).collect()
    assert len(got) == len(rows)
    out = mixture.materialise(df)
    assert out.columns == df.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got) == 13
    assert {r.part for r in out.collect()} == {"part"}
    assert mixture.materialise(df.limit(0)).count() == 0


def test_targets():
    assert mixture.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixture.targets([1, 100], [5, 2]) == pytest.approx([3, 98])
    assert mixture.targets([0, 0], [5, 2]) == [0, 0] and mixture.targets([], []) == []


# ---- 5 -----------------------------------------------------------------------------------------------


def spans_brute(rows, size):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (k, *_), w in zip(rows, words):
        starts = [i for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1]
        for i, s in enumerate(starts):
            if i == 0 or starts[i - 1] != s - 1:
                e = s
                while e + 1 in starts:
                    e += 1
                out.append((k, s, e + size, e + size - s, hashlib.sha256(" ".join(w[s : e + size]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size,chunk,probes", [(50, 3 << 20, 1_500_000), (50, 4_000, 300), (70, 2_000, 200)])
def test_suffixes(docs, rows, monkeypatch, size, chunk, probes):
    monkeypatch.setattr(anchors, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(anchors, "BUCKET_PROBES", probes)
    assert sorted(tuple(r) for r in suffixes.repeats(docs, size=size).collect()) == spans_brute(rows, size)


def test_suffixes_edges(spark, docs, rows):
    assert suffixes.repeats(empty(spark)).count() == 0
    assert sorted(tuple(r) for r in suffixes.repeats(clashing(docs)).collect()) == spans_brute(rows, 50)
    only = spark.createDataFrame([(1, None), (None, " ".join(map(str, range(60)))), (None, " ".join(map(str, range(60))))], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_words) for r in suffixes.repeats(only).collect()) == Counter({(None, 60): 2})


# ---- 6 -----------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(VOCAB) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["zork!", "Blarg", "zorkish"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(901, None), (902, ""), (903, "a " * 50_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(950, None), (5_000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out and k < 900]
    assert sum(got[k].predicted == (k % 6 == 0) for k in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[901].score == got[902].score and got[903].predicted == 0
    assert toxicity.reject(docs, labels).count() < len(rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(docs, none).collect()} == {0}
    assert toxicity.classify(empty(spark), labels).count() == 0


def test_machine_learns_exclusive_or():
    """Neither term says anything alone."""
    rng = np.random.default_rng(1)
    sets, y = [], []
    for _ in range(3_000):
        a, b = rng.random(2) < 0.5
        sets.append(np.unique([*rng.integers(100, 200, 5), *([1] if a else []), *([2] if b else [])]).astype(np.uint32))
        y.append(bool(a != b))
    m = toxicity.fit(sets, np.array(y))
    assert set(m.terms) >= {1, 2} and len(m.terms) < 20
    z, _ = m.raw(np.array([0, 1, 2, 2]), m.find(np.array([1, 2, 1, 2], np.uint32)), 4)
    assert z[0] > 0 and z[1] > 0 and z[2] < 0 and z[3] < 0


def test_machine_scores_brute():
    """The machine's sums against the plain formula over all pairs."""
    rng = np.random.default_rng(2)
    texts = ["alpha beta gamma", "beta beta delta", "", "epsilon"]
    import pyarrow as pa

    data, offsets = toxicity.buffers(pa.array(texts))
    doc, terms = toxicity.document_terms(data, offsets)
    known = np.unique(terms)
    m = toxicity.Machine(known, -0.3, rng.normal(size=len(known)), rng.normal(size=(len(known), toxicity.FACTORS)))
    for i, got in enumerate(m.score(data, offsets)):
        at = np.searchsorted(known, np.unique(terms[doc == i]))
        z = m.bias + m.weight[at].sum() + sum(m.vector[a] @ m.vector[b] for a, b in itertools.combinations(at, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_rows(spark):
    """Repeated rows and ids, null ids, columns with the operator's names."""
    rows = [(i, f"good words {i}" if i % 3 else "zork bad words", "x") for i in range(300)] * 2 + [(None, "zork bad words", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({c: F.lit("y") for c in ("held_out", "predicted", "toxic", "key", "_id", "_text")})
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 1), (0, 0)], "doc_id long, toxic int")
    got = toxicity.classify(df, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.doc_id is not None and r.doc_id % 3 == 0) for r in got if r.doc_id is not None)
    kept = toxicity.reject(df, labels)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == {t for _, t, _ in rows if not (t or "").startswith("zork")}


def test_machine_learns_pairs():
    """Labels that only pairs of terms explain."""
    rng = np.random.default_rng(1)
    sets, y = [], []
    for _ in range(3_000):
        a, b = rng.random(2) < 0.4
        s = [*rng.integers(100, 200, 5), *([1] if a else []), *([2] if b else [])]
        sets.append(np.unique(s).astype(np.uint32))
        y.append(bool(a and b))
    m = toxicity.fit(sets, np.array(y))
    doc = np.array([0, 1, 2, 2])
    z, _ = m.raw(doc, m.find(np.array([1, 2, 1, 2], np.uint32)), 3)
    assert z[0] < 0 and z[1] < 0 and z[2] > 0


# ---- 7 -----------------------------------------------------------------------------------------------


def top_brute(rows, k=10, every=100):
    import math

    usable = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in {(q, tuple(x)) for q, x in usable if q % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(x) == len(y))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,block_queries", [(8_192, 256), (64, 2)])
def test_bitsliced(spark, monkeypatch, block_rows, block_queries):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(bitsliced, "BLOCK_QUERIES", block_queries)
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.normal(0, 0.2, 16).astype(np.float32)]) for i in range(350)]
    rows += [(400 + i, rows[100][1]) for i in range(30)] + [(600, None), (601, []), (700, [float("nan")] * 16), (800, [None] + [0.1] * 15), (900, [0.5] * 8), (901, [0.25] * 8), (None, [0.1] * 16), (1_000, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in bitsliced.top_k(df).collect()) == top_brute(rows)


def test_bitsliced_repeated_queries(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 9.0]), (0, [1.0, 9.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0])]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(n)
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bitsliced.top_k(df).collect()) == [(0, 1, 2, 9 << 20), (0, 2, 1, 1 << 20)]


def test_bitsliced_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitsliced.top_k(none).count() == 0
    few = spark.createDataFrame([(0, [1.0, -2.0], "x"), (5, [0.0, 0.0], "x"), (9, [3.0, 7.5], "x")], "vec_id long, embedding array<float>, rank string")
    assert sorted((r.rank, r.vec_id) for r in bitsliced.top_k(few).collect()) == [(1, 5), (2, 9)]


# ---- 8 -----------------------------------------------------------------------------------------------


def test_archive(spark, tmp_path):
    long = "é" * 80
    rows = [(3, "u3", long), (1, "u1", "short"), (2, "u2", "short"), (9, "u9", long), (5, None, long), (6, "u6\r\nX: y", None), (7, "u7", ""), (None, "un", long), (8, "u8", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("body", F.lit(2))
    got = {r.page_id: r for r in archive.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for k, _, t in rows:
        body = (t or "").encode()
        assert got[k].payload_bytes == len(body) and got[k].payload_digest == hashlib.sha256(body).hexdigest()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {9: ("revisit", 3), 5: ("revisit", 3), None: ("revisit", 3)}
    path = str(tmp_path / "w")
    archive.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {r.page_id: bytes(r.record) for r in archive.reconstruct(spark, path).collect()}
    assert records[3].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[3].endswith(b"\r\n\r\n" + long.encode() + b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:3>" in records[9] and records[9].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert b"\nX: y" not in records[6]
    assert archive.round_trip(pages.limit(0)).count() == 0


# ---- 9 -----------------------------------------------------------------------------------------------

HARD = ["", None, "Hello<|endoftext|>World <|startoftext|>", "don't I'LL o'clock", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ", "éa ́x", "a b\x1cc\x85d　e", "日本語 テスト 123 ½ ²", "\U0001f600\U0001f601 ok", "a" * 5_000, "''''s 's", "\x00\x01", "ﬁ ſ K Å", " \n\t "]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(registry.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(spark, library, rows):
    path = registry.tokenizer_path()
    texts = HARD + [t for _, t, *_ in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("old"))
    coded = bpe.encode(df, path)
    back = {r.doc_id: r for r in bpe.decode(coded, path).collect()}
    digests = {r.doc_id: r for r in bpe.round_trip(df, path).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert back[i].ids == want and back[i].decoded == text
        assert digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), path).count() == 0


def test_bpe_separators(library):
    texts = [f"a{c}b" for c in "\x1c\x1d\x1e\x1f"] + ["\x1c", " x\x1f\x1e y\tz\x1d\n", "a\x0bb\x0cc"]
    got = [x.tolist() for x in bpe.Codec(registry.tokenizer_path()).encode(texts)]
    assert got[0] == [320, 472, 321]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_small_cache(library, monkeypatch, rows):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    c = bpe.Codec(registry.tokenizer_path())
    texts = [t or "" for _, t, *_ in rows]
    for i in range(0, len(texts), 7):
        assert [x.tolist() for x in c.encode(texts[i : i + 7])] == [library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 7]]


# ---- 10 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [5_000, 2])
def test_spotsigs(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", bucket)
    got = {r.doc_id: r for r in spotsigs.neighbour_report(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    prints = {}
    for (k, t, *_), (nk, nt, *_) in zip(order, order[1:] + order[:1]):
        t, nt, r = t or "", nt or "", got[k]
        third = len(t) // 3
        edited = t[: len(t) - third] + nt[:third]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        cut = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
        jac = lambda a, b: 1.0 if not a and not b else (x if (x := len(a & b) / len(a | b)) >= spotsigs.LEAST else 0.0)
        assert r.near_edited == pytest.approx(jac(cut(r.fingerprint), cut(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(jac(cut(r.fingerprint), cut(got[nk].fingerprint)))
    mean = lambda c: np.mean([getattr(r, c) for r in got.values() if r.n_chars > 100])
    assert mean("near_edited") > 0.35 > mean("near_next")


def signatures_brute(t):
    """Chains of up to CHAIN content words, each with the anchor it follows, if it follows one."""
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
    chains, open_ = [], False
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            open_ = False
        elif open_ and chains[-1][1] < spotsigs.CHAIN:
            chains[-1] = (f"{chains[-1][0]} {w}", chains[-1][1] + 1)
        else:
            anchor = f" {words[i - 1]}" if i and words[i - 1] in spotsigs.ANCHORS else ""
            chains.append((f"{anchor} {w}", 1))
            open_ = True
    found = {c for c, _ in chains} or ({" ".join(words)} if words else set())
    return {xxhash.xxh64_intdigest(c.encode(), seed=42) >> 32 for c in found}


def test_signatures(spark, rows):
    texts = ["The cat of And the dog, runs; to a house", "", "und der Hund des Mannes läuft", "no anchors whatsoever " * 30, "the the the", "des", "of course the extraordinary circumstances " * 12, "a b c d e f g h the"]
    texts += [t or "" for _, t, *_ in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r for r in df.select("i", spotsigs.signatures(F.col("text")).alias("s"), spotsigs.fingerprint(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts):
        want = sorted(signatures_brute(t))
        assert got[i].s == want and got[i].p == "".join(f"{x:08X}" for x in want)


def test_signatures_one_rule(spark):
    words = "run sun map cup tree rock bird fish wind lake road farm snow rain hill moon star gate lamp fork".split()
    long = " ".join(words[(7 * i) % 20] + str(i) for i in range(60))
    long = long[: long.index(" ", 300)]
    texts = [long, long[: long.rindex(" ", 0, 299)], " ".join(words * 4), " ".join(words[1:] * 4), "!? ..."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [set(r.s) for r in df.select("i", spotsigs.signatures(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got[1] < got[0] and len(got[1]) > 0.8 * len(got[0])  # a copy cut to below 300 characters
    assert got[2] and got[3] and got[2] != got[3]  # different texts of short words only
    assert not got[4]


def test_spotsigs_edges(spark):
    assert spotsigs.neighbour_report(empty(spark)).count() == 0
    one = spotsigs.neighbour_report(spark.createDataFrame([(5, "the red house")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    df = spark.createDataFrame([(None, None), (2**62, "the house"), (-5, "the mouse"), (-5, "the mouse"), (0, "")], "doc_id long, text string")
    assert spotsigs.neighbour_report(df).count() == 5


def test_spotsigs_order(spark, monkeypatch):
    """Clumped ids, null and repeated ids, columns named like the operator's own: each row meets the next one."""
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 3)
    monkeypatch.setattr(spotsigs, "RUN", 2)
    ids = [*range(40), *range(10**15, 10**15 + 40), -(2**63), 2**63 - 1, None, 7]
    texts = [f"{'x' * (3 * (i % 7))}{i} tail" for i in range(len(ids))]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in zip(ids, texts)], "doc_id long, text string, bucket int, h int")
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in spotsigs.neighbour_report(df.repartition(4)).collect()}
    order = sorted(zip(ids, texts), reverse=True, key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1].encode(), seed=42) + 2**63) % 2**64))
    want = {(k, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()) for (k, t), (_, u) in zip(order, order[1:] + order[:1])}
    assert got == want and len(want) == len(ids)


def test_spotsigs_search(spark, rows):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    least = 0.7
    sets = defaultdict(list)
    for r in df.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect():
        sets[frozenset(r.s)].append(r.doc_id)
    keys = {min(v): s for s, v in sets.items() if s}
    want = {(a, b) for a in keys for b in keys if a < b and len(keys[a] & keys[b]) / len(keys[a] | keys[b]) >= least}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(df, least).collect()} == want
