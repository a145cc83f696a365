"""The pipeline's stages against plain versions of their decisions, and its queries against SQL."""

import glob
import hashlib
import itertools
import math
import os
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colforest.llm import registry, toxicity


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def least_of_groups(rows):
    """Ids that are the smallest of their component, by all pairs of five-word sets."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k for k in sets if find(k) == k}


def plain_score(machine, text):
    """The factorization machine's formula, pair by pair."""
    data, offsets = toxicity.buffers(pa.array([text], pa.string()))
    place = {int(t): i for i, t in enumerate(machine.terms)}
    at = sorted({place[int(t)] for t in toxicity.document_terms(data, offsets)[1] if int(t) in place})
    z = machine.bias + sum(machine.weight[i] for i in at) + sum(machine.vector[i] @ machine.vector[j] for i, j in itertools.combinations(at, 2))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain_quotas(rows):
    """Words of each source: one after another to the highest quotient."""
    size = Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    aim, free, left = {}, [s for s in names if size[s]], float(sum(size.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > 3 * size[s]]
        aim |= {s: 3.0 * size[s] for s in full} if full else {s: weight[s] * unit for s in free}
        left -= sum(aim[s] for s in full)
        free = [s for s in free if s not in full] if full else []
    return {s: (aim.get(s, 0.0), size[s]) for s in names}


def test_stages(spark, sf_dir):
    """Each stage on what the one before it kept, against plain Python that shares no code with it but the trained
    parameters (and, for the encoder, against the library)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        seen[name] = (docs.collect(), out.collect())
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out
    ids = lambda rows: {r.doc_id for r in rows}
    before, after = seen["toxicity"]
    scores = {r.doc_id: plain_score(machine, r.text) for r in before}
    assert ids(after) == {k for k, x in scores.items() if x < toxicity.THRESHOLD}
    before, after = seen["near_duplicates"]
    assert ids(after) == least_of_groups(before) and len(after) < len(before)
    before, after = seen["personal_data"]
    texts = {r.doc_id: r.text for r in after}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in before:
        t = r.text or ""
        if not re.search(r"[0-9@]|[(\[{] ?at ?[)\]}]", t, re.IGNORECASE):
            assert texts[r.doc_id] == r.text
        assert not email.search(texts[r.doc_id] or "")
        # what is left between the marks stands in the text in the same order
        at = 0
        for part in re.split(r"<(?:email|ip|card|phone)>", texts[r.doc_id] or ""):
            at = t.index(part, at) + len(part)
    assert ids(before) == ids(after) and any("<" in t and t != r.text for r, t in ((r, texts[r.doc_id] or "") for r in before))
    before, after = seen["mixture"]
    quotas, words, whole = plain_quotas(before), Counter(), {r.doc_id: WORD.findall(r.text or "") for r in before}
    for r in after:
        w = WORD.findall(r.text)
        assert w == whole[r.doc_id][: len(w)] and w
        words[r.source] += len(w)
    assert all(abs(words[s] - aim) <= 1 and words[s] <= 3 * size for s, (aim, size) in quotas.items())
    before, after = seen["bpe"]
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(registry.tokenizer_path())
    library.no_padding()
    library.no_truncation()
    want = Counter()
    for r in before:
        found = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want


@pytest.mark.parametrize("n", [0, 40])
def test_odd_tables(spark, tmp_path, n):
    """An empty table; and null, empty, repeated rows and ids with columns named like the stages' own."""
    rows = [(i, f"word{i} some plain text number {i} of this table here", "en", "ab"[i % 2], 10) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "a null id", "en", "a", 9), (3, "", "en", "a", 0), (5, "twice", "en", "a", 5), (5, "twice", "en", "a", 5)] * bool(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("part", "copies", "size", "_gone", "kept", "rep", "score", "toxic", "shard", "registers", "_part"):
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(n)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) > 0) == (n > 0) and all(r.n_tokens > 0 for r in got)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([dict(zip(names, r))[c] for c in sorted(names)]) for r in result.fetchall()) == sorted(repr([r[c] for c in sorted(names)]) for r in df.collect())
