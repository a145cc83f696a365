"""Queries of this subpackage, and the SQL that states the same results where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, archive, bitsliced, bpe, mixture, neardup, personal, spotsigs, suffixes, toxicity
from .store import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a published vocabulary file; COLFOREST_TOKENIZERS names another folder."""
    folder = os.environ.get("COLFOREST_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.deduplicate(table(spark, sf_dir, "documents"))


def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_components(table(spark, sf_dir, "documents"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op8_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbour_report(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
r AS (SELECT doc_id, i, word, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 THEN 1 ELSE 0 END AS rep FROM t),
g AS (SELECT doc_id, i, word, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
d AS (SELECT doc_id, count(*) AS n, sum(gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN d USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM t) WHERE c > 1),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r) GROUP BY doc_id, island)
SELECT doc_id, (a - 1)::BIGINT AS start_word, (b - 1)::BIGINT AS end_word, (b - a)::BIGINT AS n_words, sha256(array_to_string(ws[a:b - 1], ' ')) AS span_sha256 FROM g JOIN w USING (doc_id)
"""

OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * e.x[i])) AS BIGINT) AS score
      FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8_SQL = """
SELECT p.page_id, octet_length(encode(coalesce(p.html, ''))) AS payload_bytes, sha256(coalesce(p.html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(p.html, ''))) < 100 OR p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(p.html, ''))) >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM pages p JOIN (SELECT coalesce(html, '') AS body, min(page_id) AS first_id FROM pages GROUP BY 1) f ON f.body = coalesce(p.html, '')
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_anchors, op2_personal, op3_neardup, op4_mixture, op5_suffixes, op6_toxicity, op7_bitsliced, op8_archive, op9_bpe, op10_spotsigs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_anchors": OP1_SQL, "op3_neardup": OP3_SQL, "op5_suffixes": OP5_SQL, "op7_bitsliced": OP7_SQL, "op8_archive": OP8_SQL}
