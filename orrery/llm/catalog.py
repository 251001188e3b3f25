"""The queries of this subpackage: name -> callable, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import ann, bpe, covertree, langid, maintext, neardup, packing, secrets, tokenfile, warc
from orrery.llm.common import fixed_table


def op1_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(fixed_table(spark, sf_dir, "embeddings"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(fixed_table(spark, sf_dir, "pages"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.search(fixed_table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(fixed_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = tokenfile.write_token_files(fixed_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_checksums(folder, files)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(fixed_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))[1]


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixed_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, listed = warc.write_archives(fixed_table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(fixed_table(spark, sf_dir, "documents")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(fixed_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_partitions, op2_bpe, op3_main_text, op4_cover_tree, op5_token_files, op6_packing, op7_language, op8_warc, op9_secrets, op10_minhash)}


OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> h.page_id THEN f.first END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""


OP4 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
  FROM e q JOIN e r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 5
"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """The kind's spans: the texts between matches and the matches before give each one's place."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, v[i] AS value,
      CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS parts FROM d WHERE regexp_matches(t, '{p}')))
    WHERE length(v[i]) >= {least}"""


_BASE = " UNION ALL ".join((
    _spans(0, "assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    _spans(1, "access", "AKIA[A-Z0-9]+", 0, 18),
    _spans(2, "hex", "[0-9a-f]+", 0, 16),
))
_TOKEN = _spans(3, "token", "[A-Za-z0-9+/_-]+", 0, 24)

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
base AS ({_BASE}),
free AS (SELECT f.* FROM ({_TOKEN}) f
  WHERE regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.a < f.a + f.n AND f.a < b.a + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM free),
counts AS (SELECT value, count(DISTINCT source) <= 3 AND count(DISTINCT doc_id) <= 20 AS live FROM every GROUP BY value),
kept AS (SELECT every.*, live FROM every JOIN counts USING (value) WHERE live OR kind <> 'token'),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) FILTER (kind <> 'token') AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (doc_id)
"""

OP10 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
r AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM s GROUP BY list_sort(s)),
e AS (SELECT node, len(s) AS n, unnest(s) AS x FROM r),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c) UNION SELECT b, a FROM p WHERE 100 * c >= 85 * (na + nb - c)),
t AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT t.node, l.b FROM t JOIN l ON t.seen = l.a),
c AS (SELECT node, min(seen) AS component FROM t GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(component, r.node) END AS component_id,
  s.doc_id = CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(component, r.node) END AS kept
FROM s JOIN r ON r.s = list_sort(s.s) LEFT JOIN c ON c.node = r.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_cover_tree": OP4, "op8_warc": OP8, "op9_secrets": OP9, "op10_minhash": OP10}
