"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from inkwell.llm import line_dedup, mixing, pivots, sharding, warc
from inkwell.llm.queries import COPY_IDS

OP1 = f"""
WITH r AS (
  SELECT doc_id, source, coalesce('=' || source, '!') AS stratum,
         md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY stratum) AS frac
  FROM r),
p AS (SELECT doc_id, source, row_number() OVER (ORDER BY frac, stratum, k, doc_id) - 1 AS position FROM f)
SELECT doc_id, source, CAST(position * {sharding.N_SHARDS} // (SELECT count(*) FROM documents) AS BIGINT) AS shard_id,
       CAST(position AS BIGINT) AS position
FROM p
"""

OP7 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(lower(line), '[ \\t\\r\\f]+', ' ', 'g')) AS norm FROM l),
hot AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > {line_dedup.MAX_DOCS}),
m AS (SELECT n.*, h.norm IS NOT NULL AS dropped FROM n LEFT JOIN hot h ON n.norm = h.norm),
g AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN g.text END AS text,
       CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN g USING (doc_id)
"""



def _fill(parent: str, name: str, keys: str, children: str, weight: str) -> str:
    """Split the parents' budgets among children (keys, cap, budget), as ``keys, share``."""
    return f"""
  SELECT {keys}, CASE WHEN opened THEN (budget - full0) * w // rest0 ELSE cap END AS share FROM (
    SELECT *, min(CASE WHEN opened THEN full_ END) OVER (PARTITION BY {parent}) AS full0,
           max(CASE WHEN opened THEN rest END) OVER (PARTITION BY {parent}) AS rest0 FROM (
      SELECT *, (budget - full_) * w < cap * rest AS opened FROM (
        SELECT *, CAST(coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_,
               CAST(sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
        FROM (SELECT *, CAST({weight} AS BIGINT) AS w FROM ({children})))))"""


_M, _W = mixing.MIXTURE, mixing.weight_sql(mixing.MIXTURE)

OP5 = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS n_tokens,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, text
  FROM documents),
e AS (SELECT *, {mixing.domain_sql(_M)} AS domain FROM d),
leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {_M.max_epochs} AS BIGINT) AS cap
  FROM e GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT CAST(sum(tokens) * {_M.budget[0]} // {_M.budget[1]} AS BIGINT) AS budget FROM leaf),
b1 AS ({_fill("1", "domain", "domain", "SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS budget FROM leaf, total GROUP BY domain", _W["domain"])}),
b2 AS ({_fill("domain", "lang", "domain, lang", "SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, any_value(share) AS budget FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang", _W["lang"])}),
b3 AS ({_fill("domain, lang", "source", "domain, lang, source, tokens", "SELECT domain, lang, source, tokens, cap, share AS budget FROM leaf JOIN b2 USING (domain, lang)", _W["source"])}),
p AS (SELECT e.*, share // tokens AS whole, share % tokens AS rest FROM e JOIN b3 USING (domain, lang, source)),
c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
           ORDER BY md5('{mixing.SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, n_tokens
           ROWS UNBOUNDED PRECEDING) AS running
  FROM p WHERE rest > 0)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(whole)) AS BIGINT) AS epoch FROM p WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS BIGINT) FROM c WHERE running <= rest
"""


def _near(vectors: str) -> str:
    return f"""
WITH RECURSIVE v AS ({vectors}),
pair AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding, b.embedding) >= {pivots.MIN_COSINE}),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x),
class AS (SELECT x AS vec_id, min(y) AS class_id FROM reach GROUP BY x)
SELECT vec_id, class_id, (SELECT count(*) FROM pair WHERE x = vec_id) AS n_links FROM class
"""


OP2 = _near("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
OP2_COPIED = _near(f"""
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings
  UNION ALL
  SELECT vec_id + {COPY_IDS}, CASE WHEN vec_id % 5 = 0 THEN CAST(embedding AS DOUBLE[])
         ELSE list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (1 + ((vec_id + i - 1) % 3 - 1) * 0.3::DOUBLE)) END
  FROM embeddings""")

OP8 = f"""
WITH p AS (
  SELECT page_id, url, hex(encode(coalesce(html, ''))) AS h,
         md5(coalesce(CAST(page_id AS VARCHAR), 'null') || '|' || coalesce(url, 'null')) AS k
  FROM pages),
c AS (
  SELECT *, len(h) // 2 AS n, CAST(unnest(range(greatest(1, (len(h) // 2 + {warc.CHUNK_BYTES - 1}) // {warc.CHUNK_BYTES}))) AS BIGINT) AS i
  FROM p)
SELECT '<urn:uuid:' || k[1:8] || '-' || k[9:12] || '-' || k[13:16] || '-' || k[17:20] || '-' || k[21:32] || '>' AS record_id,
       'response' AS warc_type, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri,
       CAST(i AS INTEGER) AS chunk_no, i * {warc.CHUNK_BYTES} AS chunk_offset,
       CAST(least({warc.CHUNK_BYTES}, n - i * {warc.CHUNK_BYTES}) AS INTEGER) AS n_bytes,
       to_base64(unhex(substr(h, i * {2 * warc.CHUNK_BYTES} + 1, {2 * warc.CHUNK_BYTES}))) AS chunk,
       sha256(unhex(substr(h, 1, (i + 1) * {2 * warc.CHUNK_BYTES}))) AS digest,
       (i + 1) * {warc.CHUNK_BYTES} >= n AS is_last, (i + 1) * {warc.CHUNK_BYTES} >= n AS complete
FROM c
"""

ORACLES = {"op1_sharding": OP1, "op2_embedding_near_dedup": OP2, "op2_embedding_near_dedup_copied": OP2_COPIED, "op5_source_mixing": OP5, "op7_line_dedup": OP7, "op8_warc": OP8}
