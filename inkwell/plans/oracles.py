"""DuckDB SQL with the results of the queries, by name."""

from __future__ import annotations

from inkwell.operators.ngrams import NODE_BYTES
from inkwell.operators.words import ROW_BYTES
from inkwell.plans.queries import CAP, CHUNK_BYTES, FUNCTIONAL, HASHES, MAX_LENGTH, MIN_FREQ, MIN_LENGTH, SAMPLE, SAMPLE_SEED, TOP_K, WORD

_SKIP = (
    r"\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x{A0}\x{1680}\x{2000}-\x{200A}\x{2010}-\x{2029}"
    r"\x{202F}-\x{205F}\x{2190}-\x{2BFF}\x{3000}-\x{303F}"
)
_EMO = r"0-9\x{A9}\x{AE}\x{2122}\x{2139}\x{3297}\x{3299}\x{200D}\x{FE0F}\x{20E3}\x{1F000}-\x{1FAFF}"

LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no
  FROM documents WHERE text IS NOT NULL)"""


def _bytes(c: str) -> str:
    return f"octet_length(encode({c}))"


def _blank(c: str) -> str:
    return f"regexp_matches({c}, '^[ \\t\\n\\x0B\\f\\r]*$')"


def _emoji(c: str) -> str:
    return f"regexp_matches({c}, '^[{_SKIP}{_EMO}]*[{_EMO}][{_SKIP}{_EMO}]*$')"


def _bad(c: str, lo: int = 0, hi: int = 0) -> str:
    out = f"({_bytes(c)} <= 1 OR {_emoji(c)}"
    out += f" OR {_bytes(c)} < {lo}" if lo else ""
    out += f" OR {_bytes(c)} > {hi}" if hi else ""
    return out + ")"


def _form(c: str, fold: bool) -> str:
    """Composition; compatibility forms don't occur in the tables, so NFC and NFKC agree on them."""
    clean = f"regexp_replace(nfc_normalize({c}), '[\\p{{Cc}}\\p{{Cf}}]', '', 'g')"
    return f"CASE WHEN regexp_matches({clean}, '[0-9]') THEN {clean} ELSE lower({clean}) END" if fold else clean


def _normalized(fold: bool) -> str:
    return f"""
norm AS (
  SELECT * FROM (
    SELECT doc_id, line_no, {_form('line', fold)} AS line FROM lines
    WHERE NOT {_bad('line')} AND NOT {_blank('line')} AND length(line) > 1)
  WHERE line <> '' AND NOT {_bad('line')})"""


def _grams(n: int, source: str = "lines", name: str = "counts") -> str:
    return f"""
{name} AS (
  SELECT ngram, count(*) AS frequency FROM (
    SELECT unnest(list_transform(range(1, greatest(length(line) - {n} + 2, 1)), lambda i: substr(line, i, {n}))) AS ngram FROM {source})
  GROUP BY ngram)"""


def _pmi(n: int, min_freq: int, name: str, counts: str, digits: int = 6) -> str:
    joins = " ".join(f"JOIN {name}_c c{k} ON c{k}.ch = substr(g.ngram, {k}, 1)" for k in range(1, n + 1))
    product = " * ".join(f"(c{k}.cnt / t.total)" for k in range(1, n + 1))
    return f"""
{name}_c AS (
  SELECT ch, CAST(sum(frequency) AS BIGINT) AS cnt FROM (
    SELECT unnest(list_transform(range(1, {n + 1}), lambda i: substr(ngram, i, 1))) AS ch, frequency FROM {counts} WHERE frequency >= {min_freq})
  GROUP BY ch),
{name}_t AS (SELECT CAST(sum(frequency) AS BIGINT) AS total FROM {counts}),
{name} AS (
  SELECT g.ngram, round(log2((g.frequency / t.total) / ({product})), {digits}) AS pmi, g.frequency
  FROM {counts} g {joins}, {name}_t t WHERE g.frequency >= {min_freq})"""


def _top(name: str, k: int) -> str:
    return f"SELECT ngram, pmi, frequency FROM {name} ORDER BY pmi DESC, frequency DESC, ngram LIMIT {k}"


def _candidates(most: int) -> str:
    return f"""{LINES}, {_grams(2, name="n2")}, {_grams(3, name="n3")},
{_pmi(2, MIN_FREQ, "p2", "n2")}, {_pmi(3, MIN_FREQ, "p3", "n3")},
cands AS (
  SELECT ngram AS text, pmi AS score, frequency FROM (
    SELECT * FROM ({_top("p2", TOP_K)}) UNION ALL SELECT * FROM ({_top("p3", TOP_K)}))
  WHERE pmi >= {WORD.min_pmi} AND {_bytes("ngram")} <= {WORD.max_candidate_length}
  ORDER BY pmi DESC, ngram LIMIT {most})"""


CANDIDATES = _candidates(WORD.max_candidates)

OCCURRENCES = f"""{CANDIDATES},
hits AS (
  SELECT c.text, d.doc_id, (length(d.text) - length(replace(d.text, c.text, ''))) // length(c.text) AS n, strpos(d.text, c.text) - 1 AS place
  FROM cands c JOIN documents d ON contains(d.text, c.text)),
occ AS (SELECT text, CAST(sum(n) AS BIGINT) AS occurrences, min(doc_id) AS doc_id, CAST(min_by(place, doc_id) AS BIGINT) AS place FROM hits GROUP BY text)"""

OFFSETS = """
offs AS (
  SELECT doc_id, CAST(length(text) AS BIGINT) AS size,
         CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM documents WHERE text IS NOT NULL)"""

CONTEXTS = f"""{OCCURRENCES}, {OFFSETS},
body AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents),
spot AS (SELECT o.text, o.place + f.start AS q FROM occ o JOIN offs f USING (doc_id)),
ctx AS (SELECT text, substr(t, greatest(0, q - 20) + 1, least(length(t), q + 20) - greatest(0, q - 20)) AS context FROM spot, body)"""

VERIFIED = f"""{CONTEXTS},
ver AS (
  SELECT c.*, x.context, least(1.0::DOUBLE, o.occurrences / 10.0::DOUBLE) AS context_score,
         least(1.0::DOUBLE, least(1.0::DOUBLE, c.frequency / 20.0::DOUBLE) * (1 + least(0.3::DOUBLE, (length(c.text) - 1) * 0.1::DOUBLE))
               * CASE WHEN o.occurrences > 1 THEN 1 + least(0.2::DOUBLE, (o.occurrences - 1) * 0.05::DOUBLE) ELSE 1.0::DOUBLE END) AS statistical_score
  FROM cands c JOIN occ o USING (text) JOIN ctx x USING (text))"""

_SUBSTRINGS = """
SELECT * FROM {t} x WHERE NOT EXISTS (
  SELECT 1 FROM {t} y WHERE octet_length(encode(x.text)) < octet_length(encode(y.text)) AND contains(y.text, x.text) AND x.score < y.score * 0.8)"""


def _overlaps(source: str) -> str:
    """Greedy resolution in rounds: a candidate is settled once all that its fate depends on are."""
    return f"""
num AS (SELECT *, row_number() OVER (ORDER BY score DESC, text) AS id, dense_rank() OVER (ORDER BY score DESC) AS lev FROM ({source})),
sub AS (
  SELECT DISTINCT id AS a, lev AS la, unnest(flatten(list_transform(range(1, length(text)), lambda n: list_transform(range(1, length(text) - n + 2), lambda i: substr(text, i, n))))) AS text
  FROM num WHERE length(text) > 1),
inside AS (
  SELECT s.a, s.la, n.id AS b, n.lev AS lb FROM sub s JOIN num n ON n.text = s.text
  UNION SELECT x.id, x.lev, y.id, y.lev FROM num x JOIN num y ON x.text = y.text AND x.id <> y.id),
edge AS (SELECT a, la, b, lb FROM inside UNION SELECT b, lb, a, la FROM inside),
up AS MATERIALIZED (SELECT a, b FROM edge WHERE lb < la),
side AS MATERIALIZED (SELECT a, b FROM edge WHERE la = lb AND b > a),
need AS MATERIALIZED (SELECT a, b FROM up UNION SELECT s.a, u.b FROM side s JOIN up u ON u.a = s.b),
walk(r, done, kept) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT r + 1, list_concat(done, fresh), list_concat(kept, coalesce((
      SELECT list(f) FROM (SELECT unnest(fresh) AS f)
      WHERE f NOT IN (SELECT u.a FROM up u WHERE list_contains(kept, u.b))
        AND f NOT IN (SELECT s.a FROM side s WHERE s.b NOT IN (SELECT v.a FROM up v WHERE list_contains(kept, v.b)))), CAST([] AS BIGINT[])))
  FROM (
    SELECT w.*, coalesce((
        SELECT list(n.id) FROM num n WHERE NOT list_contains(w.done, n.id)
          AND n.id NOT IN (SELECT e.a FROM need e WHERE NOT list_contains(w.done, e.b))), CAST([] AS BIGINT[])) AS fresh
    FROM walk w)
  WHERE len(fresh) > 0),
solo AS (SELECT num.* FROM num WHERE id IN (SELECT unnest(kept) FROM walk WHERE r = (SELECT max(r) FROM walk)))"""


def _ranked(source: str, total: str, k: int) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY round(total, 9) DESC, score0 DESC, word) AS rank, word, round(total, 6) AS score, frequency, context
FROM (SELECT text AS word, {total} AS total, score AS score0, frequency, context FROM {source})
ORDER BY round(total, 9) DESC, score0 DESC, word LIMIT {k}"""


COMBINED = f"""(0.4::DOUBLE * least(1.0::DOUBLE, score / 10) + 0.2::DOUBLE * exp(-pow({_bytes('text')} - 4, 2) / 8)
  + 0.2::DOUBLE * context_score + 0.2::DOUBLE * statistical_score)"""

_FILE = "SELECT string_agg(line, chr(10) ORDER BY doc_id, line_no) || chr(10) AS t FROM lines"
_NAMES = "names AS (SELECT text, count(*) AS frequency FROM (SELECT unnest(string_split(p_name, ' ')) AS text FROM part) GROUP BY text)"
_STATISTICAL = """least(1.0::DOUBLE, least(1.0::DOUBLE, n.frequency / 20.0::DOUBLE) * (1 + least(0.3::DOUBLE, (length(n.text) - 1) * 0.1::DOUBLE))
  * CASE WHEN o.occurrences > 1 THEN 1 + least(0.2::DOUBLE, (o.occurrences - 1) * 0.05::DOUBLE) ELSE 1.0::DOUBLE END)"""

_KEYED = "SELECT doc_id, line_no, line FROM"

ORACLES = {
    "lines_scan_count": f"WITH {LINES} SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum({_bytes('line')}) AS BIGINT) AS bytes FROM lines",
    "line_filters": f"WITH {LINES} SELECT {_blank('line')} AS blank, {_bad('line')} AS excluded, {_emoji('line')} AS emoji_only, count(*) AS n FROM lines GROUP BY ALL",
    "line_length_bounds": f"WITH {LINES} {_KEYED} lines WHERE NOT {_bad('line', MIN_LENGTH, MAX_LENGTH)}",
    "normalize_nfkc_lower": f"WITH {LINES}, {_normalized(True)} {_KEYED} norm",
    "normalize_nfc": f"WITH {LINES}, {_normalized(False)} {_KEYED} norm",
    "normalize_dedup": f"WITH {LINES}, {_normalized(True)} SELECT min_by(doc_id, (doc_id, line_no)) AS doc_id, min_by(line_no, (doc_id, line_no)) AS line_no, line FROM norm GROUP BY line",
    "normalize_stats": f"WITH {LINES}, {_normalized(True)} SELECT r AS rows, u AS uniques, r - k AS excluded, k - u AS duplicates, r - u AS removed FROM (SELECT (SELECT count(*) FROM lines) AS r, (SELECT count(DISTINCT line) FROM norm) AS u, (SELECT count(*) FROM norm) AS k)",
    "normalize_batch_dedup": f"WITH {LINES}, {_normalized(True)}, b AS (SELECT doc_id, line_no, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 1000 AS batch FROM lines) SELECT min_by(doc_id, (doc_id, line_no)) AS doc_id, min_by(line_no, (doc_id, line_no)) AS line_no, line FROM norm JOIN b USING (doc_id, line_no) GROUP BY line, batch",
    "tsv_field_rules": "SELECT event_id, lower(event_type) || chr(9) || 'User ' || user_id || chr(9) || 'some text' AS line FROM events WHERE coalesce(event_type, '') <> '' AND event_id % 5 <> 0 AND user_id IS NOT NULL",
    "line_hashes": f"WITH {LINES} SELECT count(DISTINCT line) AS lines, count(DISTINCT line) AS hashes FROM lines",
    **{f"ngram_counts_{n}": f"WITH {LINES}, {_grams(n)} SELECT ngram, frequency FROM counts" for n in (1, 2, 3, 5)},
    "ngram_total": f"WITH {LINES}, {_grams(2)} SELECT CAST(sum(frequency) AS BIGINT) AS total FROM counts",
    "component_counts": f"WITH {LINES}, {_grams(2)}, {_pmi(2, 3, 'p', 'counts')} SELECT ch, cnt AS count FROM p_c",
    "ngram_minfreq": f"WITH {LINES}, {_grams(2)} SELECT ngram, frequency FROM counts WHERE frequency >= 50",
    "unigram_topk": f"WITH {LINES}, {_grams(1)} SELECT ngram, CAST(frequency AS DOUBLE) AS pmi, frequency FROM counts WHERE frequency >= 3 ORDER BY frequency DESC, ngram LIMIT 20",
    **{f"pmi_{n}_topk": f"WITH {LINES}, {_grams(n)}, {_pmi(n, 3, 'p', 'counts')} {_top('p', 2500)}" for n in (2, 3)},
    "prefix_lookup": f"WITH {LINES}, {_grams(3)} SELECT ngram, frequency FROM counts WHERE starts_with(ngram, 'th')",
    "suffix_lookup": f"WITH {LINES}, {_grams(3)} SELECT ngram, frequency FROM counts WHERE ends_with(ngram, 'ng')",
    "trie_nodes": f"WITH {LINES}, {_grams(3)}, h AS (SELECT hex(encode(ngram)) AS h FROM counts) SELECT count(DISTINCT p) + 1 AS nodes, (count(DISTINCT p) + 1) * {NODE_BYTES} AS bytes FROM (SELECT unnest(list_transform(range(1, len(h) // 2 + 1), lambda i: substr(h, 1, 2 * i))) AS p FROM h)",
    "ngram_overwrite": f"WITH {LINES} SELECT substr(line, 1, 3) AS ngram, CAST(max_by(length(line), (doc_id, line_no)) AS BIGINT) AS frequency FROM lines WHERE length(line) > 3 GROUP BY 1",
    "candidates_all": f"WITH {CANDIDATES} SELECT text, score, frequency FROM cands",
    "candidates_capped": f"WITH {_candidates(CAP)} SELECT text, score, frequency FROM cands",
    "occurrence_counts": f"WITH {OCCURRENCES} SELECT text, occurrences FROM occ",
    "first_occurrences": f"WITH {OCCURRENCES} SELECT text, doc_id, place FROM occ",
    "text_offsets": f"WITH {OFFSETS} SELECT doc_id, start, size FROM offs",
    "verify_in_text": "WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS text FROM part UNION SELECT 'the' UNION SELECT 'zzzqqq') SELECT text FROM w WHERE text <> '' AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, w.text))",
    "context_window": f"WITH {CONTEXTS} SELECT text, context FROM ctx",
    "context_score": f"WITH {OCCURRENCES} SELECT text, least(1.0::DOUBLE, occurrences / 10.0::DOUBLE) AS context_score FROM occ",
    "statistical_score": f"WITH {VERIFIED} SELECT text, round(statistical_score, 9) AS statistical_score FROM ver",
    "dictionary_anti": f"WITH {CANDIDATES} SELECT text, score, frequency FROM cands WHERE text NOT IN (SELECT ngram FROM n2 WHERE frequency % 2 = 0) AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, cands.text))",
    "substring_prune": f"WITH {CANDIDATES} SELECT text, score FROM ({_SUBSTRINGS.format(t='cands')})",
    "overlap_prune": f"WITH RECURSIVE {CANDIDATES}, {_overlaps('SELECT * FROM cands')} SELECT text, score FROM solo",
    "valid_candidate_filter": f"WITH {LINES}, {_grams(1, name='a')}, {_grams(2, name='b')} SELECT ngram AS text, frequency FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE {_bytes('ngram')} BETWEEN 1 AND 3 AND frequency >= 2 AND NOT ({_bytes('ngram')} = 1 AND NOT regexp_matches(ngram, '[0-9A-Za-z]'))",
    "rank_combined": f"WITH {VERIFIED} {_ranked('ver', COMBINED, WORD.top_k)}",
    "rank_pmi": f"WITH {VERIFIED} {_ranked('ver', 'score', WORD.top_k)}",
    "word_file": f"WITH {LINES}, {_grams(2)}, {_pmi(2, MIN_FREQ, 'p', 'counts')}, g AS (SELECT ngram, pmi AS exact, CAST(printf('%g', pmi) AS DOUBLE) AS pmi, frequency FROM ({_top('p', TOP_K)})), s AS (SELECT * FROM g WHERE pmi >= {WORD.min_pmi} AND {_bytes('ngram')} BETWEEN 2 AND 20 AND EXISTS (SELECT 1 FROM lines l WHERE contains(l.line, g.ngram)) ORDER BY pmi DESC, exact DESC, frequency DESC, ngram LIMIT 50) SELECT ngram AS word, printf('%.2f', pmi) AS score, frequency, '' AS context FROM s",
    "word_extract_end_to_end": f"WITH RECURSIVE {VERIFIED}, sized AS (SELECT * FROM ver WHERE {_bytes('text')} BETWEEN 2 AND 20 AND score >= 0.5), subs AS ({_SUBSTRINGS.format(t='sized')}), {_overlaps('SELECT * FROM subs')}, good AS (SELECT * FROM solo WHERE NOT ({_bytes('text')} = 1 AND NOT regexp_matches(text, '[0-9A-Za-z]'))) {_ranked('good', COMBINED, WORD.top_k)}",
    "sample_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines ORDER BY md5('{SAMPLE_SEED}:{{' || doc_id || ', ' || line_no || '}}:' || line), doc_id, line_no LIMIT {SAMPLE}",
    "sample_all": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
    "for_each_line": f"WITH {LINES} SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines",
    "observed_counters": f"WITH {LINES} SELECT count(*) AS lines, CAST(sum({_bytes('line')} + 1) AS BIGINT) AS bytes FROM lines",
    "file_scan": f"WITH {LINES} SELECT line, count(*) AS n FROM lines GROUP BY line",
    "file_scan_without_cr": f"WITH {LINES} SELECT line, count(*) AS n FROM lines GROUP BY line",
    "file_scan_in_order": f"WITH {LINES} SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS number, line FROM lines",
    "file_pmi": f"WITH {LINES}, {_grams(2)}, {_pmi(2, MIN_FREQ, 'p', 'counts')} {_top('p', TOP_K)}",
    "whole_file": f"WITH {LINES}, t AS ({_FILE}) SELECT CAST(length(t) AS BIGINT) AS chars, md5(t) AS md5 FROM (SELECT replace(t, chr(13) || chr(10), chr(10)) AS t FROM t)",
    "file_chunks": f"WITH {LINES}, t AS ({_FILE}), h AS (SELECT hex(encode(t)) AS h FROM t), c AS (SELECT unnest(range(0, (len(h) // 2 + {CHUNK_BYTES - 1}) // {CHUNK_BYTES})) AS chunk_no, h FROM h) SELECT chunk_no, CAST(least({CHUNK_BYTES}, len(h) // 2 - chunk_no * {CHUNK_BYTES}) AS BIGINT) AS n_bytes, md5(unhex(substr(h, chunk_no * {2 * CHUNK_BYTES} + 1, {2 * CHUNK_BYTES}))) AS md5 FROM c",
    "score_table": f"WITH {LINES}, {_grams(2)}, {_pmi(2, MIN_FREQ, 'p', 'counts', 14)} SELECT ngram, CAST(printf('%g', pmi) AS DOUBLE) AS pmi, frequency FROM ({_top('p', TOP_K)}) WHERE CAST(printf('%g', pmi) AS DOUBLE) >= {WORD.min_pmi}",
    "dictionary_file": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS text FROM part",
    "normalize_file": f"WITH {LINES}, {_normalized(True)}, f AS (SELECT line, min((doc_id, line_no)) AS p FROM norm GROUP BY line) SELECT row_number() OVER (ORDER BY p) - 1 AS number, line FROM f",
    "normalize_buffer": f"WITH lines AS (SELECT line, (r, item_id, n) AS p, r AS doc_id, item_id * 1000 + n AS line_no FROM (SELECT r, item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark, (SELECT unnest([0, 1]) AS r))), {_normalized(True)}, f AS (SELECT line, min((doc_id, line_no)) AS p FROM norm GROUP BY line) SELECT row_number() OVER (ORDER BY p) - 1 AS number, line, (SELECT count(*) FROM lines) AS rows, (SELECT count(*) FROM f) AS uniques FROM f",
    "pmi_buffer": f"WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark), {_grams(2)}, {_pmi(2, 3, 'p', 'counts', 14)} SELECT ngram, CAST(printf('%g', pmi) AS DOUBLE) AS pmi, frequency FROM ({_top('p', 100)}) WHERE pmi >= 0",
    "line_hash_values": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in HASHES.items()) + ") AS v(line, hash)",
    "functional_words": "SELECT text, text IN ('は', 'が', 'を', 'に', 'で', 'と', 'も', 'の', 'へ', 'や', 'から', 'まで', 'より') OR regexp_matches(text, '(です|ます|ました|でした|ください|ません)$') AS functional FROM (VALUES " + ", ".join(f"('{x}')" for x in FUNCTIONAL) + ") AS v(text)",
    "verify_flags_off": f"WITH {_NAMES} SELECT text, CAST(frequency AS DOUBLE) AS score, frequency, true AS verified, '' AS context, 0.0::DOUBLE AS context_score, 0.0::DOUBLE AS statistical_score FROM names",
    "verify_without_text_check": f"WITH {_NAMES}, {OFFSETS}, occ AS (SELECT n.text, CAST(coalesce(sum((length(d.text) - length(replace(d.text, n.text, ''))) // length(n.text)), 0) AS BIGINT) AS occurrences, min(d.doc_id) AS doc_id, min_by(strpos(d.text, n.text) - 1, d.doc_id) AS place FROM names n LEFT JOIN documents d ON contains(d.text, n.text) GROUP BY n.text), total AS (SELECT max(start + size) AS t FROM offs) SELECT n.text, round(least(1.0::DOUBLE, o.occurrences / 10.0::DOUBLE), 9) AS context_score, round({_STATISTICAL}, 9) AS statistical_score, CAST(CASE WHEN place IS NULL THEN 0 ELSE least(t, place + start + 20) - greatest(0, place + start - 20) END AS BIGINT) AS context_chars FROM names n JOIN occ o USING (text) LEFT JOIN offs f USING (doc_id), total",
    "memory_estimate": f"WITH {VERIFIED} SELECT CAST((SELECT sum({_bytes('text')} + {ROW_BYTES}) FROM cands) + (SELECT sum({_bytes('text')} + {_bytes('context')} + {ROW_BYTES}) FROM ver) AS BIGINT) AS bytes",
    "result_arrays": f"WITH {LINES}, {_grams(2)}, {_pmi(2, MIN_FREQ, 'p', 'counts')} SELECT row_number() OVER (ORDER BY ngram) - 1 AS place, ngram AS word, pmi AS score, frequency FROM ({_top('p', TOP_K)})",
    "line_map": f"WITH {LINES} SELECT doc_id, line_no, '> ' || line AS line FROM lines WHERE line <> ''",
    "batch_map": f"WITH {LINES} SELECT count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines WHERE length(line) > 50",
    "parallel_reduce": f"WITH {LINES} SELECT CAST(max(length(line)) AS BIGINT) AS longest FROM lines",
    "stream_normalize": f"WITH {LINES}, {_normalized(True)} SELECT line, count(*) AS n FROM norm GROUP BY line",
    "stream_dedup": f"WITH {LINES} SELECT DISTINCT line FROM lines",
    "stream_ngram_counts": f"WITH {LINES}, {_grams(2)} SELECT ngram, frequency FROM counts",
    "ngrams_of_lines": f"WITH {LINES} SELECT doc_id, line_no, CAST(greatest(length(line) - 2, 0) AS BIGINT) AS n, CASE WHEN length(line) >= 3 THEN substr(line, 1, 3) END AS first FROM lines",
}
