"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from .sharding import PRIME, round_keys


def _mixed(value: str, key: str) -> str:
    t = f"(({value} + {key}) % {PRIME})"
    return f"((({t} * {t}) % {PRIME} + {key}) % {PRIME} * {t}) % {PRIME}"


def feistel_sharding(shards: int, seed: int = 20240229) -> str:
    """Ranks by (doc_id, checksum, size), rounds as a fold over the keys, cycle walking as a recursion."""
    keys = round_keys(seed)
    key = f"({keys}::BIGINT[])[i + 1]"
    once = (
        "list_reduce(range({n}), lambda x, i: CASE WHEN i % 2 = 0 THEN ((x // b + {left}) % a) * b + x % b ELSE (x // b) * b + (x % b + {right}) % b END, {x})"
    )
    fill = {"n": len(keys), "left": _mixed("x % b", key), "right": _mixed("x // b", key)}
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
hexed AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_transform(b, lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM hexed, tab),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM summed),
sizes AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a FROM documents)),
walk AS (
  SELECT row_number, {once.format(**fill, x='row_number')} AS p FROM ranked, sizes
  UNION ALL SELECT row_number, {once.format(**fill, x='p')} FROM walk, sizes WHERE p >= n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, (p // {shards})::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, row_number::BIGINT AS row_number
FROM ranked JOIN walk USING (row_number), sizes WHERE p < n
"""


DECONTAMINATION = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(13, len(w)) AS width FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT k, width, array_to_string(w[i:i + width - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM sized)),
placed AS (SELECT r, i, width, array_to_string(w[i:i + width - 1], ' ') AS g FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc, (SELECT DISTINCT width FROM sized) WHERE len(w) >= width)),
found AS (SELECT r, k, i, width FROM placed JOIN windows USING (g, width)),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, width)) AS j FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT k) AS n, string_agg(DISTINCT k, ',' ORDER BY k) AS s FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM p
"""

QUALITY_RULES = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM windows JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 5)) AS j FROM twice) GROUP BY r),
line AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS l FROM doc),
shaped AS (
  SELECT r, host, text, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS f
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM shaped GROUP BY r),
held AS (SELECT host, f, count(DISTINCT text) AS n FROM shaped GROUP BY host, f),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM doc GROUP BY host),
frequent AS (SELECT held.host, f FROM held JOIN hosts ON held.host = hosts.host WHERE held.n > 10 AND 100 * held.n > 2 * hosts.n),
lost AS (SELECT r, sum(shaped.n) AS n FROM shaped JOIN frequent USING (host, f) GROUP BY r),
base AS (
  SELECT r, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM doc LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR (lost > 0 AND (n_words - lost < 10 OR 100 * (n_words - lost) < 50 * n_words))) AS kept
FROM base
"""
