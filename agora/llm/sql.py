"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Lines within one edit share a half at a known place; Levenshtein's distance decides.
LINES = r"""
WITH lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS k FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents)),
named AS (SELECT doc_id, k, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM lines),
firsts AS (SELECT n, MIN((doc_id, k)) AS f, length(n) AS size FROM named WHERE length(n) >= 20 GROUP BY n),
keys AS (SELECT n, f, unnest([
    concat('p', size, left(n, size // 2)), concat('s', size, right(n, size - size // 2)),
    concat('p', size - 1, left(n, (size - 1) // 2)), concat('s', size - 1, right(n, size - 1 - (size - 1) // 2))]) AS key FROM firsts),
near AS (SELECT DISTINCT a.n FROM keys a JOIN keys b ON a.key = b.key AND a.f > b.f WHERE abs(length(a.n) - length(b.n)) <= 1 AND levenshtein(a.n, b.n) <= 1),
judged AS (SELECT l.doc_id, l.k, l.line, f.n IS NOT NULL AND (f.f <> (l.doc_id, l.k) OR x.n IS NOT NULL) AS goes FROM named l LEFT JOIN firsts f ON f.n = l.n LEFT JOIN near x ON x.n = l.n),
kept AS (SELECT doc_id, COUNT(*) AS lines, COUNT(*) FILTER (goes) AS n_dropped, COALESCE(string_agg(line, chr(10) ORDER BY k) FILTER (NOT goes), '') AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN COALESCE(d.text, '') = '' THEN 0 ELSE k.lines END AS n_lines, k.n_dropped, sha256(k.kept) AS kept_sha256 FROM documents d JOIN kept k ON k.doc_id = d.doc_id"""

WINDOWS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, MIN(doc_id) AS m FROM win GROUP BY h HAVING COUNT(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS pos FROM (SELECT win.doc_id, win.s, unnest(range(0, 50)) AS k FROM win JOIN least ON least.h = win.h WHERE least.m < win.doc_id)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT e.doc_id, COUNT(g.pos) AS n_removed, COALESCE(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS kept FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, COALESCE(k.n_removed, 0) AS n_removed, sha256(COALESCE(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.fit AND b.fit AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, COUNT(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, MIN(b) AS least FROM reach GROUP BY a)
SELECT v.vec_id, COALESCE(n.n_links, 0) AS n_links, LEAST(v.vec_id, COALESCE(c.least, v.vec_id)) AS component_id, v.vec_id <= COALESCE(c.least, v.vec_id) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id"""

PAYLOADS = """
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest, CASE WHEN original < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN original < page_id THEN original END AS refers_to
FROM (SELECT page_id, payload, strlen(payload) AS payload_bytes, CASE WHEN strlen(payload) >= 100 THEN MIN(page_id) OVER (PARTITION BY payload) END AS original FROM (SELECT page_id, COALESCE(html, '') AS payload FROM pages))"""

ORACLE = {"op1_line_dedup": LINES, "op6_substring_dedup": WINDOWS, "op8_embedding_dedup": VECTORS, "op10_warc": PAYLOADS}

#: Level by level: every 8 nodes in a row become one, first in each language, then over the languages' roots.
MERKLE = r"""
WITH RECURSIVE field AS (SELECT doc_id, lang, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
    CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head FROM documents),
leaf AS (SELECT doc_id, lang, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS h,
    sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END)) AS bad FROM field),
bytes AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS t FROM range(256) AS r(i)),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295::UBIGINT AS c FROM leaf WHERE doc_id IS NOT NULL
    UNION ALL SELECT doc_id, s, k + 1, xor(c // 256, b.t) FROM crc JOIN bytes b ON b.i = xor(c % 256, ascii(s[k + 1])::UBIGINT) WHERE k < length(s)),
struck AS (SELECT DISTINCT doc_id FROM crc WHERE k = length(s) AND xor(c, 4294967295::UBIGINT) % 3 = 0),
ranked AS (SELECT doc_id, lang, h, bad, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS n FROM leaf),
tree AS (SELECT lang, 0 AS level, pos, n, h FROM ranked
    UNION ALL SELECT lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8),
sub AS (SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, pos, n, h FROM sub UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 8),
runs AS (SELECT lang, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8),
crowns AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM crown WHERE n > 1 GROUP BY level, pos // 8),
walk AS (SELECT r.doc_id, r.lang, r.h AS leaf, r.pos AS pos, 0 AS level, false AS over, CASE WHEN s.doc_id IS NULL THEN r.h ELSE r.bad END AS node, '' AS proof FROM ranked r LEFT JOIN struck s ON s.doc_id = r.doc_id
    UNION ALL
    SELECT w.doc_id, w.lang, w.leaf, CASE WHEN r.lang IS NULL AND r.hs IS NULL AND NOT w.over THEN u.pos ELSE w.pos // 8 END, CASE WHEN r.hs IS NULL AND NOT w.over THEN 0 ELSE w.level + 1 END, w.over OR r.hs IS NULL,
        CASE WHEN COALESCE(r.hs, c.hs) IS NULL THEN w.node ELSE sha256(concat(array_to_string(COALESCE(r.hs, c.hs)[1 : w.pos % 8], ''), w.node, array_to_string(COALESCE(r.hs, c.hs)[w.pos % 8 + 2 :], ''))) END,
        CASE WHEN COALESCE(r.hs, c.hs) IS NULL THEN w.proof ELSE concat(w.proof, array_to_string(COALESCE(r.hs, c.hs)[1 : w.pos % 8], ''), array_to_string(COALESCE(r.hs, c.hs)[w.pos % 8 + 2 :], '')) END
    FROM walk w LEFT JOIN runs r ON NOT w.over AND r.lang IS NOT DISTINCT FROM w.lang AND r.level = w.level AND r.run = w.pos // 8
    LEFT JOIN crowns c ON w.over AND c.level = w.level AND c.run = w.pos // 8 LEFT JOIN sub u ON u.lang IS NOT DISTINCT FROM w.lang WHERE NOT (w.over AND c.hs IS NULL))
SELECT w.doc_id, w.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.h AS verified
FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang CROSS JOIN (SELECT h FROM crown WHERE n = 1) t CROSS JOIN (SELECT MAX(level) AS level FROM crown) m WHERE w.over AND w.level = m.level"""

ORACLE["op13_merkle_manifest"] = MERKLE

AUDIT = f"""
WITH d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, {WORDS} AS ws FROM documents),
m AS (SELECT d.doc_id, part, COALESCE(l.good, 0) AS good, COALESCE(l.toxic, 0) AS toxic,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), MIN(d.doc_id) OVER (PARTITION BY t) < d.doc_id] AS fails
    FROM d LEFT JOIN (SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
each AS (SELECT part, good, toxic, o, k AS step, fails, o[k] AS own, COALESCE(fails[ascii(o[k]) - 64], false) AS failing, list_filter(range(1, k), lambda j: COALESCE(fails[ascii(o[j]) - 64], false)) <> [] AS gone
    FROM m, orders, range(1, 6) AS s(k)),
sums AS (SELECT part, o AS filter_order, step, own, COUNT(*) FILTER (NOT failing AND NOT gone) AS kept, COUNT(*) FILTER (failing AND NOT gone) AS removed, COUNT(*) FILTER (failing AND gone) AS redundant,
    COUNT(*) FILTER (failing AND len(list_filter(fails, lambda x: COALESCE(x, false))) = 1) AS unique_fails, COUNT(*) FILTER (failing AND NOT gone AND good = 1) AS good_lost, COUNT(*) FILTER (failing AND NOT gone AND toxic = 1) AS toxic_lost
    FROM each GROUP BY part, o, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums"""

ORACLE["op11_filter_audit"] = AUDIT
