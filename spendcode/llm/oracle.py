"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op3_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest, body,
             max(page_id) OVER (PARTITION BY body) AS top FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again,
             87 + payload_bytes + 8 * (payload_bytes // 4096)
             + CASE WHEN payload_bytes % 4096 > 0 THEN 4 + length(to_hex(payload_bytes % 4096)) ELSE 0 END + 5 AS block FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to,
       CASE WHEN again OR block <= 16384 THEN 1 ELSE CAST(ceil(block / 16384.0) AS INT) END AS segments, 'ok' AS status
FROM r
"""

ORACLE["op4_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

ORACLE["op6_url_filter"] = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, q, verdict)),
m AS (SELECT p.page_id, p.host, p.path, max_by({'rule': h || q, 'verdict': verdict}, length(h || q)) FILTER (WHERE h IS NOT NULL) AS best
      FROM p LEFT JOIN v ON (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, q)
      GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""

ORACLE["op7_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, n, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
s AS (SELECT ws, min({'doc_id': doc_id, 'n': n}) AS first, row_number() OVER () AS id FROM w WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT id, first, len(ws) AS size, unnest(ws) AS word FROM s),
f AS (SELECT word, count(*) AS c FROM t GROUP BY word),
r AS (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY c, word) AS pos FROM t JOIN f USING (word)),
p AS (SELECT * FROM r WHERE pos <= size - ceil(0.8 * size - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (word)
      WHERE a.first < b.first AND a.size >= 0.8 * b.size - 1e-9 AND b.size >= 0.8 * a.size - 1e-9),
g AS (SELECT DISTINCT c.b AS id FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b
      WHERE len(list_intersect(x.ws, y.ws)) >= 0.8 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) - 1e-9),
k AS (SELECT w.doc_id, w.n, len(w.ws) > 0 AND (g.id IS NOT NULL OR s.first <> {'doc_id': w.doc_id, 'n': w.n}) AS gone
      FROM w LEFT JOIN s ON s.ws = w.ws LEFT JOIN g ON g.id = s.id)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE gone) AS lines_removed
FROM l JOIN k ON k.doc_id = l.doc_id AND k.n = l.n GROUP BY l.doc_id
"""

ORACLE["op8_license_scan"] = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by') AS a,
             list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS b,
             list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved') AS c FROM w),
t AS (SELECT label, list_distinct(string_split(words, ' ')) AS ts, CAST(ceil(least * len(list_distinct(string_split(words, ' '))) - 1e-9) AS INT) AS need,
             CASE WHEN least = 1 THEN 1 ELSE len(string_split(words, ' ')) END AS stride,
             CASE WHEN least = 1 THEN len(string_split(words, ' ')) + 2 ELSE 2 * len(string_split(words, ' ')) END AS span, without
      FROM (VALUES @TEMPLATES@) AS v(label, words, least, without)),
k AS (SELECT rid, ws, t.*, unnest(range(0, len(ws), stride)) AS start FROM w JOIN t ON len(list_intersect(ws, ts)) >= need),
g AS (SELECT rid, label, ts, need, without, ws[start + 1:start + span] AS block FROM k),
m AS (SELECT rid, list(DISTINCT label) AS labels, max(len(list_intersect(block, ts)) / len(ts)) AS share
      FROM g WHERE len(list_intersect(block, ts)) >= need AND NOT list_has_any(block, without) GROUP BY rid),
o AS (SELECT rid, doc_id, len(ws) AS n_words, list_concat(list_concat(a, b), c) AS places,
             list_filter(['cc-by', 'gpl', 'reserved'], lambda x: (x = 'cc-by' AND len(a) > 0) OR (x = 'gpl' AND len(b) > 0) OR (x = 'reserved' AND len(c) > 0)) AS base FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM o LEFT JOIN m USING (rid)
"""

ORACLE["op11_merkle_manifest"] = r"""
WITH RECURSIVE
c AS (SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
                 lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc FROM documents),
v AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0
             THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2 FROM c),
s AS (SELECT doc_id, source, @FIELDS@ AS head, text, text2 FROM v),
l AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(octet_length(encode(text2)) || ':' || text2, '-')) AS leaf2 FROM s),
i AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM i
      UNION ALL
      SELECT tree, lvl + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY tree, lvl, idx // 16),
u AS (SELECT 100 AS lvl, tree - 1 AS idx, count(*) OVER () AS n, h FROM t WHERE n = 1
      UNION ALL
      SELECT lvl + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 16),
p AS (SELECT i.tree, i.idx, t.lvl,
             coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx < i.idx // CAST(16 ** t.lvl AS BIGINT)), '') AS a,
             coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx > i.idx // CAST(16 ** t.lvl AS BIGINT)), '') AS b
      FROM i JOIN t ON t.tree = i.tree AND t.n > 1 AND t.idx // 16 = i.idx // CAST(16 ** (t.lvl + 1) AS BIGINT) GROUP BY ALL
      UNION ALL
      SELECT i.tree, i.idx, u.lvl,
             coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx < (i.tree - 1) // CAST(16 ** (u.lvl - 100) AS BIGINT)), ''),
             coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx > (i.tree - 1) // CAST(16 ** (u.lvl - 100) AS BIGINT)), '')
      FROM i JOIN u ON u.n > 1 AND u.idx // 16 = (i.tree - 1) // CAST(16 ** (u.lvl - 99) AS BIGINT) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY tree, idx ORDER BY lvl) AS step FROM p),
f AS (SELECT tree, idx, 0::BIGINT AS step, CASE WHEN leaf2 <> leaf THEN leaf2 ELSE leaf END AS h FROM i
      UNION ALL
      SELECT f.tree, f.idx, q.step, sha256(q.a || f.h || q.b) FROM f JOIN q ON q.tree = f.tree AND q.idx = f.idx AND q.step = f.step + 1),
e AS (SELECT tree, idx, max_by(h, step) AS folded_root FROM f GROUP BY tree, idx),
w AS (SELECT tree, idx, sha256(string_agg(a || b, '' ORDER BY lvl)) AS proof FROM p GROUP BY tree, idx),
r AS (SELECT h AS root FROM u WHERE n = 1),
z AS (SELECT tree, h AS subroot FROM t WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM i JOIN z USING (tree) JOIN e USING (tree, idx) LEFT JOIN w USING (tree, idx) CROSS JOIN r
""".replace("@FIELDS@", " || ".join(
    f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars")))

ORACLE["op12_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
s AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS c FROM s),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN (@STOP@))) AS n_stop_words,
             len(list_filter(ws, lambda x: upper(x) <> lower(x))) AS n_letter_words,
             len(list_filter(ws, lambda x: upper(x) <> lower(x) AND upper(x) = x AND length(x) > 1)) AS n_capital_words,
             len(list_filter(ls, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: ends_with(rtrim(x), '...'))) AS n_cut_lines
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, concat_ws(',', CASE WHEN n_words < 50 THEN 'too_short' END, CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repetitive' END,
             CASE WHEN 100 * word_chars NOT BETWEEN 300 * n_words AND 1000 * n_words THEN 'word_length' END,
             CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END, CASE WHEN 100 * n_stop_words < 4 * n_words THEN 'stop_words' END,
             CASE WHEN 100 * n_letter_words < 80 * n_words THEN 'wordless' END, CASE WHEN 100 * n_capital_words > 30 * n_words THEN 'capitals' END,
             CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 'same_lines' END, CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullets' END,
             CASE WHEN 100 * n_cut_lines > 30 * n_lines THEN 'cut_lines' END) AS failed FROM m)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = '' AS kept FROM f
"""


def _stop_words() -> str:
    from spendcode.llm.quality_rules import STOP_WORDS
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


ORACLE["op12_quality_rules"] = ORACLE["op12_quality_rules"].replace("@STOP@", _stop_words())

ORACLE["op13_lexical_search"] = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM w WHERE len(ws) > 0),
p AS (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS term FROM w),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
i AS (SELECT rid, doc_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact
      FROM f JOIN d USING (term), g WHERE term IN (SELECT term FROM q)),
s AS (SELECT item_id, rid, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _templates() -> str:
    from spendcode.llm.license_scan import TEMPLATES
    return ", ".join(f"('{t.label}', '{t.text}', {t.threshold}, [{', '.join(repr(w) for w in t.without) or 'CAST(NULL AS VARCHAR)'}])" for t in TEMPLATES)


ORACLE["op8_license_scan"] = ORACLE["op8_license_scan"].replace("@TEMPLATES@", _templates())
