"""SQL of those registered queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import quality, quoting

_WORD = r"[^\x20\x09-\x0D]+"

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages), d AS (SELECT *, upper(sha1(h)) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d"""

QUALITY = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM t),
 pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3), win AS (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM pos),
 rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS m FROM win) JOIN (SELECT unnest([0, 1, 2]) AS k) ON m > 1 GROUP BY doc_id),
 li AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
 base AS (SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(li.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN li USING (doc_id) LEFT JOIN rep USING (doc_id)),
 tk AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([!-/:-@\[-`{{-~]+)', ' \1 ', 'g'), '{_WORD}') AS k FROM t),
 tp AS (SELECT doc_id, unnest(k) AS tok, generate_subscripts(k, 1) AS p FROM tk),
 crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
 words AS (SELECT tok, hex(encode(tok)) AS hx, strlen(tok) AS n FROM (SELECT DISTINCT tok FROM tp)),
 crc AS (SELECT tok, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(hx, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS c FROM words, crc_table),
 tc AS (SELECT doc_id, p, c FROM tp JOIN crc USING (tok)),
 grams AS (SELECT doc_id, c % {quality.BUCKETS} AS bucket FROM tc UNION ALL SELECT y.doc_id, (x.c * 31 + y.c + 1) % {quality.BUCKETS} FROM tc x JOIN tc y ON y.doc_id = x.doc_id AND y.p = x.p + 1),
 cnt AS (SELECT bucket, count(*) AS raw, sum((doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT) AS target FROM grams GROUP BY bucket), tot AS (SELECT sum(raw) AS r, sum(target) AS t FROM cnt),
 ratio AS (SELECT bucket, CASE WHEN t > 0 THEN round(ln(((target + {quality.SMOOTHING}) / (t + {quality.SMOOTHING * quality.BUCKETS}))::DOUBLE / ((raw + {quality.SMOOTHING}) / (r + {quality.SMOOTHING * quality.BUCKETS}))::DOUBLE) * 1e6)::BIGINT ELSE 0 END AS v FROM cnt, tot),
 sc AS (SELECT doc_id, count(*) AS n_grams, sum(v)::BIGINT AS llr FROM grams JOIN ratio USING (bucket) GROUP BY doc_id),
 f AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND coalesce(llr, 0) >= {quality.THRESHOLD} * coalesce(n_grams, 0) AS kept, coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(llr, 0) AS llr FROM f LEFT JOIN sc USING (doc_id)"""

_BLANK = r"[ \t\n\x0B\f\r]"

QUOTES = rf"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS line FROM conversations),
 e AS (SELECT rid, conv_id, turn, role, unnest(line) AS x, generate_subscripts(line, 1) AS i FROM m),
 d AS (SELECT *, length(regexp_extract(x, '^[ \t>]*')) - length(replace(regexp_extract(x, '^[ \t>]*'), '>', '')) AS lv, trim(regexp_replace(lower(regexp_replace(x, '^[ \t]*>[ \t>]*', '')), '{_BLANK}+', ' ', 'g')) AS u FROM e),
 n AS (SELECT *, lead(lv) OVER w AS lv1, lead(lv, 2) OVER w AS lv2, lead(x) OVER w AS x1, lag(lv) OVER w AS lv0 FROM d WINDOW w AS (PARTITION BY rid ORDER BY i)),
 k AS (SELECT *, lv = 0 AND NOT (regexp_matches(x, '{quoting.ANNOUNCED}') AND (coalesce(lv1, 0) > 0 OR coalesce(regexp_matches(x1, '^{_BLANK}*$') AND lv2 > 0, false))) AS keep, sum((lv0 IS DISTINCT FROM lv)::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM n),
 b AS (SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role, trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (keep), '')) AS body FROM k GROUP BY rid),
 bu AS (SELECT conv_id, turn, u FROM k WHERE keep AND u <> '' UNION SELECT any_value(conv_id), any_value(turn), string_agg(u, ' ' ORDER BY i) FROM k WHERE keep AND u <> '' GROUP BY rid),
 held AS (SELECT * FROM bu WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
 p AS (SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(lv) AS lv, string_agg(x, chr(10) ORDER BY i) AS raw, list(u ORDER BY i) AS us FROM k WHERE lv > 0 GROUP BY rid, run),
 pd AS (SELECT DISTINCT * FROM p),
 q AS (SELECT DISTINCT rid, conv_id, turn, lv, raw, unnest(list_append(us, array_to_string(list_filter(us, lambda v: v <> ''), ' '))) AS u FROM pd),
 near AS (SELECT conv_id, u, min(turn) AS here FROM held GROUP BY ALL), far AS (SELECT u, min(ROW(conv_id, turn)) AS there FROM held GROUP BY u),
 t AS (SELECT q.*, CASE WHEN here < turn THEN ROW(q.conv_id, here) WHEN there < ROW(q.conv_id, turn) AND q.conv_id IS NOT NULL AND turn IS NOT NULL THEN there END AS target FROM q LEFT JOIN near ON near.conv_id = q.conv_id AND near.u = q.u LEFT JOIN far ON far.u = q.u WHERE q.u <> ''),
 c AS (SELECT rid, max(lv) AS n_levels, count(*) AS n_passages, sum(found) AS n_linked FROM (SELECT rid, lv, raw, max((target IS NOT NULL)::INT) AS found FROM t GROUP BY ALL) GROUP BY rid),
 v AS (SELECT rid, conv_id, turn, target, sum(length(u)) AS w FROM t WHERE lv = 1 AND target IS NOT NULL GROUP BY ALL),
 best AS (SELECT conv_id, turn, target FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY w DESC, target) AS r FROM v) WHERE r = 1),
 par AS (SELECT conv_id, turn, min(target) AS parent FROM best GROUP BY ALL),
 seen AS (SELECT DISTINCT conv_id, turn FROM b WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
 prev AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM seen),
 up AS (SELECT s.conv_id, s.turn, coalesce(struct_extract(parent, 1), CASE WHEN last IS NOT NULL THEN s.conv_id END) AS pc, coalesce(struct_extract(parent, 2), last) AS pt FROM prev s LEFT JOIN par USING (conv_id, turn)),
 th AS (SELECT conv_id, turn, conv_id AS rc, turn AS rt, 0::BIGINT AS depth FROM up WHERE pc IS NULL UNION ALL SELECT up.conv_id, up.turn, rc, rt, depth + 1 FROM th JOIN up ON up.pc = th.conv_id AND up.pt = th.turn),
 o AS (SELECT b.*, coalesce(n_levels, 0)::BIGINT AS n_levels, coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_linked, 0)::BIGINT AS n_linked, pc, pt, coalesce(rc, b.conv_id) AS rc, coalesce(rt, b.turn) AS rt, coalesce(depth, 0) AS depth
  FROM b LEFT JOIN c USING (rid) LEFT JOIN up ON up.conv_id = b.conv_id AND up.turn = b.turn LEFT JOIN th ON th.conv_id = b.conv_id AND th.turn = b.turn),
 pos AS (SELECT *, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY rc, rt ORDER BY depth, conv_id, turn, md5(coalesce(role, '') || chr(10) || body)) END AS position FROM o)
SELECT rc AS root_conv, rt AS root_turn, (position - 1) // {quoting.PART} AS part, position, conv_id, turn, role, body, n_levels, n_passages, n_linked, pc AS parent_conv, pt AS parent_turn, depth FROM pos"""

LINES = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM t),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
 d AS (SELECT k.*, s.key IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

SPELLING = r"""WITH RECURSIVE run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
 crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
 hx AS (SELECT doc_id, w, n, hex(encode(doc_id || ':' || w)) AS x FROM run),
 hs AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM hx, crc_table),
 v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS word, n FROM hs) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
 del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
 near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, v.word, v.n FROM del a JOIN v ON v.word = a.rest UNION SELECT v.word, a.word, a.n FROM del a JOIN v ON v.word = a.rest),
 best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
 r AS (SELECT word, form, word AS at FROM f UNION ALL SELECT r.word, f.form, f.word FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL"""

PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
 g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
 f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, size, phrase HAVING count(*) >= 30),
 c AS (SELECT lang, phrase, ws, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
 s AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (a::HUGEINT * 2000000) // (x.f + y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1 : ], ' ')),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
 part AS (SELECT lang, f, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < size),
 longer AS (SELECT lang, phrase, max(f) AS f FROM part GROUP BY ALL),
 kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN tot USING (lang) WHERE rank <= 2000"""
