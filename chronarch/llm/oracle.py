"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(pattern: str, text: str = "coalesce(text, '')", lower: bool = False) -> str:
    return pattern.format(_LOWER.format(text) if lower else text)


def _crc32(text: str) -> str:
    """crc32 of a text's bytes, unsigned: DuckDB has none, so its bytes are folded over the checksum's table."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(str(c))
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    fold = f"lambda c, b: xor(c >> 8, [{', '.join(table)}][(xor(c, b) & 255) + 1]::BIGINT)"
    return f"xor(list_reduce({each}, {fold}, 4294967295::BIGINT), 4294967295::BIGINT)"


BYTE_SHARDS = f"""
WITH docs AS (SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
placed AS (
  SELECT *, row_number() OVER ordered AS place, sum(size) OVER (ordered ROWS UNBOUNDED PRECEDING)::HUGEINT AS until, sum(size) OVER ()::HUGEINT AS total
  FROM docs WINDOW ordered AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
cuts AS (SELECT *, least(39, (2 * until - size) * 40 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cuts
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words(_WORDS, lower=True)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM docs),
classed AS (
  SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id,
    CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS class_size
  FROM sets),
grams AS (SELECT doc_id AS c, len(s) AS n, unnest(s) AS g FROM sets WHERE doc_id IN (SELECT class_id FROM classed)),
links AS MATERIALIZED (
  SELECT x.c AS a, y.c AS b FROM grams x JOIN grams y ON x.g = y.g AND x.c < y.c AND 90 * greatest(x.n, y.n) <= 100 * least(x.n, y.n)
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, c.class_id, c.class_size::BIGINT AS class_size, least(c.class_id, coalesce(l.b, c.class_id)) AS component_id
FROM classed c LEFT JOIN least l ON l.a = c.class_id
"""



def _address(t: str, s: str) -> str:
    """The address that t means on the page s."""
    own, root, path = f"regexp_extract({t}, '(?s)^[^?#]*')", f"regexp_extract({s}, '(?s)^.*?://[^/?#]*')", f"regexp_extract({s}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    whole = f"CASE WHEN {t} LIKE '/%' THEN {own} WHEN {path} = '' THEN '/' || {own} ELSE regexp_extract({path}, '(?s)^.*/') || {own} END"
    steps = f"list_transform(string_split(substr({whole}, 2), '/'), lambda x: [x])"
    folded = f"list_reduce({steps}, lambda a, x: CASE x[1] WHEN '..' THEN a[:len(a) - 1] WHEN '.' THEN a ELSE a || x END, []::VARCHAR[])"
    last = f"CASE WHEN regexp_matches({own}, '(^|/)[.][.]?$') AND len({folded}) > 0 THEN '/' ELSE '' END"
    return f"""CASE WHEN regexp_matches({t}, '^[^/?#]*://') THEN {t}
    WHEN {t} LIKE '//%' THEN regexp_extract({s}, '(?s)^(.*?:)//', 1) || {t}
    WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN {t} LIKE '#%' THEN regexp_extract({s}, '(?s)^[^#]*') || {t}
    WHEN {t} LIKE '?%' THEN {root} || {path} || {t}
    ELSE {root} || '/' || array_to_string({folded}, '/') || {last} || substr({t}, length({own}) + 1) END"""


_TEXTUAL = "".join(rf"|<{e}(?:[\s/][^>]*)?>.*?(?:</{e}(?:[\s/][^>]*)?>|\z)" for e in ("script", "style", "textarea", "title"))
URL_REDIRECTS = rf"""
WITH RECURSIVE forms(p) AS (VALUES
  ('(?is)<link\b[^>]*?[\s\"'']rel\s*=\s*["'']?canonical\b[^>]*?[\s\"'']href\s*=\s*["'']?([^"''\s>]+)'),
  ('(?is)<link\b[^>]*?[\s\"'']href\s*=\s*["'']?([^"''\s>]+)[^>]*?[\s\"'']rel\s*=\s*["'']?canonical\b'),
  ('(?is)<meta\b[^>]*?[\s\"'']http-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)'),
  ('(?is)<meta\b[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)[^>]*?[\s\"'']http-equiv\s*=\s*["'']?refresh\b')),
rules(host, path, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
seen AS (SELECT DISTINCT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z){_TEXTUAL}', '', 'g') AS h FROM pages WHERE contains(url, '://')),
found AS (
  SELECT DISTINCT url, replace(unnest(regexp_extract_all(h, p, 1)), '&amp;', '&') AS t,
    replace(nullif(regexp_extract(h, '(?is)<base\b[^>]*?[\s\"'']href\s*=\s*["'']?([^"''\s>]+)', 1), ''), '&amp;', '&') AS base FROM seen, forms),
based AS (SELECT url, t, coalesce(CASE WHEN base IS NOT NULL THEN {_address("base", "url")} END, url) AS b FROM found),
linked AS (SELECT url AS s, {_address("t", "b")} AS t FROM based),
ends AS (SELECT DISTINCT unnest([s, t]) AS u FROM linked WHERE t IS NOT NULL UNION SELECT url FROM pages WHERE url IS NOT NULL),
node_of AS (
  SELECT u, {_LOWER.format("regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1)")} || substr(regexp_extract(u, '(?s)^([^#]*)', 1), length(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS node FROM ends),
edges AS MATERIALIZED (
  SELECT DISTINCT x.node AS a, y.node AS b FROM linked JOIN node_of x ON x.u = s JOIN node_of y ON y.u = t WHERE x.node <> y.node),
both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (SELECT u FROM ends UNION SELECT node FROM node_of),
parts AS (
  SELECT u, {_LOWER.format("regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
ruled AS (
  SELECT p.u, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts p
  LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY p.u, p.host, p.path),
blocked AS (SELECT DISTINCT r.a AS node FROM reach r JOIN ruled x ON x.u = r.b WHERE x.verdict = 'block')
SELECT page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
  coalesce(r.verdict, CASE WHEN b.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN ruled r ON r.u = url LEFT JOIN node_of n ON n.u = url LEFT JOIN blocked b ON b.node = n.node
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_words(_ALNUM, lower=True)} AS w FROM documents),
items AS (SELECT item_id, {_words(_ALNUM, lower=True)} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0),
found AS MATERIALIZED (
  SELECT d.doc_id, d.i, l.k, x.item_id FROM (SELECT DISTINCT k FROM windows) l
  JOIN (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs) d ON d.i + l.k - 1 <= len(d.w)
  JOIN windows x ON x.k = l.k AND x.p = array_to_string(d.w[d.i:d.i + l.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM found WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.names, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

LINE_FREQUENCY = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, source IS NULL AS no_host, {_words(_WORDS)} AS w FROM documents),
lines AS (SELECT doc_id, text, host, no_host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
worded AS MATERIALIZED (
  SELECT *, {_words(_WORDS, "line")} AS w, translate({_LOWER.format("array_to_string(" + _words(_WORDS, "line") + ", ' ')")}, '123456789', '000000000') AS plain
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
again AS (SELECT doc_id, sum(n - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS n FROM worded GROUP BY ALL) GROUP BY doc_id),
common AS (SELECT host, no_host, plain FROM worded GROUP BY ALL HAVING count(DISTINCT doc_id) > 50),
lost AS (SELECT doc_id, sum(len(w)) AS n FROM worded SEMI JOIN common USING (host, no_host, plain) GROUP BY doc_id),
windows AS MATERIALIZED (SELECT doc_id, i, w[i:i + 4] AS p FROM docs, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT doc_id, p FROM windows GROUP BY ALL HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM windows SEMI JOIN twice USING (doc_id, p)) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed, coalesce(l.n, 0) AS lost
  FROM docs LEFT JOIN again USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT * EXCLUDE lost, NOT base_failed AND n_words - lost >= 10 AND 2 * (n_words - lost) >= n_words AS kept FROM base
"""

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_words(_WORDS)} AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS p FROM docs, unnest(range(1, len(w) - 33)) AS u(i)),
twice AS (SELECT p FROM windows GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN twice USING (p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
drawn AS (SELECT *, len(t) AS n, [('0x' || s[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM docs),
placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

COLLOCATIONS = rf"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS sizes(k)) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM grams WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, n, j, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c JOIN totals USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM grams g WHERE g.lang = c.lang AND g.k > c.k AND g.f >= c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": NGRAM_JACCARD,
    "op2_byte_shards": BYTE_SHARDS,
    "op3_url_redirects": URL_REDIRECTS,
    "op8_decontamination": DECONTAMINATION,
    "op9_line_frequency": LINE_FREQUENCY,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_collocations": COLLOCATIONS,
}
