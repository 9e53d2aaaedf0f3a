"""DuckDB statements for the queries that SQL can express."""

_T = "coalesce(text, '')"
_GAP = r"[\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_replace({_T}, '{_GAP}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP1 = r"""
WITH RECURSIVE markup AS (
  SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM pages
), hrefs AS (
  SELECT src, replace(CASE
    WHEN tag ILIKE '<link%' AND list_contains(regexp_split_to_array(lower(trim(regexp_extract(tag, '(?is)\srel\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '"'' ')), '\s+'), 'canonical')
      THEN trim(regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '"'' ')
    WHEN tag ILIKE '<meta%' AND lower(trim(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '"'' ')) = 'refresh'
      THEN trim(regexp_extract(tag, '(?is)url\s*=\s*([^"]*)', 1), '"'' ') END, '&amp;', '&') AS href FROM markup
), links AS (
  SELECT src, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN 'http:' || href
    WHEN starts_with(href, '/') THEN regexp_extract(src, '^[^/?#]*://[^/?#]*') || href
    WHEN starts_with(href, '?') THEN regexp_extract(src, '^[^?#]*') || href
    WHEN regexp_extract(src, '://[^/?#]*([^?#]*)', 1) = '' THEN regexp_extract(src, '^[^/?#]*://[^/?#]*') || '/' || href
    ELSE regexp_replace(regexp_extract(src, '^[^?#]*'), '[^/]*$', '') || href END AS dst
  FROM hrefs WHERE href <> '' AND NOT starts_with(href, '#')
), urls AS (
  SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT dst FROM links)
), parts AS (
  SELECT u, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM urls
), split AS (
  SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM parts
), rules(said, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
ruled AS (
  SELECT u, host, path, CASE WHEN host <> '' THEN host || tail END AS key,
    (SELECT max_by(struct_pack(said := said, rule := rule), length(rule)) FROM rules r
     WHERE ('.' || host) LIKE ('%.' || split_part(r.rule, '/', 1)) AND starts_with(path, substr(r.rule, instr(r.rule, '/')))) AS best FROM split
), edges AS (
  SELECT DISTINCT a.key AS x, b.key AS y FROM links JOIN ruled a ON links.src = a.u JOIN ruled b ON links.dst = b.u WHERE a.key <> b.key
), twoway AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
walk AS (SELECT x, y FROM twoway UNION SELECT w.x, b.y FROM walk w JOIN twoway b ON w.y = b.x),
hit AS (SELECT DISTINCT w.x FROM walk w JOIN ruled r ON w.y = r.key WHERE r.best.said = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule,
  coalesce(best.said, CASE WHEN key IN (SELECT x FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN ruled ON pages.url = ruled.u
"""

OP6 = rf"""
WITH base AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array({_T}, '{_GAP}'), lambda x: x <> ''))::BIGINT AS size,
    (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM base GROUP BY source
), o AS (
  SELECT *, source_size / w AS ratio, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k, sum(source_size) OVER ()::BIGINT AS total FROM s
), r AS (
  SELECT *, total * 150 - coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 200 AS rest,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_w FROM o
), lvl AS (SELECT arg_min(struct_pack(k := k, rest := rest, left_w := left_w), k) AS l FROM r WHERE rest * w <= source_size * 200 * left_w),
t AS (
  SELECT source, source_size, CASE WHEN l IS NULL OR k < l.k THEN (source_size * 2)::DOUBLE ELSE (l.rest * w)::DOUBLE / (l.left_w * 100)::DOUBLE END AS target FROM r, lvl
), weighed AS (SELECT *, floor(sqrt(size::DOUBLE))::BIGINT AS w FROM base),
per AS (SELECT source, w, sum(size)::BIGINT AS words FROM weighed GROUP BY source, w),
lv AS (
  SELECT per.source, w, (target - coalesce(sum(words) OVER (PARTITION BY per.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
    / (sum(words::HUGEINT * w) OVER (PARTITION BY per.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM per JOIN t ON per.source IS NOT DISTINCT FROM t.source WHERE words > 0 AND w > 0
), lam AS (SELECT source, max_by(level, w) AS level FROM lv WHERE level * w <= 2 GROUP BY source),
odds AS (
  SELECT b.*, t.source_size, t.target, least(2.0::DOUBLE, coalesce(level * w, 2.0::DOUBLE)) AS c
  FROM weighed b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN lam ON b.source IS NOT DISTINCT FROM lam.source
), f AS (SELECT *, floor(c + 1e-9::DOUBLE) AS whole, greatest(0.0::DOUBLE, c - floor(c + 1e-9::DOUBLE)) AS p FROM odds),
g AS (SELECT *, target - sum((whole::BIGINT) * size) OVER (PARTITION BY source)::DOUBLE AS budget FROM f),
c AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN sum(CASE WHEN p > 0 THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM g
)
SELECT doc_id, size, source_size, target,
  (whole::BIGINT * size + CASE WHEN budget > 0 AND upto - budget <= budget - (upto - size) THEN size ELSE 0 END)::BIGINT AS taken FROM c
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, {_T} AS t, list_filter(regexp_split_to_array({_T}, '{_GAP}'), lambda x: x <> '') AS w,
    list_filter(string_split({_T}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents
), win AS (SELECT doc_id, unnest(range(len(w) - 7)) AS i, w FROM d WHERE len(w) >= 8),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, range(8) r(k) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_GAP}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
    len(ln)::BIGINT AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS m_symbols, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS m_word_length,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS m_dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS m_repeat,
    coalesce('v' || lang, 'n') AS ln, coalesce('v' || source, 'n') AS sn FROM f
), long AS (
  UNPIVOT (SELECT ln, sn, m_symbols, m_word_length, m_dup_lines, m_repeat FROM m WHERE NOT base_failed)
  ON m_symbols, m_word_length, m_dup_lines, m_repeat INTO NAME measure VALUE x
), g AS (
  SELECT ln, sn, measure, CASE WHEN x < 64 THEN x ELSE x >> (length(bin(x)) - 6) << (length(bin(x)) - 6) END AS v, count(*)::HUGEINT AS n FROM long GROUP BY ALL
), c AS (SELECT measure, v, sum(n)::HUGEINT AS p FROM g GROUP BY ALL), ct AS (SELECT measure, sum(p)::HUGEINT AS t FROM c GROUP BY ALL),
ld AS (SELECT ln, measure, sum(n)::HUGEINT AS docs FROM g GROUP BY ALL), lg AS (SELECT ln, measure, v, sum(n)::HUGEINT AS n FROM g GROUP BY ALL),
l AS (
  SELECT ld.ln, measure, c.v, coalesce(lg.n, 0) * t + 50 * c.p AS p, (ld.docs + 50) * t AS t
  FROM ld JOIN c USING (measure) JOIN ct USING (measure) LEFT JOIN lg USING (ln, measure, v)
), gd AS (SELECT ln, sn, measure, sum(n)::HUGEINT AS docs FROM g GROUP BY ALL),
w AS (
  SELECT ln, gd.sn, measure, l.v, coalesce(g.n, 0) * l.t + 50 * l.p AS n, (gd.docs + 50) * l.t AS t
  FROM gd JOIN l USING (ln, measure) LEFT JOIN g USING (ln, sn, measure, v)
), u AS (SELECT *, sum(n) OVER (PARTITION BY ln, sn, measure ORDER BY v)::HUGEINT AS upto, CASE WHEN measure IN ('m_symbols', 'm_word_length') THEN 900 ELSE 980 END AS tail FROM w),
q AS (
  SELECT ln, sn, measure, min(v) FILTER (upto * 1000 >= t * (1000 - tail)) AS low, min(v) FILTER (upto * 1000 >= t * 500) AS mid, min(v) FILTER (upto * 1000 >= t * tail) AS high FROM u GROUP BY ALL
), fence AS (
  SELECT ln, sn, max(high + 3 * (high - mid)) FILTER (measure = 'm_symbols') AS s, max(high + 3 * (high - mid)) FILTER (measure = 'm_word_length') AS wh,
    max(low - 3 * (mid - low)) FILTER (measure = 'm_word_length') AS wl, max(2 * high - mid) FILTER (measure = 'm_dup_lines') AS dl, max(2 * high - mid) FILTER (measure = 'm_repeat') AS rp
  FROM q GROUP BY ALL
), pick AS (SELECT * FROM m LEFT JOIN fence USING (ln, sn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(greatest(n_symbols - 1, 0) * 1000 // n_words > s OR m_word_length > wh OR m_word_length < wl
    OR (n_lines > 0 AND greatest(n_dup_lines - 1, 0) * 1000 // n_lines > dl) OR greatest(n_repeat_words - 1, 0) * 1000 // n_words > rp, false) AS kept FROM pick
"""

OP5 = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(len(h) // 2 - 49)) AS i, h FROM d WHERE len(h) >= 100),
grams AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM starts),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM grams) WHERE first < doc_id),
runs AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM bad WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ids AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM runs),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM ids GROUP BY doc_id, r),
gaps AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER w, -1) AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN gaps.b = -1 THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (gaps.b - a)) END, '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
tot AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*)::BIGINT AS c FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN tot USING (doc_id)
"""

OP11 = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate({_T}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, row_number() OVER () AS pid, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece),
tok AS (SELECT lang, pid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
word AS (SELECT lang, w, count(*) AS f FROM tok GROUP BY ALL),
near AS (
  SELECT lang, CASE WHEN f >= 100 THEN w END AS w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5
  FROM tok JOIN word USING (lang, w) WINDOW p AS (PARTITION BY pid ORDER BY i)
), c AS (
  SELECT lang, 1 AS d, w AS phrase, f FROM word
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM near GROUP BY ALL HAVING phrase IS NOT NULL AND count(*) >= 100
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM near GROUP BY ALL HAVING phrase IS NOT NULL AND count(*) >= 100
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM near GROUP BY ALL HAVING phrase IS NOT NULL AND count(*) >= 100
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS phrase, count(*) FROM near GROUP BY ALL HAVING phrase IS NOT NULL AND count(*) >= 100
),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE d = 1 GROUP BY lang),
big AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE d > 1),
inner_of AS (SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, f FROM big, range(1, 6) x(i), range(2, 5) y(m) WHERE m < d AND i + m - 1 <= d),
stay AS (SELECT b.* FROM big b WHERE NOT EXISTS (SELECT 1 FROM inner_of s WHERE s.lang = b.lang AND s.phrase = b.phrase AND 100 * s.f >= 100 * b.f)),
cut AS (
  SELECT b.lang, b.phrase, b.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * b.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM stay b JOIN total t ON b.lang = t.lang, range(1, 5) z(k)
  JOIN c l ON l.lang = b.lang AND l.phrase = array_to_string(b.ws[1:k], ' ') JOIN c r ON r.lang = b.lang AND r.phrase = array_to_string(b.ws[k + 1:], ' ') WHERE k < b.d
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked WHERE rank <= 2000
"""

OP12 = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, list(struct_pack(role, text) ORDER BY k) AS v FROM t GROUP BY c),
crc AS (
  SELECT c, v, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ascii(x) >> j) & 1 for j in range(8)] for x in string_split(c::VARCHAR, '')])),
    lambda a, bit: xor(a >> 1, 3988292384::BIGINT * (xor(a, bit) & 1))), 4294967295::BIGINT) % 6 AS h FROM own
), whole AS (SELECT a.c, coalesce(b.v[:h], []) || a.v[h + 1:] AS v FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 100),
member AS (SELECT c, d, v[:d] AS k, v[d].text AS last, d = len(v) AS ends FROM (SELECT c, v, unnest(range(len(v) + 1)) AS d FROM whole)),
node AS (
  SELECT k, d, min(c) AS c, count(*) AS n, count(*) - 1 AS more, coalesce(any_value(length(last)), 0) AS size,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS sha FROM member GROUP BY k, d
), child AS (SELECT k[:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
above AS (SELECT k[:j] AS k, n_children = 0 AS leaf, more * size AS saves FROM full_node, range(0, 1000) r(j) WHERE j <= d),
sums AS (SELECT k, count_if(leaf) AS n_leaves, sum(saves)::BIGINT AS saved FROM above GROUP BY k)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.n_children, n_leaves::BIGINT AS n_leaves, saved AS saved_tokens, a.sha AS ends_sha256
FROM full_node a JOIN sums USING (k) LEFT JOIN node p ON a.d > 0 AND p.k = a.k[:a.d - 1]
"""

ORACLES = {"op1_url_filters": OP1, "op11_collocations": OP11, "op12_prefix_trie": OP12, "op3_exact_dedup": OP3, "op5_suffix_dedup": OP5, "op6_mixing": OP6, "op9_quality_rules": OP9}
