"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(ws[i:i + 9], ' ') AS s, least(10, len(ws)) AS n FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT DISTINCT n FROM bw) k, d, unnest(range(1, len(ws) - n + 2)) t(i)),
o AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op2_lm_scoring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
           doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS tg FROM documents),
t AS (SELECT doc_id, tg::INT AS tg, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM d, unnest(range(1, len(ws) + 1)) u(i)),
c AS (SELECT w, count(*) AS a, sum(tg) AS g FROM t GROUP BY w), p AS (SELECT v, w, count(*) AS a, sum(tg) AS g FROM t WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) > 1),
n AS (SELECT count(*) FILTER (a > 1) AS v, sum(a) AS na, sum(g) AS ng, coalesce(sum(a) FILTER (a = 1), 0) AS ua, coalesce(sum(g) FILTER (a = 1), 0) AS ug FROM c),
k AS (SELECT * FROM c WHERE a > 1),
x AS (SELECT doc_id, t.v IS NOT NULL AS inner_, (coalesce(k.a, ua) + 0.1::DOUBLE) / (na + 0.1::DOUBLE * (n.v + 1)) AS pa, (coalesce(k.g, ug) + 0.1::DOUBLE) / (ng + 0.1::DOUBLE * (n.v + 1)) AS pg,
      coalesce(kv.a, 0) AS ca, coalesce(kv.g, 0) AS cg, coalesce(p.a, 0) AS pca, coalesce(p.g, 0) AS pcg
      FROM t CROSS JOIN n LEFT JOIN k ON k.w = t.w LEFT JOIN k kv ON kv.w = t.v LEFT JOIN p ON p.v = t.v AND p.w = t.w),
y AS (SELECT doc_id, avg(-ln(CASE WHEN ca > 0 THEN 0.4::DOUBLE * pa + 0.6::DOUBLE * pca / ca ELSE pa END)) AS la, avg(-ln(CASE WHEN cg > 0 THEN 0.4::DOUBLE * pg + 0.6::DOUBLE * pcg / cg ELSE pg END)) AS lt FROM x GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_tokens, round(lt, 6) AS loss_target, round(la, 6) AS loss_background, round(lt - la, 6) AS score FROM d LEFT JOIN y USING (doc_id)""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(ws) - 18)) t(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
gone AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(ws[j], ' ' ORDER BY j) AS t FROM d, unnest(range(1, len(ws) + 1)) x(j)
         WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.p = j) GROUP BY d.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_preference_format": r"""
WITH a AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT a.conv_id, a.l, o.l.text AS other FROM a JOIN a o ON o.conv_id = xor(a.conv_id, 1::BIGINT)),
c AS (SELECT conv_id, turn, role AS r, text AS x, CASE WHEN turn = l.turn AND role = 'assistant' AND text = l.text THEN other ELSE text END AS y
      FROM conversations JOIN b USING (conv_id) WHERE turn <= l.turn),
d AS (SELECT conv_id, list({'t': turn, 'r': r, 'x': x} ORDER BY turn, r, x) AS c, list({'t': turn, 'r': r, 'x': y} ORDER BY turn, r, y) AS r FROM c GROUP BY conv_id),
e AS (SELECT *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i].r <> r[i].r OR c[i].x <> r[i].x)) - 1, len(c)) AS n FROM d),
f AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM e)
SELECT conv_id AS pair_id, CAST(n AS INT) AS prompt_turns, coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.r || '|>' || chr(10) || t.x || '<|end|>' || chr(10)), ''), '') AS prompt,
  CAST(len(c) AS INT) AS chosen_turns, coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.r || '|>' || chr(10) || t.x || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(list_filter(list_transform(range(1, len(c) + 1), lambda i: {'r': c[i].r, 'e': list_sum(list_transform(c[1:i], lambda t: length(t.r) + length(t.x) + 13)), 'x': length(c[i].x)}), lambda z: z.r = 'assistant'),
    lambda z: (z.e - z.x - 8) || ':' || z.e), ','), '') AS chosen_mask,
  CAST(len(r) AS INT) AS rejected_turns, coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.r || '|>' || chr(10) || t.x || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(list_transform(range(1, len(r) + 1), lambda i: {'r': r[i].r, 'e': list_sum(list_transform(r[1:i], lambda t: length(t.r) + length(t.x) + 13)), 'x': length(r[i].x)}), lambda z: z.r = 'assistant'),
    lambda z: (z.e - z.x - 8) || ':' || z.e), ','), '') AS rejected_mask FROM f""",
    "op10_source_mixing": r"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
      -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / (CASE q WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.5 ELSE 0.75 END) AS key
      FROM documents LEFT JOIN l USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS sz, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * sz AS cap, row_number() OVER u AS rn,
      sum(sz) OVER () - coalesce(sum(3 * sz) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
      sum(w) OVER () - coalesce(sum(w) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
      FROM s WINDOW u AS (ORDER BY 3 * sz / w, source NULLS LAST)),
f AS (SELECT lft, ws FROM o WHERE cap * ws > w * lft ORDER BY rn LIMIT 1),
t AS (SELECT source, sz, coalesce(least((f.lft * w)::DOUBLE / f.ws::DOUBLE, cap::DOUBLE), cap::DOUBLE) AS target FROM o LEFT JOIN f ON true),
p AS (SELECT d.*, sz, target, CASE WHEN sz > 0 THEN floor(target / sz) ELSE 0 END AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS mid FROM p)
SELECT doc_id, source, size::BIGINT AS size, sz AS source_size, target,
       (size * (e + CASE WHEN mid <= target - e * sz THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
}



def _quality() -> str:
    from .quality_rules import STOP_WORDS

    stop = ", ".join(repr(w) for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM d, unnest(range(1, len(ws) - 1)) u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g),
p AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop, len(ls) AS n_lines,
      length(t) - length(replace(t, '!', '')) AS n_ex, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_list FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0 OR n_symbols / n_words > 0.3 OR n_ex / n_words > 0.5
  OR n_stop / n_words < 0.02 OR n_dup_lines / n_lines > 0.3 OR n_list / n_lines > 0.9) AS kept FROM b"""


SQL["op7_quality_rules"] = _quality()


def _urls() -> str:
    """Rules, then the same penalised logistic regression, reached by gradient steps on the labelled urls' kernel."""
    from .url_filters import ALLOWED, BLOCKED, BUCKETS, PENALTY, RULES, SIZES

    table = ", ".join(f"({u!r}, {label})" for label, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls.split())
    rules = ", ".join(f"({v!r}, {r!r}, {r.partition('/')[0]!r}, {'/' + r.partition('/')[2]!r})" for v, r in RULES)
    grams = lambda c, mark: " || ".join(f"CASE WHEN {c} = '' THEN [] ELSE list_transform(range(1, length({c}) + {4 - n}), lambda i: '{mark}' || substr('^' || {c} || '$', i, {n})) END" for n in SIZES)
    parts = "SELECT *, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path"
    buckets = f"list_distinct(list_transform({grams('host', 'h')} || {grams('path', 'p')}, lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % {BUCKETS}))"
    pace = 3
    return rf"""
WITH RECURSIVE lu(url, y) AS (VALUES {table}), rule(verdict, rule, h, p) AS (VALUES {rules}),
l AS (SELECT row_number() OVER () AS i, y, {buckets} AS b FROM ({parts} FROM lu)),
k AS (SELECT x.i, list(len(list_intersect(x.b, z.b)) / sqrt(len(x.b) * len(z.b)) ORDER BY z.i) AS r FROM l x, l z GROUP BY x.i),
m AS (SELECT list(r ORDER BY i) AS k, (SELECT list(y ORDER BY i) FROM l) AS y, count(*)::DOUBLE AS n FROM k),
s AS (SELECT 0 AS t, list_transform(y, lambda q: 0::DOUBLE) AS a, 0::DOUBLE AS c FROM m UNION ALL
  SELECT t + 1, list_transform(range(1, len(a) + 1), lambda i: (1 - {pace} * {PENALTY}::DOUBLE) * a[i] - {pace} * e[i]), c - {pace} * list_sum(e) FROM
  (SELECT t, a, c, list_transform(range(1, len(a) + 1), lambda i: (1 / (1 + exp(-list_dot_product(m.k[i], a) - c)) - y[i]) / n) AS e FROM s, m WHERE t < 1000)),
z AS (SELECT a, c FROM s WHERE t = 1000), w AS (SELECT unnest(b) AS k, sum(a[i] / sqrt(len(b))) AS w FROM l, z GROUP BY 1), wl AS (SELECT map(list(k), list(w)) AS w FROM w),
u AS (SELECT *, {buckets} AS b FROM ({parts} FROM pages)),
v AS (SELECT page_id, u.host, u.path, 1 / (1 + exp(-z.c - coalesce(list_sum(list_transform(b, lambda q: coalesce(wl.w[q], 0))) / sqrt(len(b)), 0))) AS score,
  (SELECT max({{'n': length(rule), 'h': length(h), 'v': verdict, 'r': rule}}) FROM rule WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS f FROM u, z, wl)
SELECT page_id, host, path, f.r AS rule, coalesce(f.v, CASE WHEN score > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(score, 3) AS score FROM v"""


SQL["op11_url_filters"] = _urls()

SQL["op12_filter_audit"] = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, least IS NOT NULL)] AS f,
  count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM w GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i), o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, k.i AS step, o[k.i] AS own, n, good, toxic, f[o[k.i]] AS hit,
  list_bool_or(list_transform(o[1:k.i - 1], lambda i: f[i])) AS gone, len(list_filter(f, lambda b: b)) AS fails FROM c, o, x k),
a AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT coalesce(gone, false)), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (hit AND fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT coalesce(gone, false)), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT coalesce(gone, false)), 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a"""

SQL["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d), k AS (SELECT lang, w, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, w, count(*) AS c FROM t SEMI JOIN k USING (lang, w) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.w, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v) AS q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.w = k.w),
s AS (SELECT x.lang, x.source, z.source AS item, coalesce(sum(abs(a.p - b.p)), 0)::BIGINT AS value FROM g x JOIN g z ON z.lang = x.lang AND z.source <> x.source
  LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = z.lang AND b.source = z.source AND b.w = a.w GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM s UNION ALL SELECT lang, source, 'term', w, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 50"""
