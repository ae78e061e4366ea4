"""SQL for the operators whose results SQL can express (DuckDB over the same tables)."""

import math

from panelspark.llm import licenses
from panelspark.llm.url_aliases import RULES

_WORDS = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE lo < doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
seen AS (SELECT p.doc_id, p.word, p.j, coalesce(max(h.i) OVER (PARTITION BY p.doc_id ORDER BY p.j) + 50 > p.j, false) AS gone
         FROM pos p LEFT JOIN hit h ON p.doc_id = h.doc_id AND p.j = h.i),
cut AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept
        FROM seen GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM w LEFT JOIN cut c USING (doc_id)
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules(host: str, path: str, then) -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{then(v, h + p)}'"
                              for v, h, p in ranked) + " END"


def _parts(url: str) -> str:
    return (f"translate(regexp_extract(coalesce({url}, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UP}', '{_LOW}') AS host, "
            f"regexp_extract(coalesce({url}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, "
            f"regexp_extract(coalesce({url}, ''), '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest")


#: a path from the root on, its ``.`` and ``..`` segments resolved one after the other
_WITHOUT_DOTS = ("'/' || array_to_string(list_concat(list_reduce(list_transform(string_split(way, '/')[2:], lambda x: [x]), lambda acc, x: "
                 "CASE WHEN x[1] = '..' THEN acc[1:len(acc) - 1] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])), "
                 "CASE WHEN regexp_matches(way, '/\\.\\.?$') THEN [''] ELSE [] END), '/')")

OP5 = f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_parts('url')} FROM pages),
tags AS (SELECT url, host, path, host || rest AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM p
         WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'refresh')),
targets AS (SELECT url, host, path, a, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS t FROM tags
            WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
            UNION ALL SELECT url, host, path, a, regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags
            WHERE regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
seen_ AS (SELECT a, url, host, path, t, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme, regexp_extract(t, '^([^?#]*)', 1, 's') AS own,
                 regexp_extract(t, '^[^?#]*(\\?[^#]*)', 1, 's') AS query, regexp_replace(path, '[^/]*$', '') AS base FROM targets),
merged_ AS (SELECT *, CASE WHEN starts_with(own, '/') THEN own ELSE CASE WHEN base = '' THEN '/' ELSE base END || own END AS way FROM seen_),
full_ AS (SELECT a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
                         WHEN t = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                         WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '#') THEN url
                         WHEN own = '' THEN scheme || '://' || host || path || query
                         ELSE scheme || '://' || host || {_WITHOUT_DOTS} || query END AS t FROM merged_),
e AS (SELECT a, host || rest AS b FROM (SELECT a, {_parts('t')} FROM full_) WHERE a <> '' AND host || rest <> ''),
und AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM und UNION SELECT r.node, u.b FROM reach r JOIN und u ON r.seen = u.a),
marks AS (SELECT node, bool_or(coalesce(v = 'block', false)) AS blocked, bool_or(coalesce(v = 'allow', false)) AS allowed
          FROM (SELECT node, {_rules('host', 'path', lambda v, t: v)} AS v FROM (SELECT node, {_parts("('x://' || seen)")} FROM reach)) GROUP BY node)
SELECT p.page_id, p.host, p.path, {_rules('p.host', 'p.path', lambda v, t: t)} AS rule,
       coalesce({_rules('p.host', 'p.path', lambda v, t: v)}, CASE WHEN m.blocked AND NOT m.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN marks m ON p.host <> '' AND m.node = p.host || p.rest
"""

_FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_FOLDED}') AS ws FROM documents),
q AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_FOLDED}') AS ws
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS s
       FROM (SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM q WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, iw.item FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
ends AS (SELECT doc_id, i, max(i + k) AS stop FROM hit GROUP BY doc_id, i),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM ends)),
cov AS (SELECT p.doc_id, coalesce(max(e.stop) OVER (PARTITION BY p.doc_id ORDER BY p.j) > p.j, false) AS c
        FROM pos p LEFT JOIN ends e ON p.doc_id = e.doc_id AND p.j = e.i),
n AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n_hit FROM cov GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, g, count(*) AS k FROM s GROUP BY doc_id, g),
n AS (SELECT doc_id, sum(k) AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.k, b.k)) AS same FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE same >= 0.8 * (x.n + y.n - same)),
und AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, und.v FROM reach r JOIN und ON r.seen = und.u),
root AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node)
SELECT w.doc_id, root.class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles
FROM w JOIN root ON root.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_KEPT}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""


def _lloyd(rounds: int = 6, size: int = 8) -> str:
    """Lloyd rounds as a chain of assignments a0, a1, ... and codebooks c0, c1, ..."""
    gap = "list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    mean = ", ".join(f"(sum(s[{j}]) - ((sum(s[{j}]) % count(*)) + count(*)) % count(*)) // count(*)" for j in range(1, size + 1))
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT p.rid, p.part, min({{'d': {gap}, 'e': c.e}}) AS m FROM p JOIN c{r} c USING (part) GROUP BY p.rid, p.part)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, m.e AS e, list_transform([{mean}], lambda x: CAST(x AS BIGINT)) AS s FROM a{r} JOIN p USING (rid, part) GROUP BY 1, 2)")
            steps.append(f"c{r + 1} AS (SELECT c.part, c.e, coalesce(m.s, c.s) AS s FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.e = c.e)")
    return ",\n".join(steps)


OP12 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
                  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_KEPT}),
p AS (SELECT rid, part, v[part * 8 + 1:part * 8 + 8] AS s FROM k, range(8) t(part)),
c0 AS (SELECT part, rid - 1 AS e, s FROM p WHERE rid <= 16),
{_lloyd()},
coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', a.m.e), '' ORDER BY a.part) AS code, CAST(sum(a.m.d) AS BIGINT) AS error
          FROM a6 a JOIN k USING (rid) GROUP BY k.rid, k.vec_id, k.label),
book AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""


def _contained() -> tuple[str, int]:
    """Rows (label, tokens, need) of the license templates, and the words of the longest one."""
    rows = []
    for label, text in licenses.TEMPLATES:
        tokens = sorted(set(text.split()))
        rows.append(f"('{label}', {tokens}, {math.ceil(licenses.THRESHOLD * len(tokens) - 1e-9)})")
    return ", ".join(rows), max(len(text.split()) for _, text in licenses.TEMPLATES)


def _phrases() -> str:
    rows = ", ".join(f"({phrase.split()}, '{label}')" for phrase, label in licenses.PHRASES)
    return f"(VALUES {rows}) f(ws, label)"


_TEMPLATES, _STEP = _contained()

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_FOLDED}') AS w FROM documents),
place AS (SELECT rid, f.label, unnest(range(0, len(w))) AS i, w, f.ws FROM d, {_phrases()} WHERE list_has_all(w, f.ws)),
hit AS (SELECT rid, label, i FROM place WHERE w[i + 1:i + len(ws)] = ws),
b AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM hit GROUP BY rid),
block AS (SELECT rid, list_distinct(w[x * {_STEP} + 1:x * {_STEP} + 2 * {_STEP}]) AS s
          FROM (SELECT rid, w, unnest(range(0, greatest(CAST(ceil(len(w) / {_STEP}) AS BIGINT) - 2, 0) + 1)) AS x FROM d)),
found AS (SELECT rid, t.label, len(list_intersect(t.tokens, s)) / len(t.tokens) AS score
          FROM block, (VALUES {_TEMPLATES}) t(label, tokens, need) WHERE len(list_intersect(t.tokens, s)) >= t.need),
m AS (SELECT rid, list(DISTINCT label) AS labels, max(score) AS best FROM found GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""
