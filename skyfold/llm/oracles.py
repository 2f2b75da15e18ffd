"""Checking SQL of the corpus queries, for an engine with lists and RE2."""

from __future__ import annotations

from .repetition import LINE_LIMIT, NGRAM_LIMITS
from .secrets import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return _WORDS.format(text)


def repetition() -> str:
    grams = (3, *NGRAM_LIMITS)
    text = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w, row_number() OVER () AS r FROM documents), ww AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(list_transform(w, lambda x: length(x))) AS n FROM d)"""
    for k in grams:
        text += f""", g{k} AS (SELECT r, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d)),
  c{k} AS (SELECT q.r, count(*) AS n, sum(ww.n) AS chars FROM (SELECT DISTINCT g.r, unnest(range(g.i, g.i + {k})) AS p FROM g{k} g JOIN (SELECT r, g FROM g{k} GROUP BY r, g HAVING count(*) > 1) m ON m.r = g.r AND m.g = g.g) q JOIN ww ON ww.r = q.r AND ww.p = q.p GROUP BY q.r)"""
    text += """, l AS (SELECT r, s, row_number() OVER (PARTITION BY r, s) AS nth FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]')),
  dl AS (SELECT r, count(*) AS n, sum(length(regexp_replace(s, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM l WHERE nth > 1 GROUP BY r),
  m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dl.chars, 0) AS BIGINT) AS dup_line_chars"""
    text += "".join(f", CAST(coalesce(c{k}.chars, 0) AS BIGINT) AS dup_{k}gram_chars" for k in NGRAM_LIMITS)
    text += " FROM d LEFT JOIN dl ON dl.r = d.r" + "".join(f" LEFT JOIN c{k} ON c{k}.r = d.r" for k in grams) + ")"
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    kept = f"NOT {failed} AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars" + "".join(f" AND 100 * dup_{k}gram_chars <= {v} * word_chars" for k, v in NGRAM_LIMITS.items())
    return text + f" SELECT *, {failed} AS base_failed, {kept} AS kept FROM m"


def jaccard() -> str:
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(lower)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON m.a = d.doc_id"""


def substrings(length: int = 50) -> str:
    return f"""WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
  v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {length - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS p FROM v JOIN (SELECT h, min(doc_id) AS first FROM v GROUP BY h) f ON f.h = v.h AND f.first < v.doc_id),
  lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda q: NOT list_contains(ps, q)), lambda q: w[q]) END, ' ')) AS kept_sha256
  FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id"""


def contamination(percent: int = 80) -> str:
    """All windows of an item's length that begin where a shared shingle puts the item, by the exact similarity alone."""
    words = _words("lower(coalesce(text, ''))")
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
  bs AS (SELECT item_id, n, k, i - 1 AS off, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM b)),
  ds AS (SELECT doc_id, len(w) AS m, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
  c AS (SELECT DISTINCT doc_id, item_id, n, ds.k, greatest(0, least(pos - off, m - n)) AS start FROM ds JOIN bs ON bs.g = ds.g AND bs.k = ds.k),
  wc AS (SELECT c.doc_id, c.item_id, c.start, ds.g, count(*) AS x FROM c JOIN ds ON ds.doc_id = c.doc_id AND ds.k = c.k AND ds.pos BETWEEN c.start AND c.start + c.n - c.k GROUP BY ALL),
  bc AS (SELECT item_id, g, count(*) AS y FROM bs GROUP BY ALL),
  tot AS (SELECT doc_id, item_id, start, sum(x) AS x FROM wc GROUP BY ALL), bt AS (SELECT item_id, sum(y) AS y FROM bc GROUP BY ALL),
  sh AS (SELECT wc.doc_id, wc.item_id, wc.start, sum(least(x, y)) AS n_shared FROM wc JOIN bc ON bc.item_id = wc.item_id AND bc.g = wc.g GROUP BY ALL),
  sc AS (SELECT sh.doc_id, sh.item_id, sh.start, n_shared, tot.x + bt.y - n_shared AS n_union FROM sh JOIN tot ON tot.doc_id = sh.doc_id AND tot.item_id = sh.item_id AND tot.start = sh.start JOIN bt ON bt.item_id = sh.item_id)
  SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_union AS BIGINT) AS n_union FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_union DESC, start) AS rn FROM sc WHERE 100 * n_shared >= {percent} * n_union) WHERE rn = 1"""


def secrets() -> str:
    spell = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    keywords = "|".join(map(spell, ("password", "passwd", "secret", "token"))) + "|" + spell("api") + "_?" + spell("key")
    parts = []
    for k, rule in enumerate(RULES):
        pattern = (f"({keywords})" + rule.pattern.partition("))")[2] if rule.group else rule.pattern).replace("'", "''")
        tested = f"regexp_extract_all(t, '{pattern}', {rule.group})"
        parts.append(f"SELECT r, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p, {tested} AS g, {rule.least} AS least FROM d")
    base = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    n_base = sum(r.base for r in RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), f AS ({" UNION ALL ".join(parts)}),
  e AS (SELECT r, k, kind, m, p, g, least, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
  s AS (SELECT r, k, kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM e WHERE length(g[i]) >= least),
  o AS (SELECT r, {base}, coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (WHERE k < {n_base}), '') AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
  SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON o.r = d.r"""


ORACLE_SQL = {
    "op5_repetition": repetition(),
    "op6_jaccard_components": jaccard(),
    "op7_decontamination": contamination(),
    "op8_substring_dedup": substrings(),
    "op9_secrets": secrets(),
}
