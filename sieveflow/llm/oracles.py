"""DuckDB counterparts of the operators that SQL can express. They compare all pairs, where the operators must not."""

from __future__ import annotations

from . import secret_scan

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), walk AS (
  SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT walk.node, links.b FROM walk JOIN links ON walk.seen = links.a
), comp AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON vec_id = node LEFT JOIN degree ON vec_id = a
"""

#: One edit can't be in the first ten and the last ten of 20 or more characters, so near lines share one of them.
OP4 = r"""
WITH l AS (
  SELECT doc_id, i AS pos, parts[i] AS line
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), long AS (SELECT * FROM l WHERE length(line) >= 20),
firsts AS (SELECT line, min((doc_id, pos)) AS f FROM long GROUP BY line),
cand AS (
  SELECT a.line AS x, b.line AS y, a.f AS fx, b.f AS fy FROM firsts a JOIN firsts b ON left(a.line, 10) = left(b.line, 10) AND a.f > b.f AND abs(length(a.line) - length(b.line)) <= 1
  UNION SELECT a.line, b.line, a.f, b.f FROM firsts a JOIN firsts b ON right(a.line, 10) = right(b.line, 10) AND a.f > b.f AND abs(length(a.line) - length(b.line)) <= 1
), near AS (SELECT DISTINCT x FROM cand WHERE levenshtein(x, y) <= 1),
judged AS (
  SELECT l.doc_id, l.pos, l.line, length(l.line) >= 20 AND (n.x IS NOT NULL OR (l.doc_id, l.pos) <> f.f) AS gone
  FROM l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.x
), put AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) AS n, count(*) FILTER (gone) AS g FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(p.text, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN put p USING (doc_id)
"""

OP5 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""


def _either(text: str) -> str:
    """A pattern's ``(?i:...)`` group with both cases of each letter: the other engine's flag also folds other scripts."""
    start = text.find("(?i:")
    if start < 0:
        return text
    end = text.index(")", start)
    body = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text[start + 4 : end])
    return f"{text[:start]}(?:{body}){text[end + 1 :]}"


def op9() -> str:
    """Gaps and matches of each rule's pattern, their lengths added up."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts, spans = ["d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"], []
    for i, r in enumerate(secret_scan.RULES):
        p = quote(_either(r.pattern))
        value = f"regexp_extract(m[i], {quote(r.value)}, 1)" if r.value else "m[i]"
        parts.append(f"m{i} AS (SELECT doc_id, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m FROM d WHERE regexp_matches(text, {p}))")
        at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
        spans.append(
            f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, CAST({at} AS BIGINT) AS a, CAST(length(m[i]) AS BIGINT) AS n "
            f"FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m{i}) WHERE length({value}) >= {r.least}"
        )
    said = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k)"
    counts = ", ".join(f"CAST(count(s.doc_id) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secret_scan.BASE)
    return (
        f"WITH {', '.join(parts)}, s AS ({' UNION ALL '.join(spans)}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (base), '')) AS base_sha256, coalesce({said}, '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"
    )


#: All kept terms of all sources, where the operator keeps to those that occur.
OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(f), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang AS of_lang, x.source AS s, y.source AS o, ((x.p - y.p) * (x.p - y.p)) // (x.p + y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
  ) ON a.lang = of_lang AND a.source = s AND b.source = o
  GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embed_dedup": OP1, "op4_line_dedup": OP4, "op5_exact_dedup": OP5, "op9_secret_scan": op9(), "op11_source_audit": OP11}
