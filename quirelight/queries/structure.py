"""Registered queries of structure, references and look-alikes; their SQL is written by hand."""

from __future__ import annotations

from quirelight.functions.unicode import CONFUSABLE
from quirelight.operators import references as R
from quirelight.operators import structure as S
from quirelight.runtime import table


def _two(f):
    return lambda s, d: f(*S.versions(table(s, d, "zones")))


QUERIES = {
    "heading_diff": _two(S.heading_diff),
    "list_diff": _two(S.list_diff),
    "footnote_diff": _two(S.footnote_diff),
    "reference_diff": _two(S.reference_diff),
    "index_diff": _two(S.parent_changes),
    "structure_diff": _two(S.structure_diff),
    "layout_diff": _two(S.layout_diff),
    "parse_citation": lambda s, d: R.parse_citation(table(s, d, "zones")),
    "citation_keeps_words": lambda s, d: R.citation_keeps_words(table(s, d, "zones")),
    "names": lambda s, d: R.names(table(s, d, "zones")),
    "is_confusable": lambda s, d: R.confusable_tokens(table(s, d, "pdf_tokens"), table(s, d, "xhtml_tokens")),
    "detect_language": lambda s, d: R.detect_language(table(s, d, "zones"), table(s, d, "documents"), table(s, d, "language_codes")),
}

_SIDES = """
WITH z AS (SELECT zone_id AS id, saved_at, doc_id, tag, coalesce(text, '') AS text, level, nullif(lower(trim(parent_id)), '') AS parent, coalesce(serial, 2147483647) AS pos, x0, y0 FROM zones WHERE zone_id IS NOT NULL),
a AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at NULLS FIRST, doc_id, tag, text, level NULLS FIRST, parent NULLS FIRST, pos, x0, y0) = 1),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at DESC NULLS LAST, doc_id DESC, tag DESC, text DESC, level DESC NULLS LAST, parent DESC NULLS LAST, pos DESC, x0 DESC, y0 DESC) = 1)
"""


def _kind(tag: str, name: str) -> str:
    """Missing, added, changed and reordered zones of a tag."""
    return f"""
SELECT doc_id, id, 'MISSING_{name}' AS change, text AS before, NULL AS after FROM a WHERE tag = '{tag}' AND NOT EXISTS (FROM b WHERE b.tag = '{tag}' AND b.id = a.id AND b.doc_id = a.doc_id)
UNION ALL SELECT doc_id, id, 'ADDED_{name}', NULL, text FROM b WHERE tag = '{tag}' AND NOT EXISTS (FROM a WHERE a.tag = '{tag}' AND a.id = b.id AND a.doc_id = b.doc_id)
UNION ALL SELECT a.doc_id, a.id, '{name}_TEXT_CHANGED', a.text, b.text FROM a JOIN b USING (id) WHERE a.tag = '{tag}' AND b.tag = '{tag}' AND a.doc_id = b.doc_id AND a.text <> b.text
UNION ALL SELECT doc_id, id, '{name}_REORDERED', before, after FROM (SELECT a.doc_id, a.id, lag(a.id) OVER (PARTITION BY a.doc_id ORDER BY a.pos, a.id) AS before, lag(a.id) OVER (PARTITION BY a.doc_id ORDER BY b.pos, a.id) AS after
  FROM a JOIN b USING (id) WHERE a.tag = '{tag}' AND b.tag = '{tag}' AND a.doc_id = b.doc_id) AS o WHERE before IS DISTINCT FROM after
"""


def _field(tag: str, change: str, f: str) -> str:
    x, y = f.format("a"), f.format("b")
    return f"UNION ALL SELECT a.doc_id, a.id, '{change}', CAST({x} AS VARCHAR), CAST({y} AS VARCHAR) FROM a JOIN b USING (id) WHERE a.tag = '{tag}' AND b.tag = '{tag}' AND a.doc_id = b.doc_id AND {x} IS DISTINCT FROM {y}\n"


_HEADINGS = _kind("title", "HEADING") + _field("title", "WRONG_HEADING_LEVEL", "{}.level")
_LISTS = _kind("list", "LIST") + "UNION ALL" + _kind("list-item", "LIST_ITEM") + """UNION ALL SELECT doc_id, id, 'LIST_STRUCTURE_CHANGED', CAST(n AS VARCHAR), CAST(m AS VARCHAR) FROM (
  SELECT a.doc_id, a.id, (SELECT count(*) FROM a AS i WHERE i.tag = 'list-item' AND i.parent = lower(trim(a.id))) AS n, (SELECT count(*) FROM b AS i WHERE i.tag = 'list-item' AND i.parent = lower(trim(a.id))) AS m
  FROM a JOIN b USING (id) WHERE a.tag = 'list' AND b.tag = 'list' AND a.doc_id = b.doc_id) AS c WHERE n <> m
"""
_NOTES = _kind("fn", "FOOTNOTE") + _field("fn", "FOOTNOTE_MARKER_CHANGED", r"regexp_extract({}.text, '^\s*\[?([0-9]{{1,9}}|[*†‡§]+)', 1)")
_REFS = (
    _kind("ref", "REFERENCE")
    + _field("ref", "REFERENCE_YEAR_CHANGED", r"regexp_extract({}.text, '(1[5-9]\d{{2}}|20\d{{2}})', 1)")
    + _field("ref", "REFERENCE_AUTHOR_CHANGED", r"trim(split_part(regexp_replace({}.text, '^\s*[0-9]+[.)]\s*', ''), ',', 1))")
)
_PARENTS = """SELECT a.doc_id, a.id, 'PARENT_CHANGED' AS change, a.parent AS before, b.parent AS after FROM a JOIN b USING (id) WHERE a.doc_id = b.doc_id AND a.parent IS DISTINCT FROM b.parent
UNION ALL SELECT a.doc_id, a.id, 'DEPTH_CHANGED', CAST(a.level AS VARCHAR), CAST(b.level AS VARCHAR) FROM a JOIN b USING (id) WHERE a.doc_id = b.doc_id AND a.level IS DISTINCT FROM b.level
"""
_PAIRS = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in CONFUSABLE)
_REF = r"""
WITH cur AS (SELECT zone_id, tag, text AS raw FROM zones WHERE zone_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY saved_at DESC NULLS LAST, tag DESC, text DESC NULLS LAST) = 1),
r1 AS (SELECT zone_id, raw, nullif(regexp_extract(raw, '^\s*\[?([0-9]+)[.)\]]', 1), '') AS number, trim(regexp_replace(raw, '^\s*\[?[0-9]+[.)\]]', '')) AS r FROM cur WHERE tag = 'ref' AND raw <> ''),
r2 AS (SELECT *, nullif(regexp_extract(r, '\((1[5-9]\d{2}|20\d{2})[a-z]?\)', 1), '') AS year, list_filter(string_split(r, ' '), lambda w: starts_with(w, '10.') OR starts_with(lower(w), 'doi:10.') OR starts_with(w, 'https://doi.org/'))[1] AS doi FROM r1),
r3 AS (SELECT *, CASE WHEN instr(r, ' (') > 0 AND year IS NOT NULL THEN nullif(trim(split_part(r, ' (', 1)), '') END AS people FROM r2),
r4 AS (SELECT *, string_split(CASE WHEN people IS NOT NULL THEN trim(regexp_replace(substr(r, instr(r, ')') + 1), '^[.,:]\s*', '')) ELSE r END, '. ') AS p FROM r3),
r5 AS (SELECT *, CASE WHEN len(p) > 1 THEN regexp_replace(p[-1], '\.\s*$', '') END AS tail FROM r4),
ref AS (SELECT zone_id, number, people, year, nullif(trim(regexp_replace(p[1], '\.\s*$', '')), '') AS title, CASE WHEN contains(tail, ': ') THEN split_part(tail, ': ', 1) END AS place,
  CASE WHEN contains(tail, ': ') THEN trim(split_part(tail, ': ', -1)) END AS publisher, doi, contains(raw, 'et al') AS et_al, raw FROM r5)
"""
SQL = {
    "heading_diff": _SIDES + _HEADINGS,
    "list_diff": _SIDES + _LISTS,
    "footnote_diff": _SIDES + _NOTES,
    "reference_diff": _SIDES + _REFS,
    "index_diff": _SIDES + _PARENTS,
    "structure_diff": _SIDES
    + " UNION ALL ".join(f"SELECT *, '{n}' AS part FROM ({q}) AS {n}_rows" for n, q in (("heading", _HEADINGS), ("list", _LISTS), ("footnote", _NOTES), ("reference", _REFS), ("hierarchy", _PARENTS))),
    "layout_diff": _SIDES + "SELECT a.doc_id, a.id, b.x0 - a.x0 AS dx, b.y0 - a.y0 AS dy FROM a JOIN b USING (id) WHERE a.doc_id = b.doc_id AND (abs(b.x0 - a.x0) > 3 OR abs(b.y0 - a.y0) > 3)",
    "parse_citation": _REF + "FROM ref",
    "citation_keeps_words": _REF + "SELECT zone_id, NOT EXISTS (FROM (SELECT unnest([number, people, year, title, place, publisher, doi]) AS v) AS f WHERE v IS NOT NULL AND NOT contains(raw, v)) AS kept FROM ref",
    "names": _REF
    + r""", n AS (SELECT zone_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(people, '\s+(?:and|&)\s+|;\s*', '|', 'g'), '\.,\s*', '.|', 'g'), '|'), lambda x: trim(x)), lambda x: x <> '') AS l FROM ref WHERE people IS NOT NULL),
m AS (SELECT zone_id, unnest(l) AS p, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM n)
SELECT zone_id, pos, CASE WHEN contains(p, ',') THEN trim(split_part(p, ',', 1)) ELSE split_part(p, ' ', -1) END AS surname, CASE WHEN contains(p, ',') THEN trim(substr(p, instr(p, ',') + 1)) ELSE trim(left(p, length(p) - length(split_part(p, ' ', -1)))) END AS given FROM m""",
    "is_confusable": f"""
WITH alike(p, q) AS (VALUES {_PAIRS}),
t AS (SELECT DISTINCT p.token_id, p.text AS a, x.text AS b FROM pdf_tokens p JOIN xhtml_tokens x ON x.pdf_token_id = p.token_id WHERE p.text <> x.text AND length(p.text) = length(x.text)),
c AS (SELECT token_id, a, b, unnest(range(1, length(a) + 1)) AS i FROM t),
d AS (SELECT token_id, a, b, substr(a, i, 1) AS p, substr(b, i, 1) AS q FROM c WHERE substr(a, i, 1) <> substr(b, i, 1)),
g AS (SELECT d.token_id, d.a, d.b, count(*) AS n, count(*) FILTER (EXISTS (FROM alike WHERE alike.p = d.p AND alike.q = d.q)) AS k FROM d GROUP BY ALL)
SELECT token_id, CAST(max(n) AS INTEGER) AS places FROM g WHERE n = k GROUP BY token_id""",
    "detect_language": r"""
WITH latin AS (SELECT spelling, min(lang_code) AS lang FROM language_codes WHERE script = 'Latin' GROUP BY spelling),
w AS (SELECT DISTINCT d.doc_id, l.lang, unnest(regexp_extract_all(lower(d.text), '\p{L}+')) AS word FROM documents d JOIN latin l ON l.spelling = d.lang),
n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
stops AS (SELECT lang, word FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20),
cur AS (SELECT zone_id, text FROM zones WHERE zone_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY saved_at DESC NULLS LAST, text DESC NULLS LAST) = 1),
h AS (SELECT zone_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM cur),
s AS (SELECT zone_id, lang, count(*) AS k FROM h JOIN stops USING (word) GROUP BY ALL),
best AS (SELECT zone_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY k DESC, lang) = 1)
SELECT cur.zone_id, best.lang FROM cur LEFT JOIN best USING (zone_id)""",
}
