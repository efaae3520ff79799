"""Joins, aggregations, windows and set operations over layout, zones and findings, as SQL.

Each operator is a function of a dialect that returns the text of a query over
``{table}`` names; ``run`` gives it to Catalyst with DataFrames for the names. Range
joins are equi joins on document and page with the geometry as residual, so a task
holds the boxes of one page; ordered state is a window within a document; nothing
is collected. Ties are broken by the key, so results don't depend on the plan.

Defined cases: null boxes and texts don't match; of zones the current row counts;
repeated rows of other tables count once where the operator works on keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelight.functions import text as T
from quirelight.functions.dialect import DUCK, SPARK, Spark

OPERATORS: dict[str, Callable[[Spark], str]] = {}


def operator(f):
    OPERATORS[f.__name__] = f
    return f


TABLES = ("zones", "line_features", "layout_blocks", "pdf_tokens", "xhtml_tokens", "differences", "documents", "language_codes")
_NAME = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def tables_of(sql: str) -> set[str]:
    return set(_NAME.findall(sql))


def run(spark: SparkSession, name: str, tables: Callable[[str], DataFrame]) -> DataFrame:
    """The operator ``name`` over tables that ``tables`` finds by name."""
    sql = OPERATORS[name](SPARK)
    names = tables_of(sql)
    if not names:
        return spark.sql(sql)
    ready = re.sub(r"\{\{(" + "|".join(TABLES) + r")\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(ready, **{n: tables(n) for n in names})


def check_sql(name: str) -> str:
    return _NAME.sub(r"\1", OPERATORS[name](DUCK))


CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY saved_at DESC) AS _rn FROM {zones} WHERE zone_id IS NOT NULL) AS _z WHERE _rn = 1)"
KEY = "nullif(lower(trim({})), '')".format
AREA = "greatest(0.0e0, {0}.x1 - {0}.x0) * greatest(0.0e0, {0}.y1 - {0}.y0)".format
CROSS = "greatest(0.0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
LINES = "ln AS (SELECT DISTINCT line_id, doc_id, page, block_no, line_no, x0, y0, x1, y1, text, font, font_size, bold, italic, caps_ratio, source FROM {line_features} WHERE line_id IS NOT NULL)"
ORDER = "page, coalesce(serial, 2147483647), created_order, zone_id"


# ---- joins

@operator
def orphan_parents(d):
    return f"WITH {CUR} SELECT a.zone_id, a.parent_id FROM cur a WHERE {KEY('a.parent_id')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur b WHERE {KEY('b.zone_id')} = {KEY('a.parent_id')})"


@operator
def overlapping_zones(d):
    return f"""WITH {CUR} SELECT a.zone_id AS zone_a, b.zone_id AS zone_b FROM cur a JOIN cur b ON a.doc_id = b.doc_id AND a.page = b.page AND a.tag = b.tag AND a.zone_id < b.zone_id
        WHERE least({AREA('a')}, {AREA('b')}) > 0 AND {CROSS} >= 0.9e0 * least({AREA('a')}, {AREA('b')})
        AND coalesce({KEY('a.parent_id')}, '') <> {KEY('b.zone_id')} AND coalesce({KEY('b.parent_id')}, '') <> {KEY('a.zone_id')}"""


@operator
def smallest_container(d):
    return f"""WITH {CUR} SELECT zone_id, container FROM (SELECT a.zone_id, b.zone_id AS container, row_number() OVER (PARTITION BY a.zone_id ORDER BY {AREA('b')}, b.zone_id) AS k
        FROM cur a JOIN cur b ON a.doc_id = b.doc_id AND a.page = b.page AND a.zone_id <> b.zone_id AND b.x0 <= a.x0 + 2 AND b.y0 <= a.y0 + 2 AND b.x1 >= a.x1 - 2 AND b.y1 >= a.y1 - 2
        AND {AREA('b')} > {AREA('a')}) AS x WHERE k = 1"""


@operator
def uncovered_lines(d):
    return f"""WITH {CUR}, {LINES} SELECT l.line_id FROM ln l WHERE NOT EXISTS (SELECT 1 FROM cur z WHERE z.doc_id = l.doc_id AND z.page = l.page
        AND (l.x0 + l.x1) / 2 >= z.x0 - 1 AND (l.x0 + l.x1) / 2 <= z.x1 + 1 AND (l.y0 + l.y1) / 2 >= z.y0 - 1 AND (l.y0 + l.y1) / 2 <= z.y1 + 1)"""


@operator
def zone_font_stats(d):
    return f"""WITH {CUR}, {LINES} SELECT z.zone_id, count(*) AS n_lines, avg(l.font_size) AS mean_size, avg(CASE WHEN l.bold THEN 1.0e0 ELSE 0.0e0 END) AS bold_ratio
        FROM cur z JOIN ln l ON z.doc_id = l.doc_id AND z.page = l.page AND (l.x0 + l.x1) / 2 BETWEEN z.x0 AND z.x1 AND (l.y0 + l.y1) / 2 BETWEEN z.y0 AND z.y1 GROUP BY z.zone_id"""


@operator
def ocr_blocks_for_bbox(d):
    return f"""WITH {CUR}, lb AS (SELECT DISTINCT doc_id, page, block_no, x0, y0, x1, y1 FROM {{layout_blocks}})
        SELECT a.zone_id, b.block_no, row_number() OVER (PARTITION BY a.zone_id ORDER BY b.y0, b.x0, b.block_no) AS pos FROM cur a JOIN lb b ON a.doc_id = b.doc_id AND a.page = b.page
        WHERE ((b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1)
        OR ({AREA('b')} > 0 AND {CROSS} >= 0.15e0 * {AREA('b')}) OR ({AREA('a')} > 0 AND {CROSS} >= 0.5e0 * {AREA('a')})"""


@operator
def missing_zone_text(d):
    return f"""WITH {CUR}, t AS (SELECT DISTINCT doc_id, text FROM {{documents}} WHERE text IS NOT NULL)
        SELECT z.zone_id FROM cur z JOIN t ON t.doc_id = z.doc_id WHERE length(z.text) >= 40 AND {'instr(t.text, substring(z.text, 1, 40))'} = 0"""


@operator
def merge_candidates(d):
    c = T.continuation_confidence("p_text", "text", d)
    return f"""WITH {CUR}, o AS (SELECT zone_id, tag, text, lag(zone_id) OVER w AS p_id, lag(tag) OVER w AS p_tag, lag(text) OVER w AS p_text FROM cur WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER}))
        SELECT zone_id, p_id AS previous_id, confidence FROM (SELECT zone_id, p_id, {c} AS confidence FROM o WHERE tag = p_tag) AS x WHERE confidence >= 0.8e0"""


@operator
def page_number_sequence(d):
    n = T.confusion_map("trim(text)", d)
    return f"""WITH {LINES}, c AS (SELECT line_id, doc_id, page, text, {n} AS v FROM ln WHERE {d.has('trim(text)', '^[0-9IliOo°SBGZ]{1,4}$')}),
        v AS (SELECT line_id, doc_id, page, text, cast(v AS bigint) AS v FROM c WHERE {d.has('v', '^[0-9]+$')}),
        s AS (SELECT doc_id, v - page AS k, count(DISTINCT page) AS pages FROM v WHERE {d.has('trim(text)', '^[0-9]+$')} GROUP BY doc_id, v - page)
        SELECT v.line_id, v.v AS suggested, CASE WHEN s.k IS NOT NULL THEN 0.9e0 ELSE 0.3e0 END AS confidence FROM v LEFT JOIN s ON s.doc_id = v.doc_id AND s.k = v.v - v.page WHERE NOT {d.has('trim(v.text)', '^[0-9]+$')}"""


@operator
def section_at(d):
    last = "last_value(CASE WHEN tag = 'title' THEN zone_id END IGNORE NULLS)" if d.name == "duck" else "last_value(CASE WHEN tag = 'title' THEN zone_id END) IGNORE NULLS"
    return f"WITH {CUR} SELECT zone_id, {last} OVER (PARTITION BY doc_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM cur WHERE tag IN ('title', 'p', 'fn', 'list-item')"


@operator
def broken_links(d):
    """Every link of a token to its counterpart, and whether the target is there."""
    return "SELECT DISTINCT x.token_id, x.pdf_token_id, p.token_id IS NULL AS broken FROM {xhtml_tokens} x LEFT JOIN (SELECT DISTINCT token_id FROM {pdf_tokens}) p ON p.token_id = x.pdf_token_id WHERE x.pdf_token_id IS NOT NULL"


@operator
def link_compare(d):
    return """WITH p AS (SELECT DISTINCT token_id, doc_id, text FROM {pdf_tokens}), x AS (SELECT DISTINCT pdf_token_id, text FROM {xhtml_tokens} WHERE pdf_token_id IS NOT NULL)
        SELECT p.token_id, CASE WHEN x.pdf_token_id IS NULL THEN 'MISSING' WHEN x.text = p.text THEN 'EQUAL' ELSE 'CHANGED' END AS state FROM p LEFT JOIN x ON x.pdf_token_id = p.token_id"""


@operator
def similar_zones(d):
    return f"""WITH {LINES}, k AS (SELECT line_id, doc_id, concat_ws('|', coalesce(font, ''), cast(font_size AS {'string' if d.name == 'spark' else 'varchar'}), cast(bold AS int), cast(italic AS int)) AS style FROM ln)
        SELECT doc_id, count(*) AS n_lines, min(line_id) AS first_line, count(DISTINCT style) AS n_styles FROM k GROUP BY doc_id"""


@operator
def table_cell_diff(d):
    cells = "VALUES (1, 0, 0, 'Year', 1), (1, 0, 1, 'Copies', 1), (1, 1, 0, '1901', 1), (1, 1, 1, '300', 2), (1, 2, 0, '1902', 1)"
    other = "VALUES (1, 0, 0, 'Year', 1), (1, 0, 1, 'Copies', 1), (1, 1, 0, '1901', 1), (1, 1, 1, '310', 1), (1, 3, 0, 'new', 1)"
    return f"""WITH a AS (SELECT * FROM ({cells}) AS t(tab, r, c, txt, span)), b AS (SELECT * FROM ({other}) AS t(tab, r, c, txt, span))
        SELECT coalesce(a.tab, b.tab) AS tab, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, CASE WHEN a.tab IS NULL THEN 'ADDED_CELL' WHEN b.tab IS NULL THEN 'MISSING_CELL'
        WHEN a.txt <> b.txt THEN 'CELL_TEXT_CHANGED' WHEN a.span <> b.span THEN 'CELL_SPAN_CHANGED' ELSE 'EQUAL' END AS state FROM a FULL OUTER JOIN b ON a.tab = b.tab AND a.r = b.r AND a.c = b.c"""


@operator
def claim_caption(d):
    """The next text block below a block of few lines: gap up to 24 points, x overlap, each taken by its nearest."""
    return """WITH lb AS (SELECT DISTINCT doc_id, page, block_no, n_lines, x0, y0, x1, y1 FROM {layout_blocks}),
        c AS (SELECT a.doc_id, a.page, a.block_no, b.block_no AS caption, b.y0 - a.y1 AS gap FROM lb a JOIN lb b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_no <> b.block_no
        WHERE b.y0 - a.y1 BETWEEN 0 AND 24 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND a.n_lines > 3 AND b.n_lines = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block_no ORDER BY gap, caption) AS k1, row_number() OVER (PARTITION BY doc_id, page, caption ORDER BY gap, block_no) AS k2 FROM c)
        SELECT doc_id, page, block_no, caption, gap FROM r WHERE k1 = 1 AND k2 = 1"""


# ---- aggregations

@operator
def element_counts(d):
    return f"WITH {CUR} SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS n_docs, cast(count(*) AS double) / sum(count(*)) OVER () AS frequency FROM cur GROUP BY tag"


@operator
def parent_child_counts(d):
    return f"WITH {CUR} SELECT coalesce(p.tag, '') AS parent_tag, c.tag, count(*) AS n FROM cur c LEFT JOIN cur p ON {KEY('p.zone_id')} = {KEY('c.parent_id')} GROUP BY coalesce(p.tag, ''), c.tag"


_NEXT = f"s AS (SELECT tag, lead(tag) OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS nxt FROM cur)"


@operator
def succession_counts(d):
    return f"WITH {CUR}, {_NEXT} SELECT tag, nxt, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY tag, nxt"


@operator
def succession_probability(d):
    return f"WITH {CUR}, {_NEXT}, c AS (SELECT tag, nxt, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY tag, nxt) SELECT tag, nxt, n, cast(n AS double) / sum(n) OVER (PARTITION BY tag) AS p FROM c"


@operator
def corpus_summary(d):
    return f"WITH {CUR}, {_NEXT}, c AS (SELECT tag, nxt, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY tag, nxt) SELECT tag, nxt, n FROM c ORDER BY n DESC, tag, nxt LIMIT 25"


@operator
def first_elements(d):
    return f"WITH {CUR}, f AS (SELECT tag, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS k FROM cur) SELECT tag, count(*) AS n FROM f WHERE k = 1 GROUP BY tag"


@operator
def attribute_values(d):
    pairs = "SELECT tag, k, v FROM cur LATERAL VIEW explode(attributes) e AS k, v" if d.name == "spark" else "SELECT tag, e.key AS k, e.value AS v FROM (SELECT tag, unnest(map_entries(attributes)) AS e FROM cur) AS x"
    return f"WITH {CUR}, p AS ({pairs}) SELECT tag, k AS attribute, substring(v, 1, 60) AS value, count(*) AS n FROM p GROUP BY tag, k, substring(v, 1, 60)"


@operator
def text_stats(d):
    one = lambda p: f"avg(CASE WHEN {p} THEN 1.0e0 ELSE 0.0e0 END)"
    return f"""WITH {CUR} SELECT tag, count(*) AS n, avg(length(text)) AS mean_len, stddev_pop(length(text)) AS std_len, {one(d.has('text', r'^\s*(?:[•\-*]|\d+[.)])\s'))} AS p_marker,
        {one(d.has('text', r'^\s*\d'))} AS p_digit_start, {one(T.ends_sentence('text', d))} AS p_end_punct, {one('length(text) <= 60')} AS p_short FROM cur WHERE text <> '' GROUP BY tag"""


@operator
def tag_profile_stats(d):
    return f"""WITH {CUR} SELECT tag, count(*) AS n, avg(x0) AS mean_x, stddev_pop(x0) AS std_x, avg(x1 - x0) AS mean_w, stddev_pop(x1 - x0) AS std_w, avg(y1 - y0) AS mean_h, stddev_pop(y1 - y0) AS std_h,
        avg(CASE WHEN text IS NULL OR text = '' THEN 0.0e0 ELSE 1.0e0 END) AS text_ratio FROM cur GROUP BY tag"""


@operator
def body_font_size(d):
    return f"WITH {LINES}, c AS (SELECT doc_id, page, font_size, count(*) AS n FROM ln GROUP BY doc_id, page, font_size) SELECT doc_id, page, font_size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, font_size) AS k FROM c) AS x WHERE k = 1"


_BODY = "bs AS (SELECT doc_id, font_size AS body FROM (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(text)) DESC, font_size) AS k FROM ln GROUP BY doc_id, font_size) AS y WHERE k = 1)"


@operator
def document_context(d):
    return f"""WITH {LINES}, {_BODY} SELECT l.doc_id, max(b.body) AS body_size, count(DISTINCT CASE WHEN l.font_size > b.body + 0.4e0 THEN l.font_size END) AS heading_sizes, count(DISTINCT l.page) AS n_pages
        FROM ln l JOIN bs b ON b.doc_id = l.doc_id GROUP BY l.doc_id"""


@operator
def running_signatures(d):
    return f"""WITH {LINES}, s AS (SELECT doc_id, page, {T.running_signature('text', d)} AS sig, y0 FROM ln),
        g AS (SELECT doc_id, sig, count(DISTINCT page) AS pages, max(y0) - min(y0) AS spread FROM s WHERE sig <> '' GROUP BY doc_id, sig) SELECT doc_id, sig, pages FROM g WHERE pages >= 2 AND spread <= 12"""


@operator
def page_margins(d):
    return f"WITH {LINES} SELECT doc_id, page, min(x0) AS left_edge, max(x1) AS right_edge, min(y0) AS top_edge, max(y1) AS bottom_edge, count(*) AS n_lines FROM ln GROUP BY doc_id, page"


@operator
def bbox_union(d):
    return f"WITH {LINES} SELECT doc_id, page, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ln GROUP BY doc_id, page, block_no"


FINDINGS = """f AS (SELECT DISTINCT diff_id, doc_id, kind, severity, confidence, pdf_unicode, xhtml_unicode, pdf_page, message,
    CASE WHEN kind IN ('UNICODE_MISMATCH') THEN 'unicode' WHEN kind IN ('MISSING_WORD', 'EXTRA_WORD', 'TEXT_CHANGED') THEN 'content' WHEN kind IN ('SYMBOL_MISMATCH') THEN 'content' ELSE 'layout' END AS category FROM {differences})"""


@operator
def is_production_error(d):
    return f"WITH {FINDINGS} SELECT diff_id, coalesce(category IN ('content', 'unicode', 'structure') AND severity IN ('HIGH', 'MEDIUM'), false) AS production FROM f"


@operator
def production_status(d):
    return f"""WITH {FINDINGS} SELECT doc_id, CASE WHEN bool_or(coalesce(category IN ('content', 'unicode', 'structure') AND severity = 'HIGH', false)) THEN 'FAIL'
        WHEN bool_or(coalesce(severity IN ('MEDIUM', 'LOW'), false)) THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS status FROM f GROUP BY doc_id"""


@operator
def summarize_findings(d):
    return f"""WITH {FINDINGS} SELECT doc_id, sum(CASE WHEN severity IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END) AS real_errors, sum(CASE WHEN NOT coalesce(severity IN ('HIGH', 'MEDIUM'), false) AND confidence < 0.6e0 THEN 1 ELSE 0 END) AS need_review,
        sum(CASE WHEN kind = 'TEXT_CHANGED' THEN 1 ELSE 0 END) AS character_errors, sum(CASE WHEN category = 'unicode' THEN 1 ELSE 0 END) AS unicode_errors, sum(CASE WHEN kind = 'MISSING_WORD' THEN 1 ELSE 0 END) AS missing_content,
        sum(CASE WHEN kind = 'EXTRA_WORD' THEN 1 ELSE 0 END) AS extra_content FROM f GROUP BY doc_id"""


@operator
def fidelity_scores(d):
    return f"""WITH {FINDINGS}, t AS (SELECT doc_id, count(DISTINCT token_id) AS total FROM {{pdf_tokens}} GROUP BY doc_id),
        c AS (SELECT doc_id, category, sum(CASE WHEN confidence >= 0.6e0 THEN 1 ELSE 0 END) AS confirmed, sum(CASE WHEN confidence >= 0.6e0 THEN 0 ELSE 1 END) AS uncertain FROM f GROUP BY doc_id, category)
        SELECT c.doc_id, c.category, t.total, c.confirmed, c.uncertain, 100.0e0 * greatest(0, t.total - c.confirmed - c.uncertain) / t.total AS match_pct FROM c JOIN t ON t.doc_id = c.doc_id"""


@operator
def score_totals(d):
    return """WITH p AS (SELECT DISTINCT token_id, doc_id, text, token_kind FROM {pdf_tokens}) SELECT doc_id, count(*) AS tokens, sum(length(text)) AS characters, sum(CASE WHEN token_kind = 'word' THEN 1 ELSE 0 END) AS words FROM p GROUP BY doc_id"""


@operator
def content_fidelity(d):
    return f"""WITH {FINDINGS}, p AS (SELECT doc_id, count(DISTINCT token_id) AS n FROM {{pdf_tokens}} GROUP BY doc_id), x AS (SELECT doc_id, count(DISTINCT token_id) AS n FROM {{xhtml_tokens}} GROUP BY doc_id),
        e AS (SELECT doc_id, count(*) AS n FROM f WHERE category = 'content' GROUP BY doc_id)
        SELECT p.doc_id, 100.0e0 * greatest(0.0e0, 1 - coalesce(e.n, 0) / cast(greatest(p.n, coalesce(x.n, 0)) AS double)) AS content_pct FROM p LEFT JOIN x ON x.doc_id = p.doc_id LEFT JOIN e ON e.doc_id = p.doc_id"""


@operator
def issues_by_group(d):
    return f"WITH {FINDINGS} SELECT doc_id, category AS grp, count(*) AS n FROM f GROUP BY doc_id, category"


@operator
def style_label_counts(d):
    return f"WITH {LINES}, b AS (SELECT DISTINCT doc_id, page, block_no, kind FROM {{layout_blocks}}) SELECT l.font_size, l.bold, l.italic, b.kind, count(*) AS n FROM ln l JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND b.block_no = l.block_no GROUP BY l.font_size, l.bold, l.italic, b.kind"


@operator
def learned_retags(d):
    return f"""WITH {LINES}, b AS (SELECT DISTINCT doc_id, page, block_no, kind FROM {{layout_blocks}}),
        c AS (SELECT l.font_size, l.bold, l.italic, b.kind, count(*) AS n FROM ln l JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND b.block_no = l.block_no GROUP BY l.font_size, l.bold, l.italic, b.kind),
        s AS (SELECT *, cast(n AS double) / sum(n) OVER (PARTITION BY font_size, bold, italic) * least(1.0e0, 0.8e0 + 0.07e0 * n) AS score, row_number() OVER (PARTITION BY font_size, bold, italic ORDER BY n DESC, kind) AS k FROM c)
        SELECT font_size, bold, italic, kind, n, score FROM s WHERE k = 1 AND score >= 0.8e0"""


@operator
def page_text_quality(d):
    return f"""WITH {LINES}, t AS (SELECT doc_id, page, sum(length(text)) AS chars, sum({d.count('text', r'\p{L}')}) AS letters, sum({d.count('text', '[\\x{E000}-\\x{F8FF}\\x{FFFD}]' if d.name == 'spark' else '[\\x{E000}-\\x{F8FF}\\x{FFFD}]')}) AS garbage,
        sum({d.count('text', r'\S+')}) AS words FROM ln GROUP BY doc_id, page)
        SELECT doc_id, page, chars, words, CASE WHEN chars = 0 THEN 0.0e0 ELSE cast(letters AS double) / chars END AS alphabetic_ratio, CASE WHEN chars = 0 THEN 0.0e0 ELSE cast(garbage AS double) / chars END AS garbage_ratio,
        CASE WHEN chars < 20 THEN 'OCR_REQUIRED' WHEN garbage > 0.3e0 * chars OR letters < 0.15e0 * chars THEN 'OCR_REQUIRED' ELSE 'DIGITAL' END AS page_class FROM t"""


@operator
def classify_document_pages(d):
    return f"""WITH {LINES}, p AS (SELECT doc_id, page, bool_or(coalesce(lower(source) LIKE '%ocr%', false)) AS ocr, bool_or(coalesce(lower(source) LIKE '%pdf%', false)) AS pdf FROM ln GROUP BY doc_id, page)
        SELECT CASE WHEN ocr AND pdf THEN 'MIXED' WHEN ocr THEN 'SCANNED' WHEN pdf THEN 'DIGITAL' ELSE 'UNKNOWN' END AS page_class, count(*) AS n FROM p GROUP BY CASE WHEN ocr AND pdf THEN 'MIXED' WHEN ocr THEN 'SCANNED' WHEN pdf THEN 'DIGITAL' ELSE 'UNKNOWN' END"""


_LEAVES = f"leaf AS (SELECT c.zone_id, c.doc_id, c.text FROM cur c WHERE NOT EXISTS (SELECT 1 FROM cur k WHERE {KEY('k.parent_id')} = {KEY('c.zone_id')}))"


@operator
def leaf_content_length(d):
    return f"WITH {CUR}, {_LEAVES} SELECT doc_id, sum(coalesce(length(text), 0)) AS chars FROM leaf GROUP BY doc_id"


@operator
def content_loss(d):
    return f"""WITH {CUR}, {_LEAVES}, z AS (SELECT doc_id, sum(coalesce(length(text), 0)) AS chars FROM leaf GROUP BY doc_id), t AS (SELECT doc_id, max(n_chars) AS n FROM {{documents}} GROUP BY doc_id)
        SELECT t.doc_id, t.n AS extracted, z.chars AS in_zones, coalesce(z.chars < 0.7e0 * t.n, false) AS lost FROM t JOIN z ON z.doc_id = t.doc_id"""


@operator
def zone_confidence_counts(d):
    return "WITH f AS (SELECT DISTINCT diff_id, confidence FROM {differences}) SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'NONE' WHEN confidence >= 0.9e0 THEN 'HIGH' WHEN confidence >= 0.6e0 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM f) AS x GROUP BY bucket"


@operator
def validation_report(d):
    return f"""WITH {CUR}, i AS (
        SELECT doc_id, 'orphan_parent' AS stage, 'error' AS level_ FROM cur a WHERE {KEY('a.parent_id')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur b WHERE {KEY('b.zone_id')} = {KEY('a.parent_id')})
        UNION ALL SELECT doc_id, 'empty_text', 'warning' FROM cur WHERE tag IN ('p', 'title', 'fn') AND coalesce(text, '') = ''
        UNION ALL SELECT doc_id, 'no_level', 'warning' FROM cur WHERE level IS NULL
        UNION ALL SELECT doc_id, 'no_serial', 'info' FROM cur WHERE serial IS NULL
        UNION ALL SELECT doc_id, 'self_parent', 'error' FROM cur WHERE {KEY('parent_id')} = {KEY('zone_id')})
        SELECT doc_id, stage, level_ AS severity, count(*) AS n FROM i GROUP BY doc_id, stage, level_"""


# ---- windows

@operator
def renumber_reading_order(d):
    return f"WITH {CUR} SELECT zone_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(serial, 2147483647), created_order, zone_id) AS serial FROM cur"


@operator
def document_order(d):
    return f"WITH {CUR} SELECT zone_id, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS pos FROM cur"


@operator
def column_aware_order(d):
    return f"WITH {CUR} SELECT zone_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(column_no, 0), y0, x0, zone_id) AS slot FROM cur"


@operator
def physical_slot(d):
    return f"WITH {CUR} SELECT zone_id, coalesce(max(serial) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5e0 AS slot FROM cur"


@operator
def move_in_order(d):
    """Each page's second zone moved up one place."""
    return f"WITH {CUR}, o AS (SELECT zone_id, doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(serial, 2147483647), created_order, zone_id) AS pos FROM cur) SELECT zone_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN pos = 2 THEN 0.5e0 ELSE pos END, zone_id) AS pos FROM o"


@operator
def reading_order_checks(d):
    return f"""WITH {CUR}, o AS (SELECT zone_id, y0, column_no, lead(zone_id) OVER w AS next_id, lead(y0) OVER w AS next_y, lead(column_no) OVER w AS next_col FROM cur WINDOW w AS (PARTITION BY doc_id, page ORDER BY coalesce(serial, 2147483647), created_order, zone_id))
        SELECT zone_id, next_id FROM o WHERE next_id IS NOT NULL AND coalesce(column_no, 0) = coalesce(next_col, 0) AND next_y < y0 - 2"""


@operator
def cluster_1d(d):
    return f"""WITH {LINES}, v AS (SELECT DISTINCT doc_id, font_size AS v FROM ln), g AS (SELECT doc_id, v, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id ORDER BY v) > 0.6e0 THEN 1 ELSE 0 END AS brk FROM v),
        c AS (SELECT doc_id, v, sum(brk) OVER (PARTITION BY doc_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cl FROM g) SELECT doc_id, cl AS cluster, avg(v) AS centre, count(*) AS members FROM c GROUP BY doc_id, cl"""


@operator
def word_runs(d):
    return """WITH p AS (SELECT DISTINCT token_id, doc_id, page, paragraph, y0, x0, x1 FROM {pdf_tokens}), g AS (SELECT *, CASE WHEN lag(y0) OVER w = y0 AND x0 - lag(x1) OVER w <= 15 THEN 0 ELSE 1 END AS brk FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, token_id)),
        r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, token_id ROWS UNBOUNDED PRECEDING) AS run_no FROM g) SELECT doc_id, page, run_no, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM r GROUP BY doc_id, page, run_no"""


@operator
def column_boundaries(d):
    return f"""WITH {LINES}, v AS (SELECT doc_id, page, x0 AS v, line_id FROM ln), g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id, page ORDER BY v, line_id) > 3 THEN 1 ELSE 0 END AS brk FROM v),
        c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY v, line_id ROWS UNBOUNDED PRECEDING) AS cl FROM g) SELECT doc_id, page, cl AS boundary, avg(v) AS x, count(*) AS n FROM c GROUP BY doc_id, page, cl HAVING count(*) >= 2"""


@operator
def column_index(d):
    return """WITH b AS (SELECT DISTINCT doc_id, page, block_no, x0, column_no FROM {layout_blocks}), c AS (SELECT doc_id, page, column_no, avg(x0) AS centre FROM b GROUP BY doc_id, page, column_no)
        SELECT doc_id, page, block_no, nearest FROM (SELECT b.doc_id, b.page, b.block_no, c.column_no AS nearest, row_number() OVER (PARTITION BY b.doc_id, b.page, b.block_no ORDER BY abs(b.x0 - c.centre), c.column_no) AS k FROM b JOIN c ON c.doc_id = b.doc_id AND c.page = b.page) AS x WHERE k = 1"""


_PREV = "lag(font_size) OVER w AS p_size, lag(bold) OVER w AS p_bold, lag(y1) OVER w AS p_y1, lag(y1 - y0) OVER w AS p_h"


@operator
def group_lines_into_blocks(d):
    return f"""WITH {LINES}, g AS (SELECT *, {_PREV} FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no, line_id)),
        b AS (SELECT *, CASE WHEN p_size IS NULL OR abs(font_size - p_size) > 0.12e0 * p_size OR bold <> p_bold OR y0 - p_y1 > 1.8e0 * p_h THEN 1 ELSE 0 END AS brk FROM g)
        SELECT line_id, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY line_no, line_id ROWS UNBOUNDED PRECEDING) AS block FROM b"""


@operator
def style_breaks(d):
    return f"""WITH {LINES}, g AS (SELECT *, {_PREV} FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no, line_id)) SELECT line_id FROM g WHERE abs(font_size - p_size) > greatest(0.8e0, 0.12e0 * p_size) OR bold <> p_bold"""


@operator
def heading_levels(d):
    return f"""WITH {LINES}, {_BODY}, h AS (SELECT l.line_id, l.doc_id, l.font_size FROM ln l JOIN bs b ON b.doc_id = l.doc_id WHERE l.font_size >= 1.08e0 * b.body OR (l.bold AND l.font_size >= 0.98e0 * b.body AND {d.count('l.text', r'\S+')} <= 12))
        SELECT line_id, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC)) AS level FROM h"""


@operator
def heading_level_by_rank(d):
    return f"WITH {LINES}, s AS (SELECT DISTINCT doc_id, font_size FROM ln) SELECT doc_id, font_size, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS size_rank FROM s"


@operator
def section_map(d):
    return f"""WITH {LINES}, {_BODY} SELECT l.line_id, l.doc_id, {T.heading_kind('l.text', d)} AS kind FROM ln l JOIN bs b ON b.doc_id = l.doc_id
        WHERE {d.count('l.text', r'\S+')} <= 12 AND length(l.text) <= 90 AND (l.font_size >= 1.12e0 * b.body OR (l.bold AND {T.heading_kind('l.text', d)} IS NOT NULL))"""


@operator
def continuation_pairs(d):
    end, low = T.ends_sentence("p_text", d), T.starts_lowercase("text", d)
    hyph = d.has("p_text", r"\p{L}-\s*$")
    return f"""WITH {CUR}, o AS (SELECT zone_id, tag, text, page, x0, lag(zone_id) OVER w AS p_id, lag(tag) OVER w AS p_tag, lag(text) OVER w AS p_text, lag(page) OVER w AS p_page, lag(x0) OVER w AS p_x FROM cur WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER}))
        SELECT p_id AS previous_id, zone_id, 1 / (1 + exp(-(CAST(-1 AS double) + CASE WHEN {hyph} THEN 2.5e0 WHEN NOT {end} THEN 2.0e0 ELSE 0.0e0 END + CASE WHEN {low} THEN 2.0e0 ELSE 0.0e0 END))) AS confidence
        FROM o WHERE tag = p_tag AND page = p_page + 1 AND abs(x0 - p_x) <= 24"""


@operator
def join_continuation_paragraphs(d):
    end, low = T.ends_sentence("p_text", d), T.starts_lowercase("text", d)
    return f"""WITH {CUR}, o AS (SELECT zone_id, doc_id, text, {ORDER.replace(', zone_id', '').replace('coalesce(serial, 2147483647)', 'coalesce(serial, 2147483647) AS sr')}, lag(text) OVER w AS p_text FROM cur WHERE tag = 'p' AND text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER}))
        SELECT zone_id, sum(CASE WHEN p_text IS NOT NULL AND NOT {end} AND {low} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, sr, created_order, zone_id ROWS UNBOUNDED PRECEDING) AS paragraph FROM o"""


@operator
def verse_detect(d):
    return f"""WITH {LINES}, w AS (SELECT doc_id, page, max(x1) - min(x0) AS col_w FROM ln GROUP BY doc_id, page)
        SELECT l.doc_id, l.page, l.block_no, avg(CASE WHEN l.x1 - l.x0 < 0.8e0 * w.col_w THEN 1.0e0 ELSE 0.0e0 END) AS short_share, bool_or({d.has('l.text', '-$')}) AS hyphens, count(*) AS n
        FROM ln l JOIN w ON w.doc_id = l.doc_id AND w.page = l.page GROUP BY l.doc_id, l.page, l.block_no HAVING count(*) >= 3"""


@operator
def block_features(d):
    return f"""WITH {LINES} SELECT doc_id, page, block_no, count(*) AS n_lines, min(x0) AS x0, max(x1) - min(x0) AS width, avg(font_size) AS mean_size, avg(CASE WHEN bold THEN 1.0e0 ELSE 0.0e0 END) AS bold_share,
        avg(caps_ratio) AS caps, sum({d.count('text', r'\S+')}) AS words, avg(CASE WHEN {d.has('text', T.YEAR)} THEN 1.0e0 ELSE 0.0e0 END) AS year_share, avg(CASE WHEN {d.has('text', r'^\s*\d+[.)]')} THEN 1.0e0 ELSE 0.0e0 END) AS numbered FROM ln GROUP BY doc_id, page, block_no"""


@operator
def header_footer_band(d):
    return f"""WITH {LINES}, h AS (SELECT doc_id, page, max(y1) + 48 AS height FROM ln GROUP BY doc_id, page) SELECT l.line_id, CASE WHEN l.y1 <= 0.12e0 * h.height THEN 'header' WHEN l.y0 >= 0.9e0 * h.height THEN 'footer' ELSE 'body' END AS band FROM ln l JOIN h ON h.doc_id = l.doc_id AND h.page = l.page"""


@operator
def hyphen_candidates(d):
    p = T.line_break_hyphen("text", "nxt", d)
    return f"WITH {LINES}, o AS (SELECT line_id, text, lead(text) OVER (PARTITION BY doc_id, page ORDER BY block_no, line_no, line_id) AS nxt FROM ln) SELECT line_id, {d.get('text', r'(\S+)\s*$')} AS prefix, {d.get('nxt', r'^\s*(\S+)')} AS suffix FROM o WHERE {p}"


@operator
def index_hierarchy(d):
    last = lambda k: ("last_value(CASE WHEN level = %d THEN zone_id END IGNORE NULLS) OVER w" if d.name == "duck" else "last_value(CASE WHEN level = %d THEN zone_id END) IGNORE NULLS OVER w") % k
    return f"""WITH {CUR} SELECT zone_id, CASE level WHEN 1 THEN l0 WHEN 2 THEN l1 WHEN 3 THEN l2 END AS parent FROM (SELECT zone_id, level, {last(0)} AS l0, {last(1)} AS l1, {last(2)} AS l2 FROM cur WHERE level BETWEEN 0 AND 3
        WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS x"""


# ---- top-k and set operations

@operator
def cap_findings(d):
    """The first 20,000 findings by id: a top-k, so each task sends on no more than that."""
    return "SELECT diff_id, doc_id FROM (SELECT DISTINCT diff_id, doc_id FROM {differences}) AS f ORDER BY diff_id LIMIT 20000"


@operator
def suggest_tags(d):
    return f"""WITH {LINES}, b AS (SELECT DISTINCT doc_id, page, block_no, kind FROM {{layout_blocks}}), c AS (SELECT l.font_size, b.kind, count(*) AS n FROM ln l JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND b.block_no = l.block_no GROUP BY l.font_size, b.kind),
        s AS (SELECT font_size, kind, cast(n AS double) / sum(n) OVER (PARTITION BY font_size) AS share, row_number() OVER (PARTITION BY font_size ORDER BY n DESC, kind) AS k FROM c) SELECT font_size, kind, share, k FROM s WHERE k <= 3"""


@operator
def rank_candidates(d):
    return f"""WITH {CUR}, s AS (SELECT tag, avg(x1 - x0) AS m, stddev_pop(x1 - x0) AS sd FROM cur GROUP BY tag), v AS (SELECT zone_id, x1 - x0 AS w FROM cur WHERE tag = 'title'),
        c AS (SELECT v.zone_id, s.tag, exp(-power((v.w - s.m) / CASE WHEN s.sd < 0.000001e0 THEN 0.05e0 ELSE s.sd END, 2) / 2) AS score FROM v JOIN s ON s.tag IN ('title', 'p', 'fn', 'ref'))
        SELECT zone_id, tag, k FROM (SELECT zone_id, tag, row_number() OVER (PARTITION BY zone_id ORDER BY round(score, 9) DESC, tag) AS k FROM c) AS x WHERE k <= 2"""


def _multiset(first, second):
    return f"""WITH a AS (SELECT doc_id, text, count(*) AS n FROM (SELECT DISTINCT token_id, doc_id, text FROM {{{first}}}) AS x WHERE text IS NOT NULL GROUP BY doc_id, text), b AS (SELECT doc_id, text, count(*) AS n FROM (SELECT DISTINCT token_id, doc_id, text FROM {{{second}}}) AS y WHERE text IS NOT NULL GROUP BY doc_id, text)
        SELECT a.doc_id, a.text, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON b.doc_id = a.doc_id AND b.text = a.text WHERE a.n > coalesce(b.n, 0)"""


@operator
def lost_words(d):
    return _multiset("pdf_tokens", "xhtml_tokens")


@operator
def added_words(d):
    return _multiset("xhtml_tokens", "pdf_tokens")


@operator
def vocabulary(d):
    w = T.tokenize_exact("replace(lower(text), 'ς', 'σ')", d)
    rows = f"SELECT explode({w}) AS w FROM cur" if d.name == "spark" else f"SELECT unnest({w}) AS w FROM cur"
    return f"WITH {CUR}, t AS ({rows}) SELECT w AS word, count(*) AS n FROM t WHERE {d.has('w', r'\p{L}')} GROUP BY w"


@operator
def findings_union(d):
    return f"""WITH {FINDINGS}, {CUR} SELECT 'difference' AS origin, cast(diff_id AS {'string' if d.name == 'spark' else 'varchar'}) AS id, kind AS type, doc_id FROM f
        UNION ALL SELECT 'zone', zone_id, 'NO_LEVEL', doc_id FROM cur WHERE level IS NULL"""


@operator
def normalize_span_union(d):
    """Touching or overlapping y intervals of a page's lines merged."""
    return f"""WITH {LINES}, v AS (SELECT DISTINCT doc_id, page, y0, y1 FROM ln WHERE y1 > y0), m AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
        g AS (SELECT *, sum(CASE WHEN reach >= y0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS span FROM m) SELECT doc_id, page, span, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM g GROUP BY doc_id, page, span"""


# ---- scores

@operator
def confidence_bucket(d):
    return "SELECT DISTINCT diff_id, CASE WHEN confidence >= 0.9e0 AND NOT isnan(confidence) THEN 'HIGH' WHEN confidence >= 0.6e0 AND NOT isnan(confidence) THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM {differences}"


@operator
def ocr_confidence(d):
    return "SELECT DISTINCT diff_id, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.5e0 ELSE least(1.0e0, greatest(0.0e0, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END AS confidence FROM {differences}"


@operator
def noisy_or(d):
    return "WITH f AS (SELECT DISTINCT diff_id, doc_id, confidence FROM {differences} WHERE confidence IS NOT NULL AND NOT isnan(confidence)) SELECT doc_id, round(1 - exp(sum(ln(1 - least(0.99e0, confidence)))), 9) AS score FROM f GROUP BY doc_id"


@operator
def logistic(d):
    return f"WITH {LINES} SELECT line_id, 1 / (1 + exp(-(caps_ratio * 4 - 2))) AS p FROM ln"


@operator
def iou(d):
    return f"""WITH {CUR} SELECT a.zone_id AS zone_a, b.zone_id AS zone_b, {CROSS} / ({AREA('a')} + {AREA('b')} - {CROSS}) AS iou FROM cur a JOIN cur b ON a.doc_id = b.doc_id AND a.page = b.page AND {KEY('b.parent_id')} = {KEY('a.zone_id')} WHERE {AREA('a')} + {AREA('b')} - {CROSS} > 0"""


@operator
def numeric_similarity(d):
    return f"""WITH {LINES}, s AS (SELECT doc_id, avg(font_size) AS m, stddev_pop(font_size) AS sd FROM ln GROUP BY doc_id) SELECT l.line_id, round(exp(-power((l.font_size - s.m) / CASE WHEN s.sd < 0.000001e0 THEN 0.05e0 ELSE s.sd END, 2) / 2), 9) AS similarity FROM ln l JOIN s ON s.doc_id = l.doc_id"""


@operator
def bool_similarity(d):
    return f"WITH {LINES}, s AS (SELECT doc_id, avg(CASE WHEN bold THEN 1.0e0 ELSE 0.0e0 END) AS r FROM ln GROUP BY doc_id) SELECT l.line_id, 1 - abs(CASE WHEN l.bold THEN 1.0e0 ELSE 0.0e0 END - s.r) AS similarity FROM ln l JOIN s ON s.doc_id = l.doc_id"


@operator
def classify_alignment(d):
    return f"""WITH {LINES}, c AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM ln GROUP BY doc_id, page) SELECT a.line_id, CASE WHEN abs(a.x0 - c.l) <= 6 AND abs(c.r - a.x1) <= 6 THEN 'JUSTIFIED' WHEN abs((a.x0 - c.l) - (c.r - a.x1)) <= 6 THEN 'CENTER'
        WHEN abs(a.x0 - c.l) <= 6 THEN 'LEFT' WHEN abs(c.r - a.x1) <= 6 THEN 'RIGHT' ELSE 'UNKNOWN' END AS alignment FROM ln a JOIN c ON c.doc_id = a.doc_id AND c.page = a.page"""


@operator
def compute_features(d):
    return f"""WITH {LINES}, {_BODY}, c AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r, max(y1) AS h FROM ln GROUP BY doc_id, page)
        SELECT a.line_id, a.x0 / nullif(c.r, 0) AS x, a.y0 / nullif(c.h, 0) AS y, (a.x1 - a.x0) / nullif(c.r, 0) AS w, (a.x0 - c.l) / nullif(c.r, 0) AS indent, a.font_size / nullif(b.body, 0) AS font_ratio, length(a.text) AS text_len FROM ln a JOIN c ON c.doc_id = a.doc_id AND c.page = a.page JOIN bs b ON b.doc_id = a.doc_id"""


@operator
def heading_score(d):
    return f"""WITH {LINES}, {_BODY} SELECT a.line_id, least(1.0e0, 0.4e0 * greatest(0.0e0, least(1.0e0, (a.font_size / nullif(b.body, 0) - 1) / 0.5e0)) + CASE WHEN a.bold THEN 0.25e0 ELSE 0.0e0 END + 0.15e0 * coalesce(a.caps_ratio, 0)
        + CASE WHEN {T.ends_sentence('a.text', d)} THEN 0.0e0 ELSE 0.2e0 END) AS score FROM ln a JOIN bs b ON b.doc_id = a.doc_id"""


@operator
def px_pt_mapping(d):
    return f"WITH {LINES} SELECT line_id, x0 * 300 / 72 AS px0, y0 * 300 / 72 AS py0, x1 * 300 / 72 AS px1, y1 * 300 / 72 AS py1 FROM ln"


@operator
def hamming(d):
    pop = "bit_count(a # b)" if d.name == "_" else ("bit_count(xor(a, b))" if d.name == "duck" else "bit_count(a ^ b)")
    return f"SELECT a, b, {pop} AS distance, 1 - {pop} / 64.0e0 AS similarity FROM (VALUES (CAST(255 AS bigint), CAST(254 AS bigint)), (CAST(0 AS bigint), CAST(0 AS bigint)), (CAST(1023 AS bigint), CAST(0 AS bigint))) AS t(a, b)"


# ---- zones as records

def _attr(d, k):
    return f"attributes['{k}']"


@operator
def zone_state(d):
    return f"""WITH {CUR} SELECT zone_id, coalesce({_attr(d, 'locked')} = 'true', false) AS locked, coalesce({_attr(d, 'auto')} = 'true', false) AS is_auto, {_attr(d, 'lang')} AS lang, attributes IS NULL AS no_attributes FROM cur"""


@operator
def trusted_zones(d):
    return f"WITH {CUR} SELECT zone_id, tag FROM cur WHERE coalesce({_attr(d, 'auto')}, 'false') <> 'true' AND text <> ''"


@operator
def blocks_by_kind(d):
    return "SELECT DISTINCT doc_id, page, block_no, kind FROM {layout_blocks} WHERE kind IN ('text', 'list_item', 'footnote')"


@operator
def validate_hierarchy(d):
    return f"""WITH {CUR} SELECT c.zone_id, CASE WHEN {KEY('c.parent_id')} = {KEY('c.zone_id')} THEN 'SELF_PARENT' WHEN p.zone_id IS NULL THEN 'MISSING_PARENT' WHEN c.level IS NULL THEN 'NO_LEVEL' WHEN p.level + 1 <> c.level THEN 'WRONG_LEVEL' ELSE 'OK' END AS verdict
        FROM cur c LEFT JOIN cur p ON {KEY('p.zone_id')} = {KEY('c.parent_id')} WHERE {KEY('c.parent_id')} IS NOT NULL"""


@operator
def split_zone(d):
    """Zones of several lines cut into one piece a line, at serial + i / 10000."""
    rows = "SELECT zone_id, serial, posexplode(split(text, '\\\\n')) AS (i, piece) FROM cur WHERE contains(text, '\\n')" if d.name == "spark" else "SELECT zone_id, serial, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cur WHERE contains(text, chr(10))"
    return f"WITH {CUR}, r AS ({rows}) SELECT zone_id, i, piece, serial + i * 0.0001e0 AS serial FROM r"


@operator
def delete_zone(d):
    """Zones left when the roots without text and their children are deleted."""
    return f"WITH {CUR} SELECT c.zone_id FROM cur c WHERE NOT ({KEY('c.parent_id')} IS NULL AND coalesce(c.text, '') = '') AND NOT EXISTS (SELECT 1 FROM cur p WHERE {KEY('p.zone_id')} = {KEY('c.parent_id')} AND {KEY('p.parent_id')} IS NULL AND coalesce(p.text, '') = '')"


@operator
def merge_with_previous(d):
    return f"""WITH {CUR}, o AS (SELECT zone_id, tag, lag(zone_id) OVER w AS p_id, lag(tag) OVER w AS p_tag FROM cur WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER})) SELECT zone_id, CASE WHEN tag = p_tag THEN p_id END AS merge_target FROM o"""
