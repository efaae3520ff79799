"""More operators as SQL: typed differences, learning from labels, references, layout changes, tag rules.

Rules that work on vocabularies or models take them as literal rows, joined like any
other table; each row set is small and fixed.
"""

from __future__ import annotations

from quirelight.functions import text as T
from quirelight.operators.relational import _BODY, AREA, CUR, KEY, LINES, ORDER, operator


def _str(d):
    return "string" if d.name == "spark" else "varchar"


PAIRED = "pr AS (SELECT DISTINCT p.token_id, p.doc_id, p.paragraph, p.text AS a, x.text AS b FROM {pdf_tokens} p JOIN {xhtml_tokens} x ON x.pdf_token_id = p.token_id WHERE p.text IS NOT NULL AND x.text IS NOT NULL)"
PARAS = "z1 AS (SELECT zone_id, doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY " + ORDER + ") AS pos FROM cur WHERE tag = 'p' AND text <> '')"


# ---- typed differences

@operator
def compare_chars(d):
    """Pairs of tokens of one length: how many characters differ, and the first place."""
    if d.name == "spark":
        rows = "SELECT token_id, posexplode(arrays_zip(split(a, ''), split(b, ''))) AS (i, c) FROM pr WHERE length(a) = length(b) AND a <> b"
        return f"WITH {PAIRED}, ch AS ({rows}) SELECT token_id, count(*) AS n_changed, min(i) AS first_at FROM ch WHERE c.`0` <> c.`1` GROUP BY token_id"
    rows = "SELECT token_id, unnest(list_zip(string_split(a, ''), string_split(b, ''))) AS c, generate_subscripts(string_split(a, ''), 1) - 1 AS i FROM pr WHERE length(a) = length(b) AND a <> b"
    return f"WITH {PAIRED}, ch AS ({rows}) SELECT token_id, count(*) AS n_changed, min(i) AS first_at FROM ch WHERE c[1] <> c[2] GROUP BY token_id"


@operator
def space_run_change(d):
    """Lines with runs of blanks that the single-spaced text of the same words doesn't have."""
    return f"WITH {LINES} SELECT line_id, {d.count('text', ' {2,}')} AS runs FROM ln WHERE {d.count('text', ' {2,}')} > 0"


@operator
def content_fast_path(d):
    """Documents whose two token sequences are the same: no alignment needed."""
    agg = (lambda k, t: f"array_join(transform(array_sort(collect_list(named_struct('k', {k}, 't', {t}))), s -> s.t), ' ')") if d.name == "spark" else (lambda k, t: f"string_agg({t}, ' ' ORDER BY {k}, {t})")
    return f"""WITH p AS (SELECT doc_id, {agg('token_id', 'text')} AS t FROM (SELECT DISTINCT doc_id, token_id, text FROM {{pdf_tokens}} WHERE text IS NOT NULL) AS a GROUP BY doc_id),
        x AS (SELECT doc_id, {agg('token_id', 'text')} AS t FROM (SELECT DISTINCT doc_id, token_id, text FROM {{xhtml_tokens}} WHERE text IS NOT NULL) AS b GROUP BY doc_id) SELECT p.doc_id, p.t = x.t AS same FROM p JOIN x ON x.doc_id = p.doc_id"""


@operator
def margin_change(d):
    return f"""WITH {LINES}, m AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM ln GROUP BY doc_id, page), o AS (SELECT doc_id, page, l - lag(l) OVER w AS dl, r - lag(r) OVER w AS dr FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page))
        SELECT doc_id, page, dl, dr FROM o WHERE abs(dl) > 4 OR abs(dr) > 4"""


@operator
def spacing_change(d):
    return f"""WITH {LINES}, s AS (SELECT doc_id, page, block_no, avg(lead_) AS line_gap FROM (SELECT doc_id, page, block_no, y0 - lag(y0) OVER (PARTITION BY doc_id, page, block_no ORDER BY line_no, line_id) AS lead_ FROM ln) AS q WHERE lead_ IS NOT NULL GROUP BY doc_id, page, block_no)
        SELECT doc_id, page, block_no, line_gap FROM s WHERE line_gap > 0"""


@operator
def font_change(d):
    return f"WITH {LINES}, o AS (SELECT line_id, font, font_size, lag(font) OVER w AS pf, lag(font_size) OVER w AS ps FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_no, line_no, line_id)) SELECT line_id, coalesce(font <> pf, false) AS font_changed, coalesce(abs(font_size - ps) > 0.5e0, false) AS size_changed FROM o WHERE font <> pf OR abs(font_size - ps) > 0.5e0"


@operator
def column_change(d):
    return "WITH b AS (SELECT DISTINCT doc_id, page, column_no FROM {layout_blocks}), c AS (SELECT doc_id, page, count(*) AS n FROM b GROUP BY doc_id, page), o AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM c) SELECT doc_id, page, n AS columns, before FROM o WHERE n <> before"


@operator
def align_pages(d):
    """Pages of one document with the same text: repeats, by the hash of their lines."""
    agg = "md5(array_join(transform(array_sort(collect_list(named_struct('k', line_no, 'i', line_id, 't', text))), s -> s.t), ' '))" if d.name == "spark" else "md5(string_agg(text, ' ' ORDER BY line_no, line_id))"
    return f"WITH {LINES}, p AS (SELECT doc_id, page, {agg} AS h FROM ln WHERE text IS NOT NULL GROUP BY doc_id, page) SELECT doc_id, h, count(*) AS pages, min(page) AS first_page FROM p GROUP BY doc_id, h"


@operator
def ocr_content_issues(d):
    return f"""WITH {PAIRED} SELECT token_id, CASE WHEN {d.sub('a', r'[\p{P}\p{S}]+')} = {d.sub('b', r'[\p{P}\p{S}]+')} THEN 'PUNCTUATION' ELSE 'CONTENT' END AS kind FROM pr WHERE a <> b"""


# ---- learning and tag rules

@operator
def merge_templates(d):
    """Samples of two halves pooled: the profile is the same as over all."""
    half = "SELECT tag, x1 - x0 AS w FROM cur WHERE doc_id % 2 = "
    return f"WITH {CUR} SELECT tag, count(*) AS n, avg(w) AS mean_w FROM ({half}0 UNION ALL {half}1) AS u GROUP BY tag"


@operator
def retag_learning(d):
    return "WITH b AS (SELECT DISTINCT doc_id, page, block_no, kind, coalesce(region, '') AS region FROM {layout_blocks}) SELECT region, kind, count(*) AS n, cast(count(*) AS double) / sum(count(*)) OVER (PARTITION BY region) AS share FROM b GROUP BY region, kind"


_ROLES = "(VALUES ('heading', 'title'), ('heading', 'head'), ('note', 'fn'), ('note', 'footnote'), ('entry', 'ref'), ('entry', 'item'), ('body', 'p'), ('body', 'para')) AS r(role, word)"


def _role_scores(d):
    """Tags by the words of their names, joined with the words of roles; less 0.1 for each further piece."""
    pieces = d.all("tag", "[a-z]+")
    un = "explode" if d.name == "spark" else "unnest"
    return f"t AS (SELECT tag, {d.size(pieces)} AS n, {un}({pieces}) AS word FROM (SELECT DISTINCT tag FROM cur) AS q), s AS (SELECT t.tag, r.role, max(1 - 0.1e0 * (t.n - 1)) AS score FROM t JOIN {_ROLES} ON r.word = t.word GROUP BY t.tag, r.role)"


@operator
def role_to_tags(d):
    return f"WITH {CUR}, {_role_scores(d)} SELECT tag, role, score FROM s"


@operator
def best_role_option(d):
    return f"WITH {CUR}, {_role_scores(d)} SELECT role, tag FROM (SELECT role, tag, row_number() OVER (PARTITION BY role ORDER BY score DESC, tag) AS k FROM s) AS x WHERE k = 1"


@operator
def tag_family_neighbour(d):
    fam = "(VALUES ('list', 'l'), ('list-item', 'l'), ('ref', 'r'), ('ref-list', 'r'), ('sec', 's'), ('title', 's'), ('p', 't'), ('disp-quote', 't'), ('fn', 'n'), ('article', 'd'), ('book-part', 'd'))"
    return f"""WITH {CUR}, fam AS (SELECT * FROM {fam} AS f(tag, family)), o AS (SELECT zone_id, tag, lag(tag) OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS before FROM cur) SELECT o.zone_id FROM o JOIN fam a ON a.tag = o.tag JOIN fam b ON b.tag = o.before AND b.family = a.family"""


@operator
def structural_verdict(d):
    """A tag under its parent: refused by the model, rare in the corpus, or common."""
    rules = "(VALUES ('sec', 'p'), ('sec', 'title'), ('sec', 'sec'), ('sec', 'list'), ('sec', 'fn'), ('sec', 'disp-quote'), ('sec', 'ref-list'), ('list', 'list-item'), ('ref-list', 'ref'), ('article', 'sec'), ('article', 'title'), ('book-part', 'sec'), ('book-part', 'title'), ('book-part', 'article'), ('book-part', 'book-part'))"
    return f"""WITH {CUR}, ok AS (SELECT * FROM {rules} AS r(parent, child)), pc AS (SELECT p.tag AS parent, c.tag AS child, count(*) AS n FROM cur c JOIN cur p ON {KEY('p.zone_id')} = {KEY('c.parent_id')} GROUP BY p.tag, c.tag)
        SELECT pc.parent, pc.child, pc.n, CASE WHEN ok.parent IS NULL THEN 'REFUSED' WHEN pc.n < 10 THEN 'RARE' ELSE 'COMMON' END AS verdict FROM pc LEFT JOIN ok ON ok.parent = pc.parent AND ok.child = pc.child"""


@operator
def tag_confidence(d):
    return f"""WITH {LINES}, {_BODY}, b AS (SELECT doc_id, page, block_no, min(kind) AS kind FROM {{layout_blocks}} GROUP BY doc_id, page, block_no)
        SELECT l.line_id, 100 * (0.15e0 * least(1.0e0, l.x0 / 100) + 0.1e0 * CASE WHEN l.bold THEN 1.0e0 ELSE 0.0e0 END + 0.35e0 * CASE WHEN b.kind = 'text' THEN 0.9e0 ELSE 0.6e0 END + 0.4e0 * least(1.0e0, l.font_size / nullif(2 * s.body, 0))) AS confidence
        FROM ln l JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND b.block_no = l.block_no JOIN bs s ON s.doc_id = l.doc_id"""


@operator
def fallback_scores(d):
    return f"WITH {LINES}, {_BODY} SELECT l.line_id, CASE WHEN l.bold AND l.font_size > s.body THEN 0.7e0 ELSE 0.2e0 END AS title, CASE WHEN l.font_size < s.body THEN 0.6e0 ELSE 0.1e0 END AS note, CASE WHEN l.font_size = s.body THEN 0.8e0 ELSE 0.3e0 END AS body FROM ln l JOIN bs s ON s.doc_id = l.doc_id"


@operator
def score_candidate(d):
    """Zones against the profile of their own tag: width and height, each by its distance in deviations."""
    sim = lambda v, m, s: f"exp(-power(({v} - {m}) / CASE WHEN {s} < 0.000001e0 THEN 0.05e0 ELSE {s} END, 2) / 2)"
    return f"""WITH {CUR}, p AS (SELECT tag, avg(x1 - x0) AS mw, stddev_pop(x1 - x0) AS sw, avg(y1 - y0) AS mh, stddev_pop(y1 - y0) AS sh FROM cur GROUP BY tag)
        SELECT c.zone_id, round((2 * {sim('(c.x1 - c.x0)', 'p.mw', 'p.sw')} + {sim('(c.y1 - c.y0)', 'p.mh', 'p.sh')}) / 3, 8) AS score FROM cur c JOIN p ON p.tag = c.tag"""


@operator
def confidence_combine(d):
    """Weighted mean of the scores that are there; nulls go first, so the first weights count."""
    rows = "(VALUES (1, 0.9e0, 0.5e0, 0.1e0), (2, CAST(NULL AS double), 0.5e0, 0.1e0), (3, CAST(NULL AS double), CAST(NULL AS double), CAST(NULL AS double))) AS t(id, a, b, c)"
    first = "CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b ELSE c END"
    second = "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b WHEN (a IS NOT NULL OR b IS NOT NULL) AND c IS NOT NULL THEN c END"
    third = "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN c END"
    s = f"SELECT id, {first} AS s1, {second} AS s2, {third} AS s3 FROM {rows}"
    w = lambda k, v: f"CASE WHEN s{k} IS NULL THEN 0.0e0 ELSE {v} END"
    return f"SELECT id, ({w(1, '3 * s1')} + {w(2, '2 * s2')} + {w(3, 's3')}) / nullif({w(1, '3.0e0')} + {w(2, '2.0e0')} + {w(3, '1.0e0')}, 0) AS score FROM ({s}) AS q"


# ---- sections, tables, references

@operator
def index_levels(d):
    return f"""WITH {LINES}, v AS (SELECT doc_id, line_id, round(x0 / 12) AS lv FROM ln), c AS (SELECT doc_id, lv, count(*) AS n FROM v GROUP BY doc_id, lv), r AS (SELECT doc_id, lv, dense_rank() OVER (PARTITION BY doc_id ORDER BY lv) AS level FROM c WHERE n >= 2)
        SELECT v.line_id, r.level, r.level IS NULL AS outlier FROM v LEFT JOIN r ON r.doc_id = v.doc_id AND r.lv = v.lv"""


@operator
def paragraph_segments(d):
    """Lines of body blocks: a new paragraph at an indent or after a wide gap."""
    return f"""WITH {LINES}, o AS (SELECT line_id, doc_id, page, block_no, line_no, x0 - min(x0) OVER (PARTITION BY doc_id, page) AS indent, y0 - lag(y1) OVER w AS gap, y1 - y0 AS h FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no, line_id)),
        b AS (SELECT *, CASE WHEN gap IS NULL OR indent > 6 OR gap > 1.4e0 * h THEN 1 ELSE 0 END AS opens FROM o) SELECT line_id, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY line_no, line_id ROWS UNBOUNDED PRECEDING) AS paragraph FROM b"""


@operator
def split_section_entries(d):
    """Zones of notes and references cut where a numbered entry opens."""
    return f"""WITH {CUR} SELECT zone_id, {d.has('text', r'^\s*(?:\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}[.)]?\s)')} AS opens, {T.author_start('text', d)} AS author FROM cur WHERE tag IN ('fn', 'ref') AND text <> ''"""


@operator
def numbered_notes(d):
    return f"WITH {CUR} SELECT zone_id, {d.get('text', r'^\s*(\d{1,3})\s', 1)} AS number, {d.sub('text', r'^\s*\d{1,3}\s+')} AS note FROM cur WHERE tag = 'fn' AND {d.has('text', r'^\s*\d{1,3}\s')}"


@operator
def section_roles(d):
    k = T.heading_kind("text", d)
    last = f"last_value(CASE WHEN tag = 'title' THEN coalesce({k}, 'body') END IGNORE NULLS)" if d.name == "duck" else f"last_value(CASE WHEN tag = 'title' THEN coalesce({k}, 'body') END) IGNORE NULLS"
    return f"WITH {CUR} SELECT zone_id, coalesce({last} OVER (PARTITION BY doc_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS section FROM cur WHERE tag IN ('title', 'p', 'fn', 'ref')"


@operator
def table_rows(d):
    """Words of a table: the column on the fewest lines is the anchor, each of its lines opens a row."""
    w = "(VALUES (1, 0, 'Name'), (1, 1, 'Year'), (2, 0, 'long'), (3, 0, 'Second'), (3, 1, '1902'), (4, 0, 'more'), (4, 2, 'x'), (5, 2, 'y'), (5, 1, '1903')) AS t(line, col, txt)"
    return f"""WITH w AS (SELECT * FROM {w}), a AS (SELECT col, count(DISTINCT line) AS n FROM w GROUP BY col), m AS (SELECT col FROM (SELECT col, row_number() OVER (ORDER BY n, col) AS k FROM a) AS q WHERE k = 1),
        o AS (SELECT w.line, max(CASE WHEN w.col = (SELECT max(col) FROM m) THEN 1 ELSE 0 END) AS opens FROM w GROUP BY w.line) SELECT line, sum(opens) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS row_no FROM o"""


@operator
def match_table_children(d):
    return f"""WITH {CUR} SELECT zone_id, child FROM (SELECT a.zone_id, b.zone_id AS child, row_number() OVER (PARTITION BY b.zone_id ORDER BY greatest(0.0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) DESC, a.zone_id) AS k
        FROM cur a JOIN cur b ON a.doc_id = b.doc_id AND a.page = b.page AND a.tag = 'list' AND b.tag = 'list-item' AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) AS x WHERE k = 1"""


@operator
def find_segment(d):
    """The paragraph of a document's text that holds its middle character."""
    n = "length(text)"
    return f"""WITH {CUR}, {PARAS}, s AS (SELECT zone_id, doc_id, sum({n}) OVER (PARTITION BY doc_id ORDER BY pos) - {n} AS start_, sum({n}) OVER (PARTITION BY doc_id ORDER BY pos) AS stop_, sum({n}) OVER (PARTITION BY doc_id) AS total FROM z1)
        SELECT doc_id, zone_id FROM s WHERE start_ <= floor(total / 2.0e0) AND floor(total / 2.0e0) < stop_"""


@operator
def document_tree(d):
    """Parent of each title by level: the nearest one before with a smaller level, by a window for each level."""
    last = (lambda k: f"last_value(CASE WHEN level = {k} THEN pos END IGNORE NULLS) OVER w") if d.name == "duck" else (lambda k: f"last_value(CASE WHEN level = {k} THEN pos END) IGNORE NULLS OVER w")
    cols = ", ".join(f"{last(k)} AS l{k}" for k in range(6))
    best = " ".join(f"WHEN {k} THEN greatest({', '.join(f'coalesce(l{j}, 0)' for j in range(k))}, 0)" for k in range(1, 6))
    return f"""WITH {CUR}, t AS (SELECT zone_id, doc_id, least(level, 5) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS pos FROM cur WHERE tag = 'title' AND level IS NOT NULL),
        w1 AS (SELECT zone_id, doc_id, level, pos, {cols} FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT zone_id, CASE level {best} ELSE 0 END AS parent_pos FROM w1"""


@operator
def contextual_roles(d):
    return f"""WITH {CUR}, o AS (SELECT zone_id, tag, text, lag(tag) OVER w AS before, lead(tag) OVER w AS after FROM cur WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER}))
        SELECT zone_id, CASE WHEN before = 'disp-quote' AND length(text) < 60 THEN 'attribution' WHEN before = 'title' AND length(text) < 40 THEN 'names' WHEN tag = 'ref' AND (before = 'ref' OR after = 'ref') THEN 'reference' ELSE 'body' END AS role FROM o WHERE text <> ''"""


# ---- references, names, spelling

@operator
def spelling(d):
    """Words of titles, and whether the rest of the corpus lacks them."""
    w = d.all("lower(text)", r"\p{L}+")
    un = "explode" if d.name == "spark" else "unnest"
    return f"WITH {CUR}, t AS (SELECT zone_id, {un}({w}) AS word FROM cur WHERE tag = 'title'), v AS (SELECT DISTINCT {un}({w}) AS word FROM cur WHERE tag <> 'title') SELECT DISTINCT t.word, v.word IS NULL AS unknown FROM t LEFT JOIN v ON v.word = t.word WHERE {d.has('t.word', '^[a-z]+$')}"


@operator
def resolve_language(d):
    return f"WITH {CUR}, s AS (SELECT zone_id, attributes['lang'] AS label FROM cur), c AS (SELECT DISTINCT spelling, lang_code FROM {{language_codes}}) SELECT s.zone_id, coalesce(c.lang_code, 'und') AS lang FROM s LEFT JOIN c ON c.spelling = s.label"


@operator
def ocr_language(d):
    return "SELECT DISTINCT lang_code, script, CASE WHEN lang_code = 'zh' THEN 'ch' WHEN lang_code = 'ja' THEN 'japan' WHEN lang_code = 'ko' THEN 'korean' WHEN lang_code = 'de' THEN 'german' WHEN script = 'Cyrillic' THEN 'cyrillic' WHEN script = 'Latin' THEN 'latin' ELSE lang_code END AS model FROM {language_codes}"


@operator
def dehyphenate_join(d):
    """Lines of a block joined: a hyphen before a small letter goes with the break."""
    agg = "array_join(transform(array_sort(collect_list(named_struct('k', line_no, 'i', line_id, 't', text))), s -> s.t), '\\n')" if d.name == "spark" else "string_agg(text, chr(10) ORDER BY line_no, line_id)"
    x = d.sub("t", r"(\p{Ll})[-‐]\n(\p{Ll})", "@1@2")
    return f"WITH {LINES}, b AS (SELECT doc_id, page, block_no, {agg} AS t FROM ln WHERE text IS NOT NULL GROUP BY doc_id, page, block_no) SELECT doc_id, page, block_no, {d.sub(x, '[ ]*\\n[ ]*', ' ')} AS joined FROM b"


# ---- attributes and caches

@operator
def zone_attributes(d):
    keys = "array_sort(map_keys(attributes))" if d.name == "spark" else "list_sort(map_keys(attributes))"
    return f"WITH {CUR} SELECT zone_id, {keys} AS attribute_names FROM cur WHERE attributes IS NOT NULL"


@operator
def settings_fingerprint(d):
    body = f"concat_ws('|', coalesce(font, ''), cast(bold AS {_str(d)}), cast(italic AS {_str(d)}))"
    return f"WITH {LINES} SELECT line_id, substring(md5({body}), 1, 16) AS fingerprint FROM ln"


@operator
def ocr_cache_lookup(d):
    """The latest load of each page: what a cache by document and page would give."""
    return "SELECT doc_id, page, max(loaded_at) AS loaded_at, count(DISTINCT line_id) AS n FROM {line_features} GROUP BY doc_id, page"


@operator
def unresolved_issues(d):
    return "WITH t AS (SELECT DISTINCT token_id, doc_id, proof_status FROM {pdf_tokens}) SELECT doc_id, count(*) AS n, sum(CASE WHEN proof_status IS NULL OR proof_status <> 'MATCH' THEN 1 ELSE 0 END) AS unresolved FROM t GROUP BY doc_id"


@operator
def detect_alignment(d):
    """Alignment of a block by how its lines meet the edges, its last line left out."""
    return f"""WITH {LINES}, o AS (SELECT *, min(x0) OVER w AS l, max(x1) OVER w AS r, max(line_no) OVER w AS last_no FROM ln WINDOW w AS (PARTITION BY doc_id, page, block_no))
        SELECT doc_id, page, block_no, avg(CASE WHEN x0 - l <= 3 THEN 1.0e0 ELSE 0.0e0 END) AS left_share, avg(CASE WHEN r - x1 <= 3 THEN 1.0e0 ELSE 0.0e0 END) AS right_share FROM o WHERE line_no < last_no GROUP BY doc_id, page, block_no"""


@operator
def decoration_ranges(d):
    """Rules under characters: a rule in the band below the baseline that covers most of a character."""
    ch = "(VALUES (0, 0.0e0, 5.0e0), (1, 5.0e0, 10.0e0), (2, 10.0e0, 15.0e0), (3, 15.0e0, 20.0e0)) AS c(i, x0, x1)"
    return f"""WITH c AS (SELECT * FROM {ch}), r AS (SELECT * FROM (VALUES (4.0e0, 12.0e0), (12.0e0, 15.5e0)) AS q(a, b)), m AS (SELECT min(a) AS a, max(b) AS b FROM r), f AS (SELECT c.i, (least(c.x1, m.b) - greatest(c.x0, m.a)) / (c.x1 - c.x0) AS cover FROM c JOIN m ON m.a < c.x1 AND m.b > c.x0),
        g AS (SELECT i, i - row_number() OVER (ORDER BY i) AS island FROM f WHERE cover >= 0.6e0) SELECT min(i) AS start_, max(i) + 1 AS stop_ FROM g GROUP BY island"""


@operator
def add_zone(d):
    """Where a zone of a page's first line would hang: the smallest zone around it."""
    return f"""WITH {CUR}, {LINES}, f AS (SELECT doc_id, page, line_id, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, line_id) AS k FROM ln) AS q WHERE k = 1)
        SELECT line_id, parent FROM (SELECT f.line_id, z.zone_id AS parent, row_number() OVER (PARTITION BY f.line_id ORDER BY {AREA('z')}, z.zone_id) AS k FROM f LEFT JOIN cur z ON z.doc_id = f.doc_id AND z.page = f.page AND z.x0 <= f.x0 + 2 AND z.y0 <= f.y0 + 2 AND z.x1 >= f.x1 - 2 AND z.y1 >= f.y1 - 2) AS x WHERE k = 1"""


@operator
def doc_frequency(d):
    return f"WITH {CUR} SELECT tag, count(DISTINCT doc_id) AS n_docs FROM cur GROUP BY tag"


@operator
def element_frequency(d):
    return f"WITH {CUR} SELECT tag, cast(count(*) AS double) / sum(count(*)) OVER () AS frequency FROM cur GROUP BY tag"


@operator
def order_page(d):
    """Zones of a page in the order of their columns and places, as a new serial."""
    return f"WITH {CUR} SELECT zone_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(column_no, 0), y0, x0, zone_id) AS serial FROM cur"


@operator
def overlap_check(d):
    """Every zone that nearly covers another of its tag on its page, or is covered by it."""
    from quirelight.operators.relational import overlapping_zones

    return f"SELECT DISTINCT z FROM (SELECT zone_a AS z FROM ({overlapping_zones(d)}) AS p UNION ALL SELECT zone_b FROM ({overlapping_zones(d)}) AS q) AS u"


@operator
def template_union(d):
    half = "SELECT doc_id, tag, x1 - x0 AS w, y1 - y0 AS h FROM cur WHERE doc_id % 2 = "
    return f"WITH {CUR} SELECT tag, count(*) AS samples FROM ({half}0 UNION ALL {half}1) AS u GROUP BY tag"


@operator
def text_usable(d):
    """Pages whose text can be used as it is, and those that need OCR."""
    return f"WITH {LINES}, p AS (SELECT doc_id, page, sum(length(text)) AS chars, sum({d.count('text', r'\p{L}')}) AS letters FROM ln GROUP BY doc_id, page) SELECT doc_id, page, coalesce(chars >= 20 AND letters >= 0.15e0 * chars, false) AS usable, NOT coalesce(chars >= 20 AND letters >= 0.15e0 * chars, false) AS needs_ocr FROM p"


@operator
def position_change(d):
    return f"WITH {LINES}, o AS (SELECT line_id, x0 - lag(x0) OVER w AS dx FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_no, line_no, line_id)) SELECT line_id, dx FROM o WHERE abs(dx) > 3"


@operator
def alignment_change(d):
    """Lines whose alignment differs from the line before them on the page; unknown ones aside."""
    from quirelight.operators.relational import classify_alignment

    return f"WITH al AS ({classify_alignment(d)}), l2 AS (SELECT DISTINCT line_id, doc_id, page, block_no, line_no FROM {{line_features}} WHERE line_id IS NOT NULL), o AS (SELECT al.line_id, al.alignment, lag(al.alignment) OVER (PARTITION BY l2.doc_id, l2.page ORDER BY l2.block_no, l2.line_no, l2.line_id) AS before FROM al JOIN l2 ON l2.line_id = al.line_id) SELECT line_id, before, alignment FROM o WHERE before <> alignment AND before <> 'UNKNOWN' AND alignment <> 'UNKNOWN'"


@operator
def zone_chars(d):
    """Characters of the lines whose centre lies in a zone."""
    return f"""WITH {CUR}, {LINES} SELECT z.zone_id, count(*) AS n_lines, sum(length(l.text)) AS chars FROM cur z JOIN ln l ON z.doc_id = l.doc_id AND z.page = l.page AND (l.x0 + l.x1) / 2 BETWEEN z.x0 - 1 AND z.x1 + 1 AND (l.y0 + l.y1) / 2 BETWEEN z.y0 - 1 AND z.y1 + 1 GROUP BY z.zone_id"""


@operator
def boxes(d):
    """Area of each zone, and whether its parent contains it within two points."""
    return f"""WITH {CUR} SELECT c.zone_id, {AREA('c')} AS area, coalesce(p.x0 <= c.x0 + 2 AND p.y0 <= c.y0 + 2 AND p.x1 >= c.x1 - 2 AND p.y1 >= c.y1 - 2, false) AS contained FROM cur c LEFT JOIN cur p ON {KEY('p.zone_id')} = {KEY('c.parent_id')}"""
