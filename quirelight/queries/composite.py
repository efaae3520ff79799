"""Registered queries of sources, sinks, zone edits, streams and composite runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.operators import align, layout, zones
from quirelight.operators.hierarchy import current_zones
from quirelight.plans import compare
from quirelight.runtime import table
from quirelight.sources import dtd, projects, sinks, xhtml
from quirelight.streaming import incremental

#: A small content model in the manner of article markup.
DTD = """<!ENTITY % inline "#PCDATA | em">
<!ELEMENT book-part (title?, (sec | article | p)*)><!ELEMENT sec (title, (p | list | disp-quote | fn | sec | ref-list)*)><!ELEMENT article (title, sec+)>
<!ELEMENT list (list-item+)><!ELEMENT ref-list (title?, ref*)><!ELEMENT title (%inline;)*><!ELEMENT p (%inline;)*><!ATTLIST sec id ID #REQUIRED>"""


def _sides(s, d):
    return align.tokens(table(s, d, "pdf_tokens"), "token_id"), align.tokens(table(s, d, "xhtml_tokens"), "token_id")


def _exact(s, d, name):
    """Tokens cut into words and signs."""
    t = align.tokens(table(s, d, name), "token_id")
    return t.select("doc_id", "pos", F.posexplode(T.column(T.tokenize_exact)).alias("k", "text")).select("doc_id", (F.col("pos") * 1000 + F.col("k")).alias("pos"), "text")


def _current(s, d):
    return current_zones(table(s, d, "zones"), "doc_id", "page", "tag", "x0", "y0", "x1", "y1", "text", "parent_id", "level", "serial", "attributes", "created_order")


def _pages(s, d):
    """Each document's titles and paragraphs as one XHTML page."""
    z = _current(s, d).where("tag in ('title', 'p') and text <> ''")
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    el = F.when(F.col("tag") == "title", F.concat(F.lit("<h1>"), safe, F.lit("</h1>"))).otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>")))
    g = z.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "created_order", "zone_id", el.alias("e")))).alias("z"))
    return g.select("doc_id", F.lit(1).alias("page_no"), F.concat(F.lit("<html><head><title>x</title></head><body>"), F.array_join(F.transform("z", lambda x: x.e), ""), F.lit("</body></html>")).alias("html"))


def _tag_pairs(s, d):
    z = _current(s, d).select(F.lower(F.trim("zone_id")).alias("id"), F.lower(F.trim("parent_id")).alias("up"), "tag")
    return z.join(z.select(F.col("id").alias("up"), F.col("tag").alias("parent")), "up").groupBy("parent", F.col("tag").alias("child")).agg(F.count("*").alias("n"))


def _links(s, d):
    """Zones that go on with the zone before them: links of one text each."""
    from quirelight.operators import relational

    m = relational.run(s, "merge_candidates", lambda t: table(s, d, t))
    z = _current(s, d).select("zone_id")
    return z.join(m.select("zone_id", F.col("previous_id").alias("merge_target")), "zone_id", "left")


def _moves(s, d):
    """Each zone moved under the first zone of its document."""
    z = _current(s, d)
    first = z.groupBy("doc_id").agg(F.min("zone_id").alias("new_parent"))
    return z.join(first, "doc_id").where("zone_id <> new_parent").select("zone_id", "new_parent")


def _figures(s, d, change):
    """Blocks of many lines as figures: hash of the place, caption of the kind."""
    b = table(s, d, "layout_blocks").where("n_lines >= 8").select("doc_id", "block_no", "page", "kind", "x0", "y0", "x1", "y1").distinct()
    n = (F.col("page") * 100 + F.col("block_no")).cast("int")
    return b.select("doc_id", n.alias("fig_no"), F.xxhash64("page", "block_no").alias("hash"), F.concat("kind", F.lit(change)).alias("caption"), (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height")).dropDuplicates(["doc_id", "fig_no"])


def _words(s, d):
    return align.word_differences(align.align(*_sides(s, d)))


QUERIES = {
    "merge_chains": lambda s, d: zones.merge_chains(_links(s, d)),
    "set_parent": lambda s, d: zones.set_parent(table(s, d, "zones"), _moves(s, d)),
    "greedy_figure_match": lambda s, d: layout.figure_match(_figures(s, d, ""), _figures(s, d, " x")),
    "merged_word": lambda s, d: _words(s, d).groupBy("doc_id").agg(F.count_if(F.col("type") == "MERGED_WORD").alias("n"), F.count("*").alias("n_all")),
    "split_word": lambda s, d: _words(s, d).groupBy("doc_id").agg(F.count_if(F.col("type") == "SPLIT_WORD").alias("n"), F.count("*").alias("n_all")),
    "content_diff": lambda s, d: _words(s, d).groupBy("doc_id", "type", "detail").agg(F.count("*").alias("n")),
    "ocr_unicode_issues": lambda s, d: _words(s, d).where("detail in ('HOMOGLYPH_SUBSTITUTION', 'UNICODE_CODEPOINT_CHANGED', 'SPECIAL_CHARACTER_CHANGED')"),
    "repeated_word": lambda s, d: compare.verify_zones(table(s, d, "zones")).where("issue = 'repeated_word'"),
    "load_dtd": lambda s, d: dtd.rule_tables(s, DTD)["allowed_child"],
    "dtd_queries": lambda s, d: dtd.rule_tables(s, DTD)["required_attr"],
    "direct_compare": lambda s, d: align.gap_symbols(_exact(s, d, "pdf_tokens"), _exact(s, d, "xhtml_tokens")),
    "compare_findings": lambda s, d: compare.compare(*_sides(s, d))[0],
    "compare_scores": lambda s, d: compare.compare(*_sides(s, d))[1],
    "verify_document": lambda s, d: compare.verify_zones(table(s, d, "zones")),
    "parse_xhtml_blocks": lambda s, d: xhtml.parse_xhtml_blocks(_pages(s, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
    "save_project": lambda s, d: projects.project_documents(_current(s, d)).select("doc_id", "schema_version", "page_count", F.size("zones").alias("n_zones")),
    "write_xml": lambda s, d: sinks.xml_documents(_current(s, d)).select("doc_id", F.length("xml").alias("n")),
    "write_findings_csv": lambda s, d: sinks.findings_rows(table(s, d, "differences").distinct()),
    "dtd_violations": lambda s, d: dtd.violations(_tag_pairs(s, d), dtd.rule_tables(s, DTD)["allowed_child"]),
    "first_follow_sets": lambda s, d: dtd.rule_tables(s, DTD)["allowed_next"],
    "zone_levels": lambda s, d: zones.levels(table(s, d, "zones")),
    "delete_cascade": lambda s, d: zones.delete_cascade(_current(s, d).drop("attributes").withColumn("saved_at", F.lit(0).cast("timestamp")), _current(s, d).where("tag = 'list'").select("zone_id")).select("zone_id"),
    "pending_pages": lambda s, d: incremental.pending_pages(table(s, d, "line_features"), table(s, d, "zones").select("doc_id", "page").distinct()),
    "windowed_counts": lambda s, d: incremental.windowed_counts(table(s, d, "events")),
}

_CUR = "WITH cur AS (SELECT * FROM zones QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY saved_at DESC) = 1) "
SQL = {
    "parse_xhtml_blocks": _CUR + "SELECT doc_id, CASE tag WHEN 'title' THEN 'heading' ELSE 'paragraph' END AS kind, count(*) AS n FROM cur WHERE tag IN ('title', 'p') AND trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x85\\pZ]+', ' ', 'g')) <> '' GROUP BY ALL",
    "save_project": _CUR + "SELECT doc_id, 1 AS schema_version, max(page) AS page_count, CAST(count(*) AS INTEGER) AS n_zones FROM cur GROUP BY doc_id",
    "write_findings_csv": "SELECT DISTINCT " + ", ".join(sinks.COLUMNS) + " FROM (SELECT DISTINCT * FROM differences)",
    "pending_pages": "SELECT DISTINCT doc_id, page FROM line_features l WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.doc_id = l.doc_id AND z.page = l.page)",
    "windowed_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
}
