"""Registered queries of operators that need Arrow-batched Python; no SQL for the alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.functions import markup, unicode
from quirelight.functions import text as T
from quirelight.operators import align, layout
from quirelight.runtime import table


def _sides(s, d):
    return align.tokens(table(s, d, "pdf_tokens"), "token_id"), align.tokens(table(s, d, "xhtml_tokens"), "token_id")


def _signs(s, d, name):
    """Tokens cut into words and signs."""
    t = align.tokens(table(s, d, name), "token_id").select("doc_id", "pos", F.posexplode(T.column(T.tokenize_exact)).alias("k", "text"))
    return t.select("doc_id", (F.col("pos") * 1000 + F.col("k")).alias("pos"), "text")


def _paragraphs(s, d):
    """Paragraphs of both sides as texts in order."""
    out = []
    for name in ("pdf_tokens", "xhtml_tokens"):
        t = table(s, d, name).where("text is not null").select("doc_id", "paragraph", "token_id", "text").distinct()
        g = t.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("token_id", "text"))).alias("t"))
        out.append(g.select("doc_id", F.col("paragraph").cast("bigint").alias("pos"), F.array_join(F.transform("t", lambda x: x.text), " ").alias("text")))
    return out


def _lines(s, d):
    return table(s, d, "line_features").select("doc_id", "page", "line_id", "x0", "y0", "y1", "text").distinct()


def _blocks(s, d, *cols):
    return table(s, d, "layout_blocks").select("doc_id", "page", "block_no", *cols).distinct()


def _words(s, d):
    return table(s, d, "pdf_tokens").select("doc_id", "page", F.col("token_id").alias("word_no"), "x0", "y0", "x1", "y1").distinct()


def _tagged(s, d):
    """Token texts marked by their style map."""
    t = table(s, d, "pdf_tokens").where("text is not null").select("token_id", "text", F.coalesce(F.col("style")["italic"], F.lit(False)).alias("i"), F.coalesce(F.col("style")["bold"], F.lit(False)).alias("b")).distinct()
    x = F.when(F.col("i"), F.concat(F.lit("<i>"), "text", F.lit("</i>"))).otherwise(F.col("text"))
    return t.select("token_id", F.when(F.col("b"), F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x).alias("tagged"))


def _changed(s, d):
    p = table(s, d, "pdf_tokens").where("text is not null").select("token_id", "text").distinct()
    x = table(s, d, "xhtml_tokens").where("pdf_token_id is not null and text is not null").select(F.col("pdf_token_id").alias("token_id"), F.col("text").alias("other")).distinct()
    return p.join(x, "token_id").where("text <> other")


QUERIES = {
    "index_hierarchy": lambda s, d: layout.index_hierarchy(table(s, d, "zones")),
    "align_tokens": lambda s, d: align.align(*_sides(s, d)),
    "word_differences": lambda s, d: align.word_differences(align.align(*_sides(s, d))),
    "gap_symbols": lambda s, d: align.gap_symbols(_signs(s, d, "pdf_tokens"), _signs(s, d, "xhtml_tokens")).groupBy("doc_id", "type").agg(F.count("*").alias("n")),
    "paragraph_merge_split": lambda s, d: align.paragraph_changes(*_paragraphs(s, d)),
    "align_by_key": lambda s, d: align.align(*_paragraphs(s, d)).groupBy("doc_id", "op").agg(F.count("*").alias("n")),
    "similarity": lambda s, d: _changed(s, d).select("token_id", align.similarity("text", "other").alias("ratio")),
    "char_diff": lambda s, d: _changed(s, d).select("token_id", "text", "other", align.classified("text", "other").alias("kind")),
    "style_ranges": lambda s, d: align.style_ranges(table(s, d, "pdf_tokens"), table(s, d, "xhtml_tokens")),
    "physical_lines": lambda s, d: layout.physical_lines(_words(s, d)),
    "list_runs": lambda s, d: layout.list_runs(_lines(s, d)),
    "pdf_columns": lambda s, d: layout.pdf_columns(_blocks(s, d, "x0", "x1")),
    "index_entries": lambda s, d: layout.index_entries(_lines(s, d)),
    "decide_tags": lambda s, d: layout.decide_tags(_blocks(s, d, "kind", "n_lines").groupBy("doc_id", "page", "block_no").agg(F.min("kind").alias("kind"), F.max("n_lines").alias("n_lines"))),
    "parse_ranges": lambda s, d: _tagged(s, d).select("token_id", markup.parse_ranges("tagged").alias("r")).select("token_id", "r.plain", F.size("r.ranges").alias("n_ranges"), F.size("r.issues").alias("n_issues")),
    "build_markup": lambda s, d: _tagged(s, d).select("token_id", markup.rebuilt("tagged").alias("tagged")),
    "text_normalize": lambda s, d: table(s, d, "zones").select("zone_id", unicode.text_normalize("text").alias("form")),
    "text_semantic": lambda s, d: table(s, d, "pdf_tokens").select("token_id", unicode.text_semantic("text").alias("form")),
    "normalize_strict": lambda s, d: table(s, d, "pdf_tokens").select("token_id", unicode.text_normalize("text").alias("form")),
    "presentation_forms": lambda s, d: table(s, d, "zones").select("zone_id", unicode.presentation_forms("text").alias("form")),
    "unicode_string": lambda s, d: table(s, d, "pdf_tokens").select("token_id", unicode.unicode_string("text").alias("points")),
    "script_of_name": lambda s, d: table(s, d, "pdf_tokens").select("token_id", unicode.first_script("text").alias("script")),
}

_SPACES = "[  -   　\\s\x1c-\x1f\x85   ]+"
_FORM = f"trim(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '{_SPACES}', ' ', 'g'))"
SQL = {
    "text_normalize": f"SELECT zone_id, {_FORM} AS form FROM zones",
    "normalize_strict": f"SELECT token_id, {_FORM} AS form FROM pdf_tokens",
    "unicode_string": "SELECT token_id, array_to_string(list_transform(string_split(text, ''), lambda c: 'U+' || CASE WHEN ord(c) > 65535 THEN printf('%X', ord(c)) ELSE printf('%04X', ord(c)) END), ' ') AS points FROM pdf_tokens",
}
