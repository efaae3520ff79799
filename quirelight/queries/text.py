"""Registered queries of ``functions.text``: each function over the texts of a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.functions.dialect import DUCK, SPARK
from quirelight.runtime import table

#: name: (table, key, outputs). An output is a function of (column, dialect).
ONE = {
    "expand_ligatures": ("pdf_tokens", "token_id", {"expanded": T.expand_ligatures, "has": T.contains_ligature}),
    "collapse_spaces": ("zones", "zone_id", {"plain": T.collapse}),
    "sanitize_xml": ("documents", "doc_id", {"clean": T.sanitize_xml}),
    "strip_tags": ("documents", "doc_id", {"plain": T.strip_tags}),
    "title_normalize": ("zones", "zone_id", {"title": T.title_normalize}),
    "strip_list_marker": ("zones", "zone_id", {"item": T.strip_list_marker}),
    "ocr_text_repair": ("line_features", "line_id", {"repaired": T.ocr_text_repair}),
    "final_text_normalize": ("line_features", "line_id", {"final": T.final_quotes}),
    "running_signature": ("line_features", "line_id", {"signature": T.running_signature}),
    "confusion_map": ("line_features", "line_id", {"digits": T.confusion_map}),
    "id_prefix": ("pdf_tokens", "token_id", {"id_prefix": T.id_prefix, "image_prefix": T.image_prefix}),
    "tokenize_exact": ("pdf_tokens", "token_id", {"tokens": T.tokenize_exact}),
    "token_kind": ("pdf_tokens", "token_id", {"kind": T.token_kind}),
    "words_multilingual": ("pdf_tokens", "token_id", {"words": T.words_multilingual}),
    "is_semantic_word": ("pdf_tokens", "token_id", {"semantic": T.is_semantic_word}),
    "is_symbol_or_punct": ("pdf_tokens", "token_id", {"symbol": T.is_symbol_or_punct}),
    "dominant_script": ("zones", "zone_id", {"script": T.dominant_script}),
    "is_rtl": ("zones", "zone_id", {"rtl": T.is_rtl}),
    "mixed_script_words": ("pdf_tokens", "token_id", {"mixed": T.mixed_script_word}),
    "uppercase_ratio": ("line_features", "line_id", {"ratio": T.uppercase_ratio}),
    "ends_sentence": ("line_features", "line_id", {"ends": T.ends_sentence}),
    "starts_lowercase": ("line_features", "line_id", {"lower_start": T.starts_lowercase, "caseless_start": T.starts_caseless}),
    "page_number_like": ("line_features", "line_id", {"number": T.page_number_like}),
    "roman_valid": ("line_features", "line_id", {"roman": T.roman_valid}),
    "biblio_predicates": (
        "zones",
        "zone_id",
        {"author": T.author_start, "organization": T.organization_start, "year_only": T.year_start, "year_near": T.year_near_start, "pages": T.page_range, "link": T.url_or_doi, "heading": T.bibliography_heading},
    ),
    "index_predicates": ("line_features", "line_id", {"letter": T.index_alpha_heading, "page_ref": T.index_page_reference, "page_only": T.index_page_only, "see": T.index_cross_reference, "complete": T.index_complete}),
    "blank_page_notice": ("line_features", "line_id", {"notice": T.blank_page_notice}),
    "extract_author": ("zones", "zone_id", {"author": T.extract_author, "year": T.extract_year}),
    "heading_kind": ("zones", "zone_id", {"kind": T.heading_kind}),
    "match_label": ("line_features", "line_id", {"chapter": lambda c, d: T.match_label(c, d, "chapter"), "rest": lambda c, d: T.match_label(c, d, "chapter", 2)}),
    "figure_label_caption": ("zones", "zone_id", {"label": lambda c, d: T.match_label(c, d, "figure"), "caption": lambda c, d: T.match_label(c, d, "figure", 2)}),
    "table_label_caption": ("zones", "zone_id", {"label": lambda c, d: T.match_label(c, d, "table"), "caption": lambda c, d: T.match_label(c, d, "table", 2)}),
    "reference_number": ("zones", "zone_id", {"label": T.reference_number, "rest": lambda c, d: T.reference_number(c, d, 2), "number": T.reference_label}),
    "isbn": ("documents", "doc_id", {"isbn": T.isbn_value, "format": T.isbn_format}),
    "copyright_parts": ("line_features", "line_id", {"year": T.copyright_year, "holder": T.copyright_holder}),
    "keywords": ("line_features", "line_id", {"keywords": T.keywords}),
    "of_for_have": ("zones", "zone_id", {"found": T.of_for_have}),
    "subject_verb": ("zones", "zone_id", {"found": T.subject_verb}),
    "odd_quotes": ("zones", "zone_id", {"odd": T.odd_quotes}),
    "page_number_merge": ("line_features", "line_id", {"position": T.page_number_merge}),
    "missing_callouts": ("zones", "zone_id", {"numbers": T.missing_callouts}),
    "contains_ligature": ("zones", "zone_id", {"has": T.contains_ligature}),
    "starts_caseless": ("line_features", "line_id", {"caseless": T.starts_caseless}),
    "extract_year": ("zones", "zone_id", {"year": T.extract_year}),
    "reference_labels": ("zones", "zone_id", {"label": T.reference_label}),
    "image_prefix": ("pdf_tokens", "token_id", {"prefix": T.image_prefix}),
    "skippable_word": ("pdf_tokens", "token_id", {"skip": T.skippable_word}),
}

#: Functions of a text and the one after it in its document's page.
TWO = {
    "continues": T.continues,
    "joiner": T.joiner,
    "continuation_confidence": T.continuation_confidence,
    "is_line_break_hyphen": T.line_break_hyphen,
}


def _one(name):
    source, key, outs = ONE[name]
    query = lambda s, d: table(s, d, source).select(key, *[F.expr(f("text", SPARK)).alias(c) for c, f in outs.items()])
    return query, f"SELECT {key}, {', '.join(f'{f("text", DUCK)} AS {c}' for c, f in outs.items())} FROM {source}"


def _two_sql(f, d, source):
    return f"SELECT line_id, {f('text', 'nxt', d)} AS value FROM (SELECT line_id, text, lead(text) OVER (PARTITION BY doc_id, page ORDER BY block_no, line_no, line_id) AS nxt FROM (SELECT DISTINCT line_id, doc_id, page, block_no, line_no, text FROM {source}) AS l) AS o"


def _two(name):
    f = TWO[name]
    sql = _two_sql(f, SPARK, "@lines@").replace("{", "{{").replace("}", "}}").replace("@lines@", "{lines}")
    return (lambda s, d: s.sql(sql, lines=table(s, d, "line_features"))), _two_sql(f, DUCK, "line_features")


#: Hyphens at a line break: first part, second part, what came out, whether a line broke.
HYPHENS = "(VALUES ('govern-', 'ment', 'government', true), ('govern-', 'ment', 'govern- ment', true), ('well-', 'known', 'wellknown', false), ('well-', 'known', 'well-known', false), ('co', 'operate', 'co-operate', false), ('plain', 'word', 'plainword', false)) AS t(a, b, c, e)"


def _hyphens(d):
    return f"SELECT a, b, c, {T.hyphenation_class('a', 'b', 'c', 'e', d)} AS verdict FROM {HYPHENS}"


_ALL = {n: _one(n) for n in ONE} | {n: _two(n) for n in TWO} | {"hyphenation_class": ((lambda s, d: s.sql(_hyphens(SPARK))), _hyphens(DUCK))}
QUERIES = {n: q for n, (q, _) in _ALL.items()}
SQL = {n: sql for n, (_, sql) in _ALL.items()}
