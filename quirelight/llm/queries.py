"""Registered queries of the subpackage: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from quirelight.llm import charforms, encode, langid, mixing, mojibake, reading, scanfix, sentences, sitelines
from quirelight.runtime import table


def queries() -> dict:
    return {
        "p1_found": lambda s, d: charforms.found(table(s, d, "pdf_tokens"), table(s, d, "xhtml_tokens"), table(s, d, "differences")),
        "p1_pdf_forms": lambda s, d: charforms.consistent(table(s, d, "pdf_tokens"), "token_id"),
        "p1_xhtml_forms": lambda s, d: charforms.consistent(table(s, d, "xhtml_tokens"), "token_id"),
        "p2_found": lambda s, d: langid.found(table(s, d, "documents"), table(s, d, "zones"), table(s, d, "language_codes")),
        "p2_languages": lambda s, d: langid.languages(table(s, d, "documents"), table(s, d, "zones"), table(s, d, "language_codes")).select("rec_kind", "rec_id", "lang", "letters", "confidence"),
        "p2_segments": lambda s, d: langid.segments(langid.records(table(s, d, "documents"), table(s, d, "zones"), table(s, d, "language_codes")), langid.fit(table(s, d, "documents"), table(s, d, "language_codes"))),
        "p3_found": lambda s, d: scanfix.defects(table(s, d, "line_features"), table(s, d, "zones")),
        "p3_paragraphs": lambda s, d: scanfix.repaired_lines(table(s, d, "line_features"), table(s, d, "zones")),
        "p5_found": lambda s, d: mojibake.found(table(s, d, "pdf_tokens"), table(s, d, "zones")),
        "p5_repaired": lambda s, d: mojibake.repaired(table(s, d, "pdf_tokens"), table(s, d, "zones")),
        "p6_found": lambda s, d: sentences.sentence_ends(table(s, d, "zones"), table(s, d, "line_features"), table(s, d, "pdf_tokens")),
        "p7_found": lambda s, d: sitelines.repeated_lines(table(s, d, "line_features"), table(s, d, "documents")),
        "p7_cleaned": lambda s, d: sitelines.cleaned_documents(table(s, d, "documents"), table(s, d, "line_features")),
        "p8_ids": lambda s, d: encode.encode(table(s, d, "documents")),
        "p8_token_counts": lambda s, d: encode.token_counts(table(s, d, "documents")),
        "p9_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"), table(s, d, "language_codes")),
        "p9_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets"), table(s, d, "language_codes")),
        "p10_found": lambda s, d: reading.found(table(s, d, "documents"), table(s, d, "reading_labels"), table(s, d, "language_codes")),
        "p10_levels": lambda s, d: reading.levels(table(s, d, "documents"), table(s, d, "reading_labels"), table(s, d, "language_codes")),
    }


_P7 = r"""
WITH d AS (SELECT DISTINCT doc_id, source FROM documents WHERE source IS NOT NULL),
l AS (SELECT line_id, doc_id, d.source, lower(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS k FROM line_features JOIN d USING (doc_id)),
n AS (SELECT source, count(DISTINCT doc_id) AS n_source FROM l GROUP BY source),
c AS (SELECT source, k, count(DISTINCT doc_id) AS n_docs FROM l WHERE length(k) >= 15 GROUP BY source, k),
x AS (SELECT source, k FROM c JOIN n USING (source) WHERE n_docs >= 3 AND n_docs >= n_source * CAST(0.1 AS DOUBLE))
"""

SQL = {
    "p7_found": _P7 + "SELECT DISTINCT line_id FROM l JOIN x USING (source, k)",
    "p7_cleaned": _P7
    + r"""
, t AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT t.doc_id, t.i, t.line, x.k IS NOT NULL AS gone FROM t LEFT JOIN x ON t.source = x.source AND x.k = lower(regexp_replace(t.line, '[^\p{L}]+', '', 'g')))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(h.line, chr(10) ORDER BY h.i) FILTER (NOT gone), '') END AS text,
  CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id, d.text
""",
}


def oracle_sql() -> dict:
    return SQL
