"""Findings and documents written out: CSV of fixed columns, JSON, an HTML report, XML by document."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a findings file, in order; missing ones are written empty.
COLUMNS = ("diff_id", "doc_id", "kind", "severity", "pdf_text", "xhtml_text", "pdf_page", "xhtml_file", "pdf_token_index", "xhtml_token_index", "confidence", "message", "found_at")


def findings_rows(findings: DataFrame) -> DataFrame:
    have = set(findings.columns)
    return findings.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings_rows(findings).write.mode("overwrite").option("header", True).csv(path)


def write_findings_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def findings_html(findings: DataFrame, most: int = 1000) -> str:
    """A report of the first ``most`` findings by id: a top-k view, the files hold them all."""
    rows = findings_rows(findings).orderBy("diff_id").limit(most).collect()
    head = "".join(f"<th>{c}</th>" for c in COLUMNS)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><body><table><tr>{head}</tr>{body}</table></body></html>"


def xml_documents(zones: DataFrame) -> DataFrame:
    """Current zones (doc_id, zone_id, tag, text, page, serial) -> (doc_id, xml): elements in reading order, text escaped."""
    e = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    e = F.regexp_replace(e, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    el = F.concat(F.lit("<"), F.col("tag"), F.lit(' id="'), F.col("zone_id"), F.lit('">'), e, F.lit("</"), F.col("tag"), F.lit(">"))
    order = F.struct("page", F.coalesce("serial", F.lit(2147483647)).alias("s"), "zone_id", el.alias("el"))
    return zones.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("z")).select("doc_id", F.concat(F.lit("<document>"), F.array_join(F.transform("z", lambda z: z.el), ""), F.lit("</document>")).alias("xml"))
