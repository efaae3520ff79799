"""Composite runs: comparing two sides of a document, and verifying zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.operators import align
from quirelight.operators.hierarchy import current_zones
from quirelight.runtime import staged

# Severity of a finding's type.
SEVERITY = {"MISSING_WORD": "HIGH", "ADDED_WORD": "HIGH", "CHANGED_WORD": "HIGH", "MERGED_WORD": "MEDIUM", "SPLIT_WORD": "MEDIUM", "MISSING_SYMBOL": "MEDIUM", "EXTRA_SYMBOL": "MEDIUM", "SYMBOL_MISMATCH": "LOW"}


def compare(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, scores) of two sides (doc_id, pos, text); the alignment is written once and read by both."""
    aligned = staged(align.align(left, right), "aligned")
    f = align.word_differences(aligned).select("doc_id", "type", "original", "converted", "confidence")
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("type")]
    findings = staged(f.withColumn("severity", severity), "findings")
    totals = aligned.groupBy("doc_id").agg(F.count("i").alias("n_left"), F.count("j").alias("n_right"), F.count(F.when(F.col("op") == "equal", 1)).alias("n_equal"))
    bad = findings.groupBy("doc_id").agg(F.count(F.when(F.col("confidence") >= 0.6, 1)).alias("confirmed"), F.count(F.when(F.col("confidence") < 0.6, 1)).alias("uncertain"), F.bool_or(F.col("severity") == "HIGH").alias("high"))
    x = totals.join(bad, "doc_id", "left").na.fill(0, ["confirmed", "uncertain"])
    most = F.greatest("n_left", "n_right")
    score = F.when(most > 0, 100 * F.greatest(F.lit(0), most - F.col("confirmed")) / most).otherwise(100.0)
    status = F.when(F.col("high"), "FAIL").when(F.col("confirmed") + F.col("uncertain") > 0, "PASS WITH WARNINGS").otherwise("PASS")
    return findings, x.select("doc_id", "n_left", "n_right", "n_equal", "confirmed", "uncertain", score.alias("fidelity"), status.alias("status"))


def verify_zones(zones: DataFrame) -> DataFrame:
    """(zone_id, issue, detail): every text check over the current zones, from one pass over their texts."""
    z = current_zones(zones, "tag", "text").where("text <> ''")
    e = lambda f, *a: T.column(f, "text", *a)
    checks = {
        "of_for_have": F.when(e(T.of_for_have) != "", e(T.of_for_have)),
        "subject_verb": F.when(e(T.subject_verb) != "", e(T.subject_verb)),
        "odd_quotes": F.when(e(T.odd_quotes), F.lit("")),
        "repeated_word": F.when(F.col("text").rlike(r"(?i)\b(\p{L}+)\s+\1\b"), F.regexp_extract("text", r"(?i)\b(\p{L}+)\s+\1\b", 1)),
        "missing_callout": F.when(F.size(e(T.missing_callouts)) > 0, F.array_join(e(T.missing_callouts), ",")),
        "ligature": F.when(e(T.contains_ligature), F.lit("")),
    }
    found = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("issue"), v.alias("detail"))) for k, v in checks.items()])
    return z.select("zone_id", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("f")).select("zone_id", "f.issue", "f.detail")
