"""Bibliographic references and names, as columns over whole tables.

A reference is taken apart in steps, each over what the step before left: its number,
its link, its people, its year, and then title, place and publisher by the sentences
that remain. What a step doesn't find is null; the raw text stays beside the fields.

Defined cases: null and empty texts give no fields; a text that no step fits has only ``rest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.functions.unicode import confusable
from quirelight.operators.hierarchy import current_zones

FIELDS = ("number", "people", "year", "title", "place", "publisher", "doi")


def parse_citation(zones: DataFrame) -> DataFrame:
    """(zone_id, number, people, year, title, place, publisher, doi, et_al, raw) of the current zones with tag ref."""
    x = current_zones(zones, "tag", "text").where("tag = 'ref' and text <> ''").select("zone_id", F.col("text").alias("raw"))
    some = lambda c: F.when(c != "", c)
    x = x.withColumn("number", some(F.regexp_extract("raw", r"^\s*\[?([0-9]+)[.)\]]", 1))).withColumn("_r", F.trim(F.regexp_replace("raw", r"^\s*\[?[0-9]+[.)\]]", "")))
    link = F.filter(F.split("_r", " "), lambda w: F.startswith(w, F.lit("10.")) | F.startswith(F.lower(w), F.lit("doi:10.")) | F.startswith(w, F.lit("https://doi.org/")))
    x = x.withColumn("doi", F.rtrim(F.get(link, F.lit(0))))
    at = F.instr("_r", F.lit(" ("))
    year = F.regexp_extract("_r", rf"\({T.YEAR}[a-z]?\)", 1)
    x = x.withColumn("year", some(year)).withColumn("people", F.when((at > 0) & (year != ""), some(F.trim(F.substring_index("_r", " (", 1)))))
    x = x.withColumn("_t", F.when(F.col("people").isNotNull(), F.trim(F.regexp_replace(F.expr("substring(_r, instr(_r, ')') + 1)"), r"^[.,:]\s*", ""))).otherwise(F.col("_r")))
    x = x.withColumn("_p", F.split("_t", r"\. "))
    last = F.when(F.size("_p") > 1, F.regexp_replace(F.element_at("_p", -1), r"\.\s*$", ""))
    x = x.withColumn("title", some(F.trim(F.regexp_replace(F.get("_p", F.lit(0)), r"\.\s*$", ""))))
    x = x.withColumn("place", F.when(F.contains(last, F.lit(": ")), F.substring_index(last, ": ", 1))).withColumn("publisher", F.when(F.contains(last, F.lit(": ")), F.trim(F.substring_index(last, ": ", -1))))
    return x.select("zone_id", *FIELDS, F.contains("raw", F.lit("et al")).alias("et_al"), "raw")


def citation_keeps_words(zones: DataFrame) -> DataFrame:
    """(zone_id, kept): whether every field of a parsed reference stands in its raw text word for word."""
    kept = F.forall(F.array(*FIELDS), lambda v: v.isNull() | F.contains("raw", v))
    return parse_citation(zones).select("zone_id", kept.alias("kept"))


def names(zones: DataFrame) -> DataFrame:
    """(zone_id, pos, surname, given): the people of each reference, in order; ``Surname, G.`` or ``G. Surname``."""
    x = parse_citation(zones).where("people is not null")
    people = F.split(F.regexp_replace("people", r"\s+(?:and|&)\s+|;\s*|(?<=\.),\s*", "|"), "[|]")
    x = x.select("zone_id", F.posexplode(F.filter(F.transform(people, lambda p: F.trim(p)), lambda p: p != "")).alias("pos", "p"))
    comma = F.contains("p", F.lit(","))
    surname = F.when(comma, F.trim(F.substring_index("p", ",", 1))).otherwise(F.substring_index("p", " ", -1))
    given = F.when(comma, F.trim(F.expr("substring(p, instr(p, ',') + 1)"))).otherwise(F.trim(F.expr("substring(p, 1, length(p) - length(substring_index(p, ' ', -1)))")))
    return x.select("zone_id", "pos", surname.alias("surname"), given.alias("given"))


def confusable_tokens(pdf_tokens: DataFrame, xhtml_tokens: DataFrame) -> DataFrame:
    """(token_id, places): aligned tokens of one length that differ in look-alike letters alone."""
    x = xhtml_tokens.where("pdf_token_id is not null and text is not null").select(F.col("pdf_token_id").alias("token_id"), F.col("text").alias("b"))
    p = pdf_tokens.where("text is not null").select("token_id", F.col("text").alias("a"))
    pair = p.join(x, "token_id").where("a <> b and length(a) = length(b)").distinct()
    both = F.arrays_zip(F.split("a", "").alias("p"), F.split("b", "").alias("q"))
    other = F.filter(both, lambda c: c.p != c.q)
    pair = pair.select("token_id", other.alias("other")).where(F.forall("other", lambda c: confusable(c.p, c.q)))
    return pair.groupBy("token_id").agg(F.max(F.size("other")).alias("places"))


#: Words of a language that tell it, the most frequent of its labelled documents.
STOP_WORDS = 20


def detect_language(zones: DataFrame, documents: DataFrame, codes: DataFrame, words: int = STOP_WORDS) -> DataFrame:
    """(zone_id, lang): the language of Latin texts by stop words, null without any.

    The stop words of a language are the ``words`` words that stand in most documents
    labelled with it (a tie takes the smaller word), counted here and not listed; a text's language has
    most hits, of several the first by code. ``codes`` as language_codes.
    """
    latin = codes.where("script = 'Latin'").groupBy("spelling").agg(F.min("lang_code").alias("lang"))
    cut = lambda c: F.expr(rf"regexp_extract_all(lower({c}), '\\p{{L}}+', 0)")
    own = documents.where("text is not null").select("doc_id", "text", F.col("lang").alias("spelling")).join(latin, "spelling")
    n = own.select("doc_id", "lang", F.explode(F.array_distinct(cut("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    stops = n.withColumn("_k", rank).where(F.col("_k") <= words).select("lang", "word")
    cur = current_zones(zones, "text")
    hits = cur.where("text <> ''").select("zone_id", F.explode(cut("text")).alias("word")).groupBy("zone_id", "word").agg(F.count("*").alias("k"))
    score = hits.join(stops, "word").groupBy("zone_id", "lang").agg(F.sum("k").alias("k"))
    best = score.groupBy("zone_id").agg(F.min_by("lang", F.struct(-F.col("k"), F.col("lang"))).alias("lang"))
    return cur.select("zone_id").join(best, "zone_id", "left")
