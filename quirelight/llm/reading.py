"""Problem 10: the reading level of English documents.

*Vocabulary*: words of the corpus by their frequency in documents labelled
English, of those a word belongs to English if it is at home there (its share of
English tokens is above its share of the others). The first ``VOCABULARY`` ranks
are kept, a fixed bound; a word beyond has that rank.

*Coverage*: the smallest frequency-ranked vocabulary that covers a fixed share of
a document's tokens is the quantile of the tokens' ranks at that share. Function
words cover half of any text, so three shares are taken (``SHARES``).

*Complexity*: words in a sentence, letters in a word.

*Calibration*, in SQL: the grades of ``reading_labels`` (mean of a document's raters)
are regressed on the features by the normal equations, whose sums are one
aggregate; a second round leaves out residuals above ``OUTLIER`` grades (raters
err). The level is the nearest grade, 1 to 5.

A document is wholly English if no sentence of it is foreign: one with
``MIN_FOREIGN`` letters and ``MIN_WORDS`` words of which less than ``ENGLISH`` of the
letters are in English words, or with ``MIN_FOREIGN_OTHER`` letters of another script.

Defined cases: null, empty and non-English texts have a null level; a document
without a full sentence is read as one; without labels every level is null; repeated
labels count once; lines without an end mark (titles, site lines) don't count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.langid import labels
from quirelight.runtime import staged

VOCABULARY = 1 << 16
SHARES = (0.5, 0.65, 0.8)
OUTLIER, ENGLISH, MIN_FOREIGN, MIN_WORDS, MIN_FOREIGN_OTHER = 1.0, 0.4, 16, 5, 8
FEATURES = ("cover_50", "cover_65", "cover_80", "sentence", "letters")
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_STOP = re.compile(r"[.!?…。！？।][\"”’»“)]*(?=\s|$|[^\s\w.,;:)])|[。！？।]|\n")
_ENDED = re.compile(r"[.!?…][\"”’»“)]*\s*$")


def word_counts(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """(word, english, other): tokens in documents labelled English and in the rest."""
    known = labels(documents.where("text <> ''").select("text", "lang"), codes, "lang")
    rows = known.select(F.coalesce(F.col("labelled") == "en", F.lit(False)).alias("en"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def out(which: int) -> pa.RecordBatch:
            own, zero = list(n[which].values()), [0] * len(n[which])
            cols = (zero, own) if which == 0 else (own, zero)
            batch = pa.RecordBatch.from_arrays([pa.array(list(n[which]), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["word", "english", "other"])
            n[which].clear()
            return batch

        for b in batches:
            texts: tuple[list, list] = ([], [])
            for en, t in zip(*(c.to_pylist() for c in b.columns)):
                texts[en].append(t)
            for k in (0, 1):
                n[k].update(w for w in _WORD.findall("\n".join(texts[k]).lower()) if w[0] < "ɐ")
                if len(n[k]) > 200_000:
                    yield out(k)
        yield out(0)
        yield out(1)

    return rows.mapInArrow(run, "word string, english bigint, other bigint").groupBy("word").agg(F.sum("english").alias("english"), F.sum("other").alias("other"))


def ranked_vocabulary(counts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """English words by frequency, ties by the word; at most ``size``."""
    e, o = counts.agg(F.sum("english"), F.sum("other")).first()
    own = counts.where(F.col("english") * float(o or 0) > F.col("other") * float(e or 0)) if o else counts.where("english > 0")
    return [r.word for r in own.orderBy(F.desc("english"), "word").limit(size).select("word").collect()]


def measures(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, foreign, FEATURES) of each document with text."""
    shared = documents.sparkSession.sparkContext.broadcast({w: k + 1 for k, w in enumerate(vocabulary)})
    last = len(vocabulary) + 1
    schema = "doc_id bigint, foreign boolean, " + ", ".join(f"{f} double" for f in FEATURES)

    def one(text: str, rank: dict[str, int]) -> tuple | None:
        ranks: list[int] = []
        sentences = size = 0
        a = 0
        for m in [*_STOP.finditer(text), None]:
            b = m.end() if m else len(text)
            part, a = text[a:b], b
            words = _WORD.findall(part)
            if not words:
                continue
            own = [rank.get(w.lower(), last) for w in words]
            letters = sum(map(len, words))
            english = sum(len(w) for w, r in zip(words, own) if r < last)
            if sum(len(w) for w in words if "Ͱ" <= min(w) and max(w) < "＀") >= MIN_FOREIGN_OTHER:
                return None
            if english < ENGLISH * letters and letters >= MIN_FOREIGN and len(words) >= MIN_WORDS:
                return None
            if len(words) >= 3 and _ENDED.search(part):
                ranks += own
                size += letters
                sentences += 1
        if not ranks:
            own = _WORD.findall(text)
            if not own:
                return None
            ranks, sentences, size = [rank.get(w.lower(), last) for w in own], 1, sum(map(len, own))
        cover = np.log(np.quantile(ranks, SHARES, method="inverted_cdf"))
        return (*map(float, cover), float(np.log(len(ranks) / sentences)), size / len(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            rows = [one(t, rank) for t in batch.column(1).to_pylist()]
            cols = [pa.array([None if r is None else r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r is None for r in rows]), *cols], names=["doc_id", "foreign", *FEATURES])

    return documents.where("text <> ''").select("doc_id", "text").mapInArrow(run, schema)


def _terms() -> list[F.Column]:
    """1, the features, and squares and product of the two measures of complexity."""
    s, n = F.col("sentence"), F.col("letters")
    return [F.lit(1.0), *(F.col(f) for f in FEATURES), s * s, n * n, s * n]


def _regress(rows: DataFrame) -> np.ndarray | None:
    """Weights of the terms for ``grade`` from one aggregate of sums; None without enough rows."""
    x = _terms()
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(a * F.col("grade")).alias(f"g{i}") for i, a in enumerate(x)]
    r = rows.agg(F.count("*").alias("n"), *sums).first()
    if not r or r["n"] <= k:
        return None
    xx = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(xx + 1e-6 * np.eye(k) * r["n"], np.array([r[f"g{i}"] for i in range(k)]))


def _score(w: np.ndarray) -> F.Column:
    out = F.lit(0.0)
    for x, k in zip(_terms(), w):
        out = out + F.lit(float(k)) * x
    return out


def levels(documents: DataFrame, reading_labels: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, score, level) of every document; null where it isn't wholly English."""
    vocabulary = ranked_vocabulary(staged(word_counts(documents, codes), "english-words"))
    m = staged(measures(documents, vocabulary).where("not foreign").drop("foreign"), "measures")
    grades = reading_labels.where("grade is not null").dropDuplicates(["doc_id", "rater", "labelled_at"]).groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    known = m.join(grades, "doc_id")
    w = _regress(known)
    if w is not None:
        again = _regress(known.where(F.abs(_score(w) - F.col("grade")) <= OUTLIER))
        w = again if again is not None else w
        scored = m.select("doc_id", _score(w).alias("score"))
    else:
        scored = m.select("doc_id", F.lit(None).cast("double").alias("score"))
    level = F.when(F.col("score").isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), F.round("score").cast("int"))))
    return documents.select("doc_id").join(scored, "doc_id", "left").select("doc_id", "score", level.alias("level"))


def found(documents: DataFrame, reading_labels: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id): documents wholly in English, of 400 characters or more, of level 4 or 5."""
    long = documents.where("n_chars >= 400").select("doc_id")
    return levels(documents, reading_labels, codes).where("level >= 4").join(long, "doc_id", "left_semi").select("doc_id").distinct()
