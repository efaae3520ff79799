"""Problem 9: mixing sources to target shares of all tokens.

1. Tokens of each document by a public tokenizer (``encode.token_counts``), its main
   language by the profiles of problem 2, and its topic: ``doc_kind``, hashed into
   ``TOPICS`` groups, so that free text can't make the next table large.
2. *Cells*: tokens by source, language and topic, one aggregate of at most (listed
   sources x listed languages x TOPICS) rows on the driver.
3. *Raking* (iterative proportional fitting) of one weight for each cell: in turn to
   the languages' and the topics' shares in the listed sources and to the source
   targets. A weight is the expected number of times a document is used and never above the
   source's ``max_repeats``; what a full cell can't take, the source's other cells
   take. Sources come last in a round, so their shares are the ones that hold; a
   target beyond tokens x max_repeats can't be reached and is reported so.
4. *Sampling*: a document is used as often as the whole part of its weight says, and
   once more by order sampling with the rest as its probability: documents stand in the order of
   a random number by their probability, and those that the source's missing tokens
   reach are taken. So each use count is the weight rounded up or down, and the
   tokens of a source are those wanted but for less than one document. The order is
   cut in ``SLICES``; one aggregate finds the slice where the tokens run out,
   and only that slice is ranked, so no task sees a whole source.

Defined cases: documents of sources without a target, or with null source, aren't
used; empty and null texts have 0 tokens and count as documents; repeated rows of
mix_targets count once; a listed source without documents reaches 0; documents without
a language of their own (short texts) make up the language ``und``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.llm import langid
from quirelight.llm.encode import token_counts
from quirelight.runtime import staged

ROUNDS, TOLERANCE, TOPICS, SLICES = 200, 1e-7, 256, 4096


def sized(documents: DataFrame, targets: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, source, lang, kind, n_tokens) of the documents of listed sources; kind is the topic's group."""
    listed = targets.where("source is not null").select("source").distinct()
    own = documents.join(listed, "source", "left_semi").select("doc_id", "source", "doc_kind", "text")
    n = token_counts(own)
    profiles = langid.fit(documents, codes)
    records = own.where("text <> ''").select(F.lit("document").alias("rec_kind"), F.col("doc_id").cast("string").alias("rec_id"), F.lit(None).cast("string").alias("labelled"), F.lit(None).cast("string").alias("source"), "text")
    main = langid.identified(records, profiles).where(F.col("letters") >= langid.MIN_LETTERS).select(F.col("rec_id").cast("bigint").alias("doc_id"), F.get("langs", F.lit(0))["lang"].alias("lang"))
    about = own.select("doc_id", "source", F.pmod(F.xxhash64("doc_kind"), F.lit(TOPICS)).cast("string").alias("kind")).join(n, "doc_id")
    return about.join(main, "doc_id", "left").select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), "kind", "n_tokens")


def rake(cells: list[tuple[str, str, str, float]], shares: dict[str, float], most: dict[str, float], total: float) -> np.ndarray:
    """Weights of cells (source, lang, kind, tokens): expected uses of a document."""
    tokens = np.array([c[3] for c in cells], float)
    caps = np.array([most[c[0]] for c in cells], float)
    w = np.minimum(1.0, caps)
    groups = []
    for k in (1, 2, 0):
        names = sorted({c[k] for c in cells})
        at = np.array([names.index(c[k]) for c in cells], int)
        own = np.bincount(at, tokens, len(names))
        goal = np.array([shares.get(n, 0.0) * total for n in names]) if k == 0 else own / max(own.sum(), 1) * total
        groups.append((at, goal, k == 0))
    for _ in range(ROUNDS):
        before = w.copy()
        for at, goal, hard in groups:
            for _ in range(20 if hard else 1):  # what full cells can't take goes to the others
                now = np.bincount(at, tokens * w, len(goal))
                full = np.bincount(at, tokens * w * (w >= caps - 1e-12), len(goal)) if hard else 0
                room = np.maximum(now - full, 0)
                need = np.maximum(goal - full, 0)
                f = np.divide(need, room, out=np.ones_like(need), where=room > 0)[at]
                free = w < caps - 1e-12 if hard else np.ones(len(w), bool)
                w = np.where(free, np.minimum(w * f, caps), w)
                if hard and (now > goal * (1 + 1e-12)).any():
                    over = np.divide(goal, now, out=np.ones_like(goal), where=now > goal)[at]
                    w = w * np.minimum(over, 1.0)
                if not hard or np.allclose(np.minimum(np.bincount(at, tokens * w, len(goal)), goal), np.minimum(goal, np.bincount(at, tokens * caps, len(goal))), rtol=1e-9):
                    break
        if not len(w) or np.abs(w - before).max() < TOLERANCE:
            break
    return w


def mix(documents: DataFrame, targets: DataFrame, codes: DataFrame, total: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses): how often each document of a listed source is used.

    ``total`` is the size of the mixture in tokens; None: as many as the listed
    sources have.
    """
    docs = staged(sized(documents, targets, codes), "sized")
    cells = [tuple(r) for r in docs.groupBy("source", "lang", "kind").agg(F.sum("n_tokens").cast("double"), F.count("*")).collect()]
    rules = {r.source: (r.s, r.m) for r in targets.groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()}
    total = total or sum(c[3] for c in cells)
    w = rake([c[:4] for c in cells], {k: v[0] for k, v in rules.items()}, {k: v[1] for k, v in rules.items()}, total)
    weights = documents.sparkSession.createDataFrame([(c[0], c[1], c[2], float(x)) for c, x in zip(cells, w)], "source string, lang string, kind string, w double")
    x = docs.join(weights, ["source", "lang", "kind"]).withColumn("_whole", F.floor(F.col("w") + 1e-9)).withColumn("_p", F.greatest(F.col("w") - F.col("_whole"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    x = x.withColumn("_x", F.when(F.col("_p") > 1e-9, u / F.col("_p"))).withColumn("_s", F.least(F.floor(F.col("_x") * (SLICES // 2)), F.lit(SLICES - 1)))
    slices = x.groupBy("source", "_s").agg(F.sum("n_tokens").alias("_n"), F.sum(F.col("n_tokens") * F.col("_p")).alias("_want"))
    every, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.where("_s is not null").withColumn("_want", F.sum("_want").over(every)).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    state = F.when(F.col("_before") + F.col("_n") <= F.col("_want"), "in").when(F.col("_before") < F.col("_want"), "cut").otherwise("out")
    x = x.join(slices.select("source", "_s", "_want", "_before", state.alias("_state")), ["source", "_s"], "left")
    cut = x.where("_state = 'cut'")
    run = Window.partitionBy("source").orderBy("_x", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    here = F.col("_before") + F.sum("n_tokens").over(run) - F.col("n_tokens") / 2.0 <= F.col("_want")
    uses = lambda extra: (F.col("_whole") + extra.cast("int")).cast("int").alias("uses")
    rest = x.where("_state is null or _state <> 'cut'").select("doc_id", "source", "n_tokens", uses(F.coalesce(F.col("_state") == "in", F.lit(False))))
    return rest.unionByName(cut.select("doc_id", "source", "n_tokens", uses(here)))


def shares(documents: DataFrame, targets: DataFrame, codes: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, reached_share, n_docs, n_used, tokens): what the mixture holds of each listed source."""
    m = mix(documents, targets, codes, total)
    got = m.groupBy("source").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("uses") > 0, 1)).alias("n_used"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    x = t.join(got, "source", "left").na.fill(0, ["n_docs", "n_used", "tokens"])
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row for each listed source, a fixed table
    return x.select("source", "target_share", "max_repeats", "n_docs", "n_used", "tokens", F.when(every > 0, F.col("tokens") / every).otherwise(0.0).alias("reached_share"))
