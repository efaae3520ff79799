"""Problem 7: lines repeated across one site's documents.

An incremental store of three tables in the shared folder, each partition of new
lines a *delta*:

* ``members``: (source, key, doc_id) once each, the key being the 128-bit hash of
  a line's letters without case;
* ``counts``: (source, key, n_docs);
* ``docs``: (source, doc_id) once each, the documents that have lines.

A delta's members are those not yet stored (an anti join on the full triple), so
repeated and late rows and documents that come in two deltas count once. Its
counts are aggregated before they meet the stored counts, and the lines whose
state changes, that is those above the threshold now and not before or the other
way round, name the documents to rebuild; nothing else is touched.

Aggregation starts on the map side with (source, key, doc_id), so neither a
source that holds a third of all documents nor a line that stands in all of them
makes a large group. The threshold joins ``counts`` with one row per source.

Defined cases: a line's letters are the characters of Unicode class L, in lower
case; lines of documents with null source, with null text or with fewer than
``min_letters`` letters are no cases; rows repeated under one line_id count once;
empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.runtime import staged, staging

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 15, 3, 0.1


def letters(text) -> F.Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", ""))


def line_key(text, min_letters: int = MIN_LETTERS) -> F.Column:
    """128-bit hash of a line's letters, null for short lines."""
    k = letters(text)
    return F.when(F.length(k) >= min_letters, F.unhex(F.md5(k)))


def keyed(lines: DataFrame, documents: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(line_id, doc_id, source, key) of all lines with a source; key is null for short lines."""
    own = documents.where("source is not null").select("doc_id", "source").distinct()
    text = lines.select("line_id", "doc_id", letters(F.col("text")).alias("_k"))
    key = F.when(F.length("_k") >= min_letters, F.unhex(F.md5("_k")))
    return text.select("line_id", "doc_id", key.alias("key")).join(own, "doc_id")


class LineStore:
    """The per-source line counts, in versions; a version is complete before it is used."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE):
        self.spark, self.path = spark, path or f"{staging(spark)}/lines-{uuid.uuid4().hex}"
        self.min_docs, self.min_share, self.version = min_docs, min_share, 0

    def _read(self, name: str, version: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/v={v}" for v in range(1, version + 1)]) if version else self.spark.createDataFrame([], schema)

    def members(self, version: int | None = None) -> DataFrame:
        return self._read("members", self.version if version is None else version, "source string, key binary, doc_id bigint")

    def _counts(self, version: int) -> DataFrame:
        schema = "source string, key binary, n_docs bigint"
        return self.spark.read.schema(schema).parquet(f"{self.path}/counts/v={version}") if version else self.spark.createDataFrame([], schema)

    def sizes(self, version: int | None = None) -> DataFrame:
        """(source, n_source): documents with lines of each source."""
        docs = self._read("docs", self.version if version is None else version, "source string, doc_id bigint")
        return docs.groupBy("source").agg(F.count("*").alias("n_source"))

    def crossed(self, version: int | None = None) -> DataFrame:
        """(source, key) of the lines above the threshold in a version."""
        v = self.version if version is None else version
        over = (F.col("n_docs") >= self.min_docs) & (F.col("n_docs") >= F.col("n_source") * F.lit(self.min_share))
        return self._counts(v).where(F.col("n_docs") >= self.min_docs).join(self.sizes(v), "source").where(over).select("source", "key")

    def merge(self, delta: DataFrame) -> None:
        """Add new lines (doc_id, source, key): a new version of the three tables."""
        old, new = self.version, self.version + 1
        fresh = delta.where("key is not null").select("source", "key", "doc_id").distinct()
        docs = delta.select("source", "doc_id").distinct()
        if old:
            fresh = fresh.join(self.members(), ["source", "key", "doc_id"], "left_anti")
            docs = docs.join(self._read("docs", old, "source string, doc_id bigint"), ["source", "doc_id"], "left_anti")
        fresh.write.parquet(f"{self.path}/members/v={new}")
        docs.write.parquet(f"{self.path}/docs/v={new}")
        more = self.spark.read.schema("source string, key binary, doc_id bigint").parquet(f"{self.path}/members/v={new}").groupBy("source", "key").agg(F.count("*").alias("n_docs"))
        if old:
            more = self._counts(old).unionByName(more).groupBy("source", "key").agg(F.sum("n_docs").alias("n_docs"))
        more.write.parquet(f"{self.path}/counts/v={new}")
        self.version = new

    def changed(self) -> DataFrame:
        """(source, key, now) of the lines whose state the last merge changed; now: above the threshold."""
        now = self.crossed().withColumn("now", F.lit(True))
        was = self.crossed(self.version - 1).withColumn("was", F.lit(True))
        both = now.join(was, ["source", "key"], "full_outer")
        return both.where("now is null or was is null").select("source", "key", F.coalesce("now", F.lit(False)).alias("now"))

    def index(self, documents: DataFrame) -> None:
        """Keep where the lines of documents.text stand: (source, key, doc_id, pos), once for each text."""
        t = documents.where("source is not null and text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        t.select("source", line_key(F.col("line")).alias("key"), "doc_id", "pos").where("key is not null").write.parquet(f"{self.path}/texts")

    def places(self) -> DataFrame:
        return self.spark.read.schema("source string, key binary, doc_id bigint, pos int").parquet(f"{self.path}/texts")

    def drops(self, of: DataFrame | None = None) -> DataFrame:
        """(doc_id, drop): places of the lines above the threshold now, in all texts or in the documents ``of``."""
        at = self.places() if of is None else self.places().join(of, "doc_id", "left_semi")
        return at.join(self.crossed(), ["source", "key"], "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("drop"))

    def texts_to_rebuild(self) -> DataFrame:
        """(doc_id): documents whose text holds a line whose state the last merge changed."""
        return self.places().join(self.changed(), ["source", "key"], "left_semi").select("doc_id").distinct()

    def to_rebuild(self) -> DataFrame:
        """(doc_id): documents with a line whose state the last merge changed."""
        return self.members().join(self.changed(), ["source", "key"], "left_semi").select("doc_id").distinct()


def deltas(lines: DataFrame, at: str = "loaded_at") -> list[DataFrame]:
    """The loads of a line table: the first nine tenths by time of arrival, and what came later."""
    cut = lines.agg(F.percentile_approx(F.col(at).cast("timestamp").cast("double"), 0.9)).first()[0]
    if cut is None:
        return [lines]
    late = F.coalesce(F.col(at).cast("timestamp").cast("double") > F.lit(cut), F.lit(False))
    return [lines.where(~late), lines.where(late)]


def store_of(lines: DataFrame, documents: DataFrame, **kw) -> LineStore:
    """A store that all loads of ``lines`` were merged into, one after the other."""
    store = LineStore(lines.sparkSession, **kw)
    for d in deltas(lines):
        store.merge(keyed(d, documents).drop("line_id"))
    return store


def repeated_lines(lines: DataFrame, documents: DataFrame, **kw) -> DataFrame:
    """(line_id): each line that is repeated excessively within its source."""
    store = store_of(lines, documents, **kw)
    hits = keyed(lines, documents).where("key is not null").join(store.crossed(), ["source", "key"], "left_semi")
    return hits.select("line_id").distinct()


def cleaned_documents(documents: DataFrame, lines: DataFrame, **kw) -> DataFrame:
    """(doc_id, text, n_removed): documents.text without the lines of its source above the threshold.

    The texts' lines are indexed by source and key once. The first load of lines names the
    documents to rebuild; each later one renews only those whose text holds a
    line that crossed the threshold in it. Documents never named pass
    unchanged and unsplit. A text line is compared by the same key as the stored lines.
    """
    store = LineStore(lines.sparkSession, **kw)
    store.index(documents)
    state = None
    for d in deltas(lines):
        store.merge(keyed(d, documents).drop("line_id"))
        if state is None:
            state = staged(store.drops(), "drops")
        else:
            again = staged(store.texts_to_rebuild(), "rebuild")
            state = staged(state.join(again, "doc_id", "left_anti").unionByName(store.drops(again)), "drops")
    x = documents.select("doc_id", "text").join(state, "doc_id", "left")
    keep = F.filter(F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda t: ~F.array_contains("drop", t.i))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda t: t.t), "\n"))
    return x.select("doc_id", text.alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"))
