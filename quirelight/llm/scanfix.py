r"""Problem 3: noise in text from scanned pages.

* *Furniture* (running heads, folios) is found with SQL windows over the lines of
  a document: digits are masked, glyphs that scanners confuse fall together, and a
  line that stands alone at the head of a page is compared by key with the document's
  headings and with the heads of its other pages (``line_kinds``). In zones the lines
  are compared by key with the heads found on the document's pages and with its titles.
* *Hyphenation*: a window reads the next line of the text, furniture and notices
  left out. A mark vanishes unless the corpus has the hyphenated word more often
  than the joined one.
* *Misread words* are grouped by confusable-glyph skeleton (``rn`` and ``m``, ``c``
  and ``e``, ``0`` and ``o`` fall together; Latin, Cyrillic and Greek letters have confusable
  glyphs, words of other scripts are misread only where signs stand between letters). A rare form
  is replaced by a form of its group that is ``RATIO`` (short words: ``SHORT_RATIO``) times
  as frequent. Of several the neighbours choose: the form that the corpus has most
  often after the word before or before the word after, with at least 1/``PAIR_RATIO`` of
  the rare form's own support there. Word and context counts cover the whole
  corpus; only what a Bloom filter lets pass is counted or joined, and the joins
  decide exactly.
* *Reflow*: the repaired lines of a document and of its zones, joined to paragraphs.

Notices are lines in a smaller type than the document's text. ``scanned`` is a
page with any line whose source says OCR, in any spelling.

Defined cases: null and empty texts have no defect; repeated rows count once; a
document without headings still has heads by repetition; empty tables give empty
results; of zones only the current row counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.operators.hierarchy import current_zones
from quirelight.runtime import staged

RATIO, SHORT_RATIO, PAIR_RATIO = 8, 60, 4
#: Letters of a word from which the lower ratio holds; shorter words often share a skeleton by chance.
LONG_WORD = 5
MARKS = "-‐¬­"
# Glyphs that scanners confuse. The second of a pair stands for both; a letter
# that is read as two is spelt as these two, so that every reading has one skeleton.
GLYPHS = {"c": "e", "|": "i", "1": "l", "t": "l", "0": "o", "@": "a", "5": "s", "6": "b", "q": "g", "ſ": "f"}
GLYPHS |= {"о": "o", "а": "a", "с": "e", "е": "e", "б": "b", "3": "з", "щ": "ш", "ъ": "ь", "н": "и", "п": "и"}
GLYPHS |= {"ο": "o", "α": "a", "υ": "v", "ν": "v", "ό": "ό"}
SPELT = (("m", "rn"), ("n", "ri"), ("h", "li"), ("u", "ii"), ("d", "el"), ("w", "vv"))
#: Characters that no word has but by misreading.
NOT_LETTERS = "01568@|"


def skeleton(word) -> F.Column:
    """The confusable-glyph skeleton of a word column."""
    x = F.translate(F.lower(word), "".join(GLYPHS), "".join(GLYPHS.values()))
    for a, b in SPELT:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def letters_key(text) -> F.Column:
    """Letters of a line without case, confusable glyphs falling together; blanks and digits left out."""
    return skeleton(F.regexp_replace(F.lower(text), r"[^\p{L}|@0156]+", ""))


_FOLIO = r"^[\[(\-–—\s|]*(?:[Pp][a@]g[ec]\s+)?(?:[0-9OolIiSsBb|]{1,4}|[ivxlcIVXLC|1]{1,7})(?:\s*/\s*[0-9OolI|]{1,4})?[\])\-–—\s|]*$"
_CHAPTER = r"^(?:[0-9OolI]+\s+)?[Cc]\s?h\s?[a@]\s?p\s?t\s?[ec]\s?r\s+[0-9OolIi| ]+\s*\."
FINISHED = r"[.!?…;,。！？।][”»“’\"」)]*$"
#: Letters of a masked head that make it comparable with other heads, and with a heading that it may be cut from.
HEAD_LETTERS, TITLE_LETTERS = 4, 8


def head_key(text) -> F.Column:
    """A running head in comparable form: folio and chapter number masked, then ``letters_key``."""
    x = F.regexp_replace(text, r"^[0-9OolI|]+\s{2,}|\s{2,}[0-9OolI|]+$", "")
    return letters_key(F.regexp_replace(x, _CHAPTER, ""))


def _cut_from(key, title) -> F.Column:
    """Whether one of two keys is the beginning of the other."""
    return F.startswith(title, key) | F.startswith(key, title)


def line_kinds(lines: DataFrame) -> DataFrame:
    """Lines once each, with ``scanned``, ``kind`` (text, heading, notice, furniture), their place, and ``head``, the key of a running head.

    A *head* stands alone and first on a scanned page and doesn't begin with a small
    letter. It is furniture if its masked key stands at the head of another page or
    begins like a heading of the document, and otherwise if it doesn't finish a
    sentence: a lone line of body text at the head of a page ends a paragraph.
    All windows are partitioned by the document or finer, so one shuffle serves them.
    """
    cols = ["line_id", "doc_id", "page", "block_no", "line_no", "text", "font_size", "bold", "source"]
    x = lines.where("line_id is not null").select(*cols).repartition("doc_id")
    doc, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    block, size = Window.partitionBy("doc_id", "page", "block_no"), Window.partitionBy("doc_id", "font_size")
    x = x.withColumn("_again", F.lag("line_id").over(block.orderBy("line_no", "line_id"))).where("_again is null or _again <> line_id").drop("_again")
    x = x.withColumn("nb", F.count("*").over(block)).withColumn("scanned", F.coalesce(F.max(F.lower("source").contains("ocr")).over(page), F.lit(False))).drop("source")
    n = F.length(F.coalesce("text", F.lit("")))
    weight = F.when(F.coalesce("bold", F.lit(False)), F.lit(0)).otherwise(F.when(F.col("nb") > 1, n * 20).otherwise(n))
    x = x.withColumn("_w", F.sum(weight).over(size)).withColumn("body", F.max(F.struct("_w", "font_size")).over(doc)["font_size"])
    x = x.withColumn("big", F.coalesce(F.col("bold") & (F.col("font_size") > F.col("body") + 0.4), F.lit(False)))
    x = x.withColumn("small", F.coalesce(F.col("font_size") < F.col("body") - 0.4, F.lit(False)))
    x = x.withColumn("folio", (F.col("nb") == 1) & F.coalesce(F.trim("text").rlike(_FOLIO), F.lit(False))).drop("_w", "body", "bold", "font_size")
    place = F.struct("block_no", "line_no")
    x = x.withColumn("_first", F.min(F.when(~F.col("small") & ~F.col("folio"), place)).over(page))
    x = x.withColumn("lone", (F.col("nb") == 1) & ~F.col("small") & ~F.col("big") & F.col("scanned"))
    x = x.withColumn("top", F.col("lone") & ~F.col("folio") & F.coalesce(F.col("_first") == place, F.lit(False))).drop("_first", "nb")
    x = x.withColumn("_key", F.when(F.col("big") | F.col("top"), head_key(F.trim("text")))).withColumn("_k8", F.substring("_key", 1, TITLE_LETTERS))
    same, alike = Window.partitionBy("doc_id", "_k8", "_key"), Window.partitionBy("doc_id", "_k8")
    own = F.when(F.col("top"), F.col("page"))
    x = x.withColumn("_again", (F.length("_key") >= HEAD_LETTERS) & (F.min(own).over(same) < F.max(own).over(same)))
    x = x.withColumn("_titles", F.collect_set(F.when(F.col("big"), F.col("_key"))).over(alike))
    t = F.trim("text")
    titled = (F.length("_key") >= TITLE_LETTERS) & F.exists("_titles", lambda h: _cut_from(F.col("_key"), h))
    head = F.col("top") & ~t.rlike(r"^\p{Ll}") & (F.col("_again") | ~t.rlike(FINISHED) & ~t.rlike(f"[{MARKS}]$") | titled)
    x = x.withColumn("head", F.when(F.coalesce(head, F.lit(False)), F.col("_key")))
    kind = F.when(F.col("lone") & F.col("folio") | F.col("head").isNotNull(), "furniture").when(F.col("small"), "notice").when(F.col("big"), "heading").otherwise("text")
    return x.select("line_id", "doc_id", "page", "block_no", "line_no", "text", "scanned", kind.alias("kind"), "head")


def zone_texts(zones: DataFrame) -> DataFrame:
    """(zone_id, doc_id, tag, text) of the current zones that are paragraphs or titles."""
    return current_zones(zones, "tag", "doc_id", "text").where("text <> '' and tag in ('p', 'title')")


def zone_furniture(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(zone_id, skip): the places (from 0) of folios and running heads among the lines of paragraphs of several lines.

    ``texts`` as by ``zone_texts``, ``kinds`` as by ``line_kinds``. A line is a head if
    its masked key is that of a head on the document's pages or begins like one of its
    titles; candidates and heads meet by document and first letters.
    """
    x = texts.where("tag = 'p'").where(F.contains("text", F.lit("\n"))).select("zone_id", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    x = x.withColumn("line", F.trim("line")).where("line <> ''")
    folios = x.where(F.col("line").rlike(_FOLIO)).select("zone_id", "pos")
    open_ = x.where(~F.col("line").rlike(r"^\p{Ll}") & ~F.col("line").rlike(FINISHED) & ~F.col("line").rlike(_FOLIO))
    open_ = open_.select("zone_id", "doc_id", "pos", head_key(F.col("line")).alias("key")).where(F.length("key") >= HEAD_LETTERS)
    heads = kinds.where("head is not null").select("doc_id", F.col("head").alias("known"), F.lit(False).alias("title"))
    titles = texts.where("tag = 'title'").select("doc_id", head_key(F.trim("text")).alias("known"), F.lit(True).alias("title"))
    known = heads.unionByName(titles).where(F.length("known") >= HEAD_LETTERS).distinct()
    k8 = lambda c: F.substring(c, 1, TITLE_LETTERS)
    a, b = open_.withColumn("k8", k8("key")).alias("a"), known.withColumn("k8", k8("known")).alias("b")
    same = (F.col("key") == F.col("known")) | F.col("title") & (F.length("key") >= TITLE_LETTERS) & _cut_from(F.col("key"), F.col("known"))
    found = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.k8") == F.col("b.k8")) & same, "left_semi").select("zone_id", "pos")
    return folios.unionByName(found).groupBy("zone_id").agg(F.collect_set("pos").alias("skip"))


#: Stands between the parts of a word that was broken at the end of a line.
JOINT = "\x1f"
_WORD = re.compile(r"[\w@|\x1f]+(?:[-‐][\w@|\x1f]+)*")
_PART = re.compile(r"[\w@|\x1f]+")
_MARK_GAP = re.compile(rf"[{MARKS}](?:\s+|$)")
#: Between two texts of a batch, so that no word or pair runs over.
_GAP = f" {JOINT} "


def _tokens(texts: list[str | None], pattern: re.Pattern = _PART) -> list[str]:
    """Words of all texts in order, without case, a _GAP between texts; broken words hold a JOINT."""
    joined = _MARK_GAP.sub(JOINT, _GAP.join([t for t in texts if t]).lower())
    return pattern.findall(joined)


def word_counts(texts: DataFrame) -> DataFrame:
    """(form, n): words of the corpus without case, compounds whole and by their parts; broken words left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def rows():
            for w in list(n):
                if JOINT in w or w[0] >= "฀":
                    del n[w]
                elif "-" in w or "‐" in w:
                    k = n.pop(w)
                    n[w.replace("‐", "-")] += k
                    for part in re.split("[-‐]", w):
                        n[part] += k
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["form", "n"])

        for batch in batches:
            n.update(_tokens(batch.column(0).to_pylist(), _WORD))
            if len(n) > 200_000:
                yield rows()
                n.clear()
        yield rows()

    return texts.select("text").mapInArrow(run, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))


class Filter:
    """A Bloom filter of 64-bit hashes; its size follows the number of keys.

    About BITS_A_KEY bits a key up to MAX_BITS, where more keys let more strangers pass: the
    joins after it decide exactly, so that costs time and changes no result. The bits
    are set by Spark's bitmap aggregates, one row for 32,768 of them.
    """

    BITS_A_KEY, MIN_BITS, MAX_BITS = 16, 1 << 18, 1 << 28

    def __init__(self, hashes: DataFrame):
        """``hashes``: one bigint column."""
        n = self.BITS_A_KEY * hashes.count()
        self.size = min(max(1 << max(n - 1, 1).bit_length(), self.MIN_BITS), self.MAX_BITS)
        h, mask = F.col(hashes.columns[0]), F.lit(self.size - 1)
        slot = hashes.select(F.explode(F.array(*[(x.bitwiseAND(mask) + 1).alias("s") for x in (h, F.shiftrightunsigned(h, 34))])).alias("s"))
        rows = slot.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        self.bits = np.zeros(self.size // 8, np.uint8)
        for r in rows.toLocalIterator():
            self.bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash (uint64) may be a key."""
        hit = np.ones(len(h), bool)
        for s in (h & np.uint64(self.size - 1), h >> np.uint64(34) & np.uint64(self.size - 1)):
            hit &= (self.bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return hit


def hashed(words: list[str]) -> np.ndarray:
    """The hashes of the SQL function xxhash64 (seed 42)."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64, len(words))


_TO_GLYPHS = str.maketrans(GLYPHS)


def skeletons(words: list[str]) -> list[str]:
    """``skeleton`` of words in small letters."""
    joined = "\n".join(words).translate(_TO_GLYPHS)
    for a, b in SPELT:
        joined = joined.replace(a, b)
    return joined.split("\n")


def candidates(counts: DataFrame) -> DataFrame:
    """(form, n, k, best): rare forms with their skeleton and the most frequent form of it."""
    own = counts.where(r"form rlike '^[\\p{L}\\p{M}0-9@|]{2,}$' and form rlike '\\p{L}' and not form rlike '^[0-9]+(st|nd|rd|th)$'").withColumn("k", skeleton(F.col("form")))
    clean = own.where(_CLEAN)
    best = clean.groupBy("k").agg(F.max(F.struct("n", "form")).alias("b")).select("k", F.col("b.form").alias("best"), F.col("b.n").alias("n_best"))
    return own.join(best, "k").where(F.col("form") != F.col("best")).where(_frequent(F.col("n_best"), F.col("n"), F.col("form"))).select("form", "n", "k", "best")


_CLEAN = f"not form rlike '[{NOT_LETTERS}ſ0-9]'"


def _frequent(n_best, n, form) -> F.Column:
    return n_best >= n * F.when(F.length(form) >= LONG_WORD, RATIO).otherwise(SHORT_RATIO)


#: Letters around a character that is no letter: misread whether or not the word is known.
_INSIDE = re.compile(r"(?:[^\W\d_][0156@|]+|^[0@|5]+)(?=[^\W\d_]{2})|[^\W\d_]{3}[0156@|]+$|[^\W\d_]ſ[a-z]|^ſ[a-z]")
_PLAIN_CODE = re.compile(r"^\d+(st|nd|rd|th)$|^[a-zA-Z]{1,2}\d+$|^v\d|^\d+[^\W\d_]+$")
#: Between the two parts of a context.
_SLOT = "\x1e"


def _contexts(word, prev, next_) -> F.Column:
    """The two contexts of a skeleton: after the word before it, and before the word after it, each with its hash."""
    h = lambda c: F.xxhash64(c)
    left = F.struct(F.concat_ws(_SLOT, prev, word, F.lit("")).alias("ctx"), h(prev).bitwiseXOR(F.shiftleft(h(word), 1)).alias("h"))
    right = F.struct(F.concat_ws(_SLOT, F.lit(""), word, next_).alias("ctx"), h(next_).bitwiseXOR(F.shiftleft(h(word), 2)).alias("h"))
    return F.filter(F.array(F.when(prev != "", left), F.when(next_ != "", right)), lambda c: c.isNotNull())


def context_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ctx, form, n): how often each form stands in the contexts (ctx, h) ``wanted``, over the whole corpus.

    All pairs of neighbours of a batch are tested by their hashes at once; only those
    that pass are written out, and the join keeps the wanted ones exactly.
    """
    passes = texts.sparkSession.sparkContext.broadcast(Filter(wanted.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok, n = passes.value, Counter()
        number, names, bones = {}, [], []
        own, bone = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def rows():
            keys = list(n)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())], names=["ctx", "form", "n"])

        for batch in batches:
            ws = _tokens(batch.column(0).to_pylist())
            if new := list(set(ws).difference(number)):
                number.update(zip(new, range(len(names), len(names) + len(new))))
                more = skeletons(new)
                names += new
                bones += more
                own, bone = np.append(own, hashed(new)), np.append(bone, hashed(more))
            code = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            pairs, k = np.unique(code[:-1] << 32 | code[1:], return_counts=True)
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            for hit, left in ((ok(own[a] ^ bone[b] << np.uint64(1)), True), (ok(own[b] ^ bone[a] << np.uint64(2)), False)):
                at = np.flatnonzero(hit)
                for x, y, m in zip(a[at].tolist(), b[at].tolist(), k[at].tolist()):
                    n[(f"{names[x]}{_SLOT}{bones[y]}{_SLOT}", names[y]) if left else (f"{_SLOT}{bones[x]}{_SLOT}{names[y]}", names[x])] += m
            if len(names) > 200_000:
                number, names, bones = {}, [], []
                own, bone = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            if len(n) > 300_000:
                yield rows()
                n.clear()
        yield rows()

    seen = texts.select("text").mapInArrow(run, "ctx string, form string, n bigint").groupBy("ctx", "form").agg(F.sum("n").alias("n"))
    return seen.join(wanted.select("ctx"), "ctx", "left_semi")


def chosen_forms(open_: DataFrame, texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, prev, next, form, sure): the form that the neighbours support best for each misread word in its place.

    Forms are those of the word's skeleton that are frequent enough beside it; ``best`` of
    ``candidates`` stands where the neighbours support none. ``sure``: the form has at
    least 1/PAIR_RATIO of the support of the word itself.
    """
    occ = open_.select("word", "prev", "next", "best", "n", "k").distinct().withColumn("_c", _contexts(F.col("k"), F.col("prev"), F.col("next")))
    wanted = staged(occ.select(F.inline("_c")).distinct(), "contexts")
    seen = staged(context_counts(texts, wanted), "seen")
    known = counts.where(_CLEAN).select("form", F.col("n").alias("n_form"))
    top = seen.join(known, "form").groupBy("ctx").agg(F.max(F.struct("n", "n_form", "form")).alias("t"))
    long = occ.select("word", "prev", "next", "best", F.col("n").alias("n_word"), F.explode_outer("_c.ctx").alias("ctx"))
    own = seen.select("ctx", F.col("form").alias("word"), F.col("n").alias("own"))
    other = seen.select("ctx", F.col("form").alias("best"), F.col("n").alias("other"))
    x = long.join(own, ["ctx", "word"], "left").join(other, ["ctx", "best"], "left").join(top, "ctx", "left")
    fit = (F.col("t.form") != F.col("word")) & _frequent(F.col("t.n_form"), F.col("n_word"), F.col("word"))
    alt = F.max(F.when(fit, F.struct(F.col("t.n").alias("n"), F.col("t.form").alias("form"))))
    y = x.groupBy("word", "prev", "next", "best").agg(F.coalesce(F.max("own"), F.lit(0)).alias("own"), F.coalesce(F.max("other"), F.lit(0)).alias("other"), alt.alias("alt"))
    better = F.coalesce(F.col("alt.n") > F.col("other"), F.lit(False))
    return y.select("word", "prev", "next", F.when(better, F.col("alt.form")).otherwise(F.col("best")).alias("form"), (F.when(better, F.col("alt.n")).otherwise(F.col("other")) * PAIR_RATIO >= F.col("own")).alias("sure"))


def misread_places(units: DataFrame, texts: DataFrame, counts: DataFrame, cand: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, next_id, word, first, prev, next, best): misread words of the units (rec_kind, rec_id, next_id, text) in their places.

    ``cand`` as by ``candidates`` or ``repairable``. A word that goes on in the unit ``next_id`` holds a JOINT in
    the text; ``first`` is its part before it. ``best`` is null where a word holds a
    character that is no letter but no frequent form is known.
    """
    wanted = units.sparkSession.sparkContext.broadcast(Filter(cand.select(F.xxhash64("form"))))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok, seen = wanted.value, {}
        for batch in batches:
            texts_ = batch.column(3).to_pylist()
            split = [_PART.findall(t) for t in "\n".join(t.replace("\n", " ") if t else "" for t in texts_).lower().split("\n")]
            new = list(set().union(*split).difference(seen))
            if new:
                plain = [w.replace(JOINT, "") for w in new]
                for w, x, hit in zip(new, plain, ok(hashed(plain)).tolist()):
                    inside = _INSIDE.search(x) is not None and not _PLAIN_CODE.match(x) and max(x) < "֐"
                    seen[w] = 2 if inside else int(hit)
            some = {w for w, v in seen.items() if v} if len(seen) < 50_000 else {w for w in set().union(*split) if seen[w]}
            rows = []
            for i, ws in enumerate(split):
                if some.isdisjoint(ws):
                    continue
                flat = ["", *(w.replace(JOINT, "") for w in ws), ""]
                rows += [(i, flat[j + 1], w.partition(JOINT)[0], flat[j], flat[j + 2], seen[w] == 2) for j, w in enumerate(ws) if w in some]
            cols = list(zip(*rows)) if rows else [[]] * 6
            keys = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keys) for c in range(3)), *(pa.array(c, pa.string()) for c in cols[1:5]), pa.array(cols[5], pa.bool_())], names=["rec_kind", "rec_id", "next_id", "word", "first", "prev", "next", "inside"])
            if len(seen) > 200_000:
                seen.clear()

    occ = units.select("rec_kind", "rec_id", "next_id", "text").mapInArrow(occurrences, "rec_kind string, rec_id string, next_id string, word string, first string, prev string, next string, inside boolean")
    sure_only = "inside" + (" or best is not null and not only_broken" if "only_broken" in cand.columns else " or best is not null")
    hit = staged(occ.join(cand.withColumnRenamed("form", "word"), "word", "left").where(sure_only), "misread")
    form = chosen_forms(hit.where("best is not null"), texts, counts)
    x = hit.join(form, ["word", "prev", "next"], "left").where("inside or sure").withColumn("best", F.coalesce("form", "best"))
    return x.select("rec_kind", "rec_id", "next_id", "word", "first", "prev", "next", "best")


def misread_words(units: DataFrame, texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, word, best): ``misread_places`` of the units; a broken word is counted for the unit whose part differs from the right form."""
    x = misread_places(units, texts, counts, staged(candidates(counts), "misread-forms"))
    rest = F.expr("substring(word, length(first) + 1)")
    odd = rf"[\p{{L}}][{NOT_LETTERS}ſ]|[{NOT_LETTERS}ſ][\p{{L}}]"
    here = F.when(F.col("first") == F.col("word"), True).when(F.col("best").isNull(), F.col("first").rlike(odd)).otherwise(~F.startswith("best", F.col("first")))
    there = F.when(F.col("first") == F.col("word"), False).when(F.col("best").isNull(), rest.rlike(odd)).otherwise(~F.endswith("best", rest))
    ids = F.filter(F.array(F.when(here, F.col("rec_id")), F.when(there, F.coalesce("next_id", "rec_id"))), lambda i: i.isNotNull())
    return x.select("rec_kind", F.explode(ids).alias("rec_id"), "word", "best")


def hyphens(flow: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``flow`` (keys, text, next) whose last word is broken by a mark that must vanish, with ``joined``."""
    a = F.regexp_extract("text", rf"([\p{{L}}\p{{M}}\p{{N}}@|]+(?:[-‐][\p{{L}}\p{{M}}\p{{N}}@|]+)*)([{MARKS}])\s*$", 1)
    mark = F.regexp_extract("text", rf"[\p{{L}}\p{{M}}@|]([{MARKS}])\s*$", 1)
    b = F.regexp_extract("next", r"^\s*([\p{L}\p{M}@|0156]+)", 1)
    x = flow.withColumn("_a", F.lower(a)).withColumn("_m", mark).withColumn("_b", F.lower(b)).where("_a <> '' and _m <> '' and _b <> ''")
    x = x.withColumn("joined", F.concat("_a", "_b")).withColumn("_kept", F.concat("_a", F.lit("-"), "_b"))
    c1 = counts.select(F.col("form").alias("joined"), F.col("n").alias("_n1"))
    c2 = counts.where("form like '%-%'").select(F.col("form").alias("_kept"), F.col("n").alias("_n2"))
    x = x.join(c1, "joined", "left").join(c2, "_kept", "left")
    keeps = F.col("_m").isin("-", "‐") & (F.coalesce("_n2", F.lit(0)) > F.coalesce("_n1", F.lit(0)))
    return x.where(~keeps).drop("_a", "_b", "_m", "_kept", "_n1", "_n2")


def corpus(lines: DataFrame, zones: DataFrame) -> DataFrame:
    return zones.select("text").unionByName(lines.select("text"))


_TAIL = rf"(?<=[\p{{L}}\p{{M}}@|])[{MARKS}]\s*$"
_SPLIT_IN_ZONE = rf"\n|(?<=[\p{{L}}@|][{MARKS}]) +(?=[\p{{L}}@|])"


def _broken(text) -> F.Column:
    """Whether a line ends in a mark after a letter; the cheap test comes first."""
    return F.coalesce(F.substring(F.rtrim(text), -1, 1).isin(*MARKS) & text.rlike(_TAIL), F.lit(False))


def _place(*columns) -> F.Column:
    """The place of a line in its document or zone, by ``columns`` or literals."""
    names = ("page", "block_no", "line_no", "line_id")
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(n) for c, n in zip(columns, names)]).alias("place")


def line_flow(kinds: DataFrame) -> DataFrame:
    """Scanned lines: rec_kind, rec_id, kind, text, ``next`` and ``next_id`` (where the last word is broken), ``after`` (whether the line before ends in a broken word), doc_id, ``place``."""
    order = Window.partitionBy("doc_id", "kind").orderBy("page", "block_no", "line_no", "line_id")
    x = kinds.where("kind <> 'notice'").withColumn("_t", _broken(F.col("text")))
    x = x.withColumn("_n", F.lead("text").over(order)).withColumn("_i", F.lead("line_id").over(order)).withColumn("after", F.coalesce(F.lag("_t").over(order), F.lit(False))).where("scanned")
    return x.select(F.lit("line").alias("rec_kind"), F.col("line_id").cast("string").alias("rec_id"), "kind", "text", F.when(F.col("_t"), F.col("_n")).alias("next"), F.when(F.col("_t"), F.col("_i").cast("string")).alias("next_id"), "after", "doc_id", _place("page", "block_no", "line_no", "line_id"))


def zone_flow(texts: DataFrame, furniture: DataFrame) -> DataFrame:
    """The lines of paragraph zones in the columns of ``line_flow``; furniture left out.

    A zone is split where a line ended: at a line feed, or at a blank after a mark
    between letters. Each line takes its neighbours along from the array of the zone;
    ``place`` counts the lines of a zone.
    """
    p = texts.where("tag = 'p'").join(furniture, "zone_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("skip", i))
    x = p.select("zone_id", "doc_id", F.when(F.col("skip").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    cut = F.contains("text", F.lit("\n"))
    for m in MARKS:
        cut = cut | F.contains("text", F.lit(m + " "))
    one = x.where(~cut).select("zone_id", "doc_id", "text", F.lit(None).cast("string").alias("next"), F.lit(False).alias("after"), F.lit(0).alias("i"))
    many = x.where(cut).select("zone_id", "doc_id", F.split("text", _SPLIT_IN_ZONE, -1).alias("l"))
    lines = F.transform("l", lambda t, i: F.struct(t.alias("text"), F.when(_broken(t), F.get("l", i + 1)).alias("next"), ((i > 0) & _broken(F.get("l", i - 1))).alias("after"), i.alias("i")))
    many = many.select("zone_id", "doc_id", F.inline(lines))
    null, zero = F.lit(None).cast("string"), F.lit(0)
    return one.unionByName(many).select(F.lit("zone").alias("rec_kind"), F.col("zone_id").alias("rec_id"), F.lit("text").alias("kind"), "text", "next", null.alias("next_id"), "after", "doc_id", _place(zero, zero, "i", zero))


def joined_units(flow: DataFrame) -> DataFrame:
    """Units whose broken words are whole, with a JOINT, in the unit of the first part."""
    return flow.select("rec_kind", "rec_id", "next_id", _whole().alias("text"))


#: What a line begins with that may end the broken word before it.
_FIRST = r"^\s*[\p{L}\p{M}0156@|]+"


def _own() -> F.Column:
    """The text of a unit without the end of the broken word before it."""
    return F.when(F.col("after"), F.regexp_replace("text", _FIRST, "")).otherwise(F.col("text"))


def _whole() -> F.Column:
    """The text of a unit by the columns of ``line_flow``, its broken word whole."""
    text = _own()
    rest = F.ltrim(F.regexp_extract("next", _FIRST, 0))
    return F.when(F.col("next").isNotNull(), F.concat(F.regexp_replace(text, _TAIL, ""), F.lit(JOINT), rest)).otherwise(text)


def defects(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, defect) of lines on scanned pages and of current zones."""
    counts = staged(word_counts(corpus(lines, zones)), "words")
    kinds, texts = staged(line_kinds(lines), "kinds"), staged(zone_texts(zones), "zones")
    skip = staged(zone_furniture(texts, kinds), "furniture")
    heads = kinds.where("scanned and kind = 'furniture'").select(F.lit("line").alias("rec_kind"), F.col("line_id").cast("string").alias("rec_id"))
    heads = heads.unionByName(skip.select(F.lit("zone").alias("rec_kind"), F.col("zone_id").alias("rec_id"))).withColumn("defect", F.lit("furniture"))
    flow = staged(line_flow(kinds).where("kind <> 'furniture'").unionByName(zone_flow(texts, skip)).drop("doc_id", "place"), "flow")
    broken = hyphens(flow.where("next is not null"), counts).select("rec_kind", "rec_id", F.lit("hyphen").alias("defect"))
    wrong = misread_words(joined_units(flow), corpus(lines, zones), counts).select("rec_kind", "rec_id", F.lit("misread").alias("defect"))
    return broken.unionByName(wrong).unionByName(heads).distinct()


def repairable(flow: DataFrame, counts: DataFrame) -> DataFrame:
    """(form, n, k, best, only_broken): ``candidates``, and those of broken words that the corpus has in no line whole.

    The latter hold a character that is no letter: others are no misreadings for sure.
    """
    whole = F.lower(F.replace(F.regexp_extract(_whole(), rf"[\p{{L}}\p{{N}}_@|]*{JOINT}[\p{{L}}\p{{N}}_@|]*$", 0), F.lit(JOINT), F.lit("")))
    more = flow.where("next is not null").select(whole.alias("form")).where(f"form rlike '[{NOT_LETTERS}ſ]'").distinct()
    more = more.join(counts, "form", "left_anti").select("form", F.lit(1).cast("bigint").alias("n"))
    own = candidates(counts.select("form", "n").unionByName(more))
    return own.join(more.select("form", F.lit(True).alias("only_broken")), "form", "left").withColumn("only_broken", F.coalesce("only_broken", F.lit(False)))


def _cased(best, word) -> F.Column:
    """``best`` (small letters) with the capitals of ``word``."""
    big = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    capital = F.concat(F.upper(F.substring(best, 1, 1)), best.substr(F.lit(2), F.length(best)))
    return F.when(big(word), F.upper(best)).when(big(F.substring(word, 1, 1)), capital).otherwise(best)


def repaired_units(flow: DataFrame) -> DataFrame:
    """Adds ``head``, ``body`` and ``moved`` to units with ``fixes`` (prev, word, next -> right form) and ``broken``.

    ``head`` is what ends the broken word of the unit before, ``body`` the rest with its right
    forms in their places. A broken word with a right form stands whole in the unit of its
    first part (``moved``), and the next unit's ``head`` falls away.
    """
    letter = r"[\p{L}\p{N}_@|\x1f]"
    cut = rf"(?<={letter})(?!{letter})|(?<!{letter})(?={letter})"
    plain = lambda w: F.lower(F.replace(F.coalesce(w, F.lit("")), F.lit(JOINT), F.lit("")))

    def fixed(w, i):
        words = F.col("_w")
        best = F.try_element_at("fixes", F.concat_ws(_SLOT, plain(F.get(words, i - 2)), plain(w), plain(F.get(words, i + 2))))
        # a broken word that ends the unit, with letters on either side, and whose mark must vanish
        whole = F.col("broken") & F.endswith(F.col("_u"), w) & ~F.startswith(w, F.lit(JOINT)) & ~F.endswith(w, F.lit(JOINT))
        new = F.when(~F.contains(w, F.lit(JOINT)), _cased(best, w)).when(whole, F.concat(_cased(best, w), F.lit(JOINT)))
        return F.coalesce(F.when(w.rlike(letter) & best.isNotNull(), new), w)

    some = F.col("fixes").isNotNull()
    x = flow.withColumn("_u", F.when(some, _whole())).withColumn("_w", F.split("_u", cut, -1)).withColumn("_r", F.array_join(F.transform("_w", fixed), ""))
    goes_on = F.col("next").isNotNull()
    x = x.withColumn("moved", F.coalesce(some & goes_on & ~F.endswith("_u", F.lit(JOINT)) & F.endswith("_r", F.lit(JOINT)), F.lit(False)))
    x = x.withColumn("head", F.when(F.col("after"), F.regexp_extract("text", _FIRST, 0)).otherwise(F.lit("")))
    own = F.when(goes_on, F.concat(F.regexp_extract("_r", rf"(?s)^(.*){JOINT}", 1), F.regexp_extract(_own(), _TAIL, 0))).otherwise(F.col("_r"))
    return x.withColumn("body", F.when(some, own).otherwise(F.expr("substring(text, length(head) + 1)"))).drop("_u", "_w", "_r")


def repaired_lines(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, zone_id, paragraph, kind, text): continuous paragraphs of each document's scanned lines (zone_id null), and of its zones.

    Furniture is left out, misread words are replaced in their places, broken words joined.
    A window over the lines opens a paragraph where a block begins with a line that
    the text before doesn't run into; notices don't interrupt the text, each block of
    them is a paragraph of its own kind. Paragraphs are numbered in reading order. A
    current zone with tag p is one paragraph; empty ones have none.
    """
    counts = staged(word_counts(corpus(lines, zones)), "words")
    ls, texts = staged(line_kinds(lines), "kinds"), staged(zone_texts(zones), "zones")
    of_zones = zone_flow(texts, zone_furniture(texts, ls)).withColumnRenamed("rec_id", "zone_id")
    unit = lambda i: F.concat("zone_id", F.lit(JOINT), i.cast("string"))
    of_zones = of_zones.withColumn("rec_id", unit(F.col("place.line_no"))).withColumn("next_id", F.when(F.col("next").isNotNull(), unit(F.col("place.line_no") + 1)))
    of_lines = line_flow(ls).where("kind <> 'furniture'").withColumn("zone_id", F.lit(None).cast("string"))
    flow = staged(of_lines.unionByName(of_zones), "flow")
    broken = hyphens(flow.where("next is not null"), counts).select("rec_id", F.lit(True).alias("broken"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("best"))
    cand = staged(repairable(flow, counts), "misread-forms")
    bad = misread_places(joined_units(flow), corpus(lines, zones), counts, cand).where("best is not null")
    bad = bad.select("rec_id", F.lit(None).cast("boolean").alias("broken"), F.concat_ws(_SLOT, "prev", "word", "next").alias("at"), "best")
    fixes = F.collect_set(F.when(F.col("best").isNotNull(), F.struct("at", "best")))
    edits = broken.unionByName(bad).groupBy("rec_id").agg(F.max("broken").alias("broken"), fixes.alias("f"))
    edits = staged(edits.select("rec_id", "broken", F.when(F.size("f") > 0, F.map_from_entries("f")).alias("fixes")), "edits")
    return _line_paragraphs(_edited(flow.where("zone_id is null"), edits), ls).unionByName(_zone_paragraphs(_edited(flow.where("zone_id is not null"), edits)))


def _edited(flow: DataFrame, edits: DataFrame) -> DataFrame:
    x = repaired_units(flow.join(edits, "rec_id", "left").withColumn("broken", F.coalesce("broken", F.lit(False))))
    return x.select("rec_id", "next_id", "doc_id", "zone_id", "kind", "text", "place", "broken", "moved", "head", "body")


def _flowing(y, gone) -> F.Column:
    """The text of a repaired unit as it stands in a paragraph: ``gone`` if its head stands in the unit before."""
    text = F.concat(F.when(gone, F.lit("")).otherwise(F.coalesce(y("head"), F.lit(""))), y("body"))
    return F.when(y("broken"), F.regexp_replace(text, rf"[{MARKS}]\s*$", "")).when(y("text").rlike(rf"\p{{L}}[-‐]\s*$"), F.rtrim(text)).otherwise(F.concat(F.rtrim(text), F.lit(" ")))


def _zone_paragraphs(x: DataFrame) -> DataFrame:
    """One paragraph for each zone that has text."""
    x = x.groupBy("zone_id").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "text", "broken", "moved", "head", "body"))).alias("l"))
    pieces = F.transform("l", lambda y, i: _flowing(lambda c: y[c], F.coalesce(F.get("l", i - 1)["moved"], F.lit(False))))
    x = x.withColumn("text", F.trim(F.array_join(pieces, ""))).where("text <> ''")
    return x.select("doc_id", "zone_id", F.lit(1).cast("bigint").alias("paragraph"), F.lit("text").alias("kind"), "text")


def _line_paragraphs(x: DataFrame, kinds: DataFrame) -> DataFrame:
    """The paragraphs of repaired lines, and of the notices on their pages. One shuffle by document serves all windows."""
    notices = kinds.where("scanned and kind = 'notice'").select("doc_id", "kind", "text", _place("page", "block_no", "line_no", "line_id"), F.col("text").alias("body"))
    x = x.unionByName(notices, allowMissingColumns=True).repartition("doc_id").withColumn("notice", F.col("kind") == "notice")
    run = Window.partitionBy("doc_id", "notice", "kind").orderBy("place")
    gone = F.coalesce(F.lag("moved").over(run) & (F.lag("next_id").over(run) == F.col("rec_id")), F.lit(False))
    x = x.withColumn("_gone", gone).withColumn("_text", _flowing(F.col, F.col("_gone")))
    order = Window.partitionBy("doc_id", "notice").orderBy("place")
    before = F.lag("text").over(order)
    here = F.struct("place.page", "place.block_no", "kind")
    block = F.lag(here).over(order)
    opens = before.isNull() | (block["kind"] != F.col("kind")) | ((block != here) & (F.col("notice") | before.rlike(FINISHED)))
    x = x.withColumn("_open", opens.cast("int")).withColumn("_part", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = x.groupBy("doc_id", "notice", "_part").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("place", F.col("_text").alias("text")))).alias("l"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("l")[0]["place"]))
    text = F.trim(F.array_join(F.transform("l", lambda y: y.text), ""))
    return part.select("doc_id", F.lit(None).cast("string").alias("zone_id"), number.cast("bigint").alias("paragraph"), "kind", text.alias("text"))
