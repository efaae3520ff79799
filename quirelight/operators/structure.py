"""Typed differences between two versions of the structure of documents.

Both sides are tables of blocks (doc_id, id, kind, text, level, parent, pos), and the
aligned pairs are given by the ids that both sides share; ``versions`` makes the sides
of a zone table: each zone as it was saved first and as it is now. ``aligned`` pairs blocks of
sides without common ids by their text.

A change is (doc_id, id, change, before, after). Blocks of one side come out as
``MISSING_...`` and ``ADDED_...``; the kinds have their own changes beside the text's.
*Reordered* blocks are those whose predecessor among the blocks that both sides have is another one.

Joins are equi joins on the block's key, counts are aggregated before they are
joined, and the order of a document is one window over the blocks of one kind.

Defined cases: null texts equal null and empty texts; a block repeated on a side counts once
(its smallest row); empty sides give only missing or only added blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions import text as T

NAMES = {"title": "HEADING", "list": "LIST", "list-item": "LIST_ITEM", "fn": "FOOTNOTE", "ref": "REFERENCE"}
BLOCK = ("doc_id", "id", "kind", "text", "level", "parent", "pos")


def versions(zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, current) states of the zones as blocks; a tie of ``saved_at`` takes the smaller or the larger row."""
    at = F.coalesce(F.col("saved_at").cast("timestamp"), F.lit(0).cast("timestamp"))
    row = F.struct("doc_id", F.col("tag").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "level", F.expr("nullif(lower(trim(parent_id)), '')").alias("parent"), F.coalesce("serial", F.lit(2147483647)).alias("pos"), "x0", "y0")
    both = zones.where("zone_id is not null").groupBy("zone_id").agg(F.min(F.struct(at.alias("at"), row.alias("r"))).alias("a"), F.max(F.struct(at.alias("at"), row.alias("r"))).alias("b"))
    side = lambda s: both.select(F.col("zone_id").alias("id"), f"{s}.r.*")
    return side("a"), side("b")


def _once(side: DataFrame, kind: str) -> DataFrame:
    rest = [c for c in BLOCK if c not in ("doc_id", "id")]
    return side.where(F.col("kind") == kind).groupBy("doc_id", "id").agg(F.min(F.struct(*[F.coalesce("text", F.lit("")).alias("text") if c == "text" else F.col(c) for c in rest])).alias("r"))


def _pairs(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    return _once(left, kind).withColumnRenamed("r", "a").join(_once(right, kind).withColumnRenamed("r", "b"), ["doc_id", "id"], "full_outer")


def _change(name: str, when: Column, before, after) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("change"), before.cast("string").alias("before"), after.cast("string").alias("after")))


def block_changes(left: DataFrame, right: DataFrame, kind: str, *own) -> DataFrame:
    """Missing, added, changed and reordered blocks of a kind, and the changes that ``own`` finds: functions of the pair's columns a and b."""
    name = NAMES.get(kind, kind.upper().replace("-", "_"))
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    found = [
        _change(f"MISSING_{name}", b.isNull(), a["text"], F.lit(None)),
        _change(f"ADDED_{name}", a.isNull(), F.lit(None), b["text"]),
        _change(f"{name}_TEXT_CHANGED", both & (a["text"] != b["text"]), a["text"], b["text"]),
        *[f(both, a, b) for f in own],
    ]
    x = _pairs(left, right, kind)
    rows = x.select("doc_id", "id", F.explode(F.filter(F.array(*found), lambda c: c.isNotNull())).alias("c")).select("doc_id", "id", "c.*")
    kept = x.where(both)
    order = lambda s: F.lag("id").over(Window.partitionBy("doc_id").orderBy(f"{s}.pos", "id"))
    moved = kept.select("doc_id", "id", order("a").alias("before"), order("b").alias("after")).where("not (before <=> after)").withColumn("change", F.lit(f"{name}_REORDERED"))
    return rows.unionByName(moved.select(rows.columns))


def heading_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    level = lambda both, a, b: _change("WRONG_HEADING_LEVEL", both & ~a["level"].eqNullSafe(b["level"]), a["level"], b["level"])
    return block_changes(left, right, "title", level)


def list_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lists and their items; a list whose number of items changed has another structure."""
    key = F.expr("lower(trim(id))").alias("parent")
    count = lambda s, n: s.where("kind = 'list-item' and parent is not null").select("id", "parent").distinct().groupBy("parent").agg(F.count("*").alias(n))
    lists = _pairs(left, right, "list").where("a is not null and b is not null").select("doc_id", "id", key)
    n = lists.join(count(left, "n"), "parent", "left").join(count(right, "m"), "parent", "left").na.fill(0, ["n", "m"]).where("n <> m")
    sizes = n.select("doc_id", "id", F.lit("LIST_STRUCTURE_CHANGED").alias("change"), F.col("n").cast("string").alias("before"), F.col("m").cast("string").alias("after"))
    return block_changes(left, right, "list").unionByName(block_changes(left, right, "list-item")).unionByName(sizes)


def footnote_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    mark = lambda x: F.regexp_extract(x["text"], r"^\s*\[?([0-9]{1,9}|[*†‡§]+)", 1)
    return block_changes(left, right, "fn", lambda both, a, b: _change("FOOTNOTE_MARKER_CHANGED", both & (mark(a) != mark(b)), mark(a), mark(b)))


def reference_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """References; also a changed year and a changed first author (what stands before the first comma, the number left out)."""
    year = lambda x: F.regexp_extract(x["text"], T.YEAR, 1)
    author = lambda x: F.trim(F.substring_index(F.regexp_replace(x["text"], r"^\s*[0-9]+[.)]\s*", ""), ",", 1))
    return block_changes(
        left, right, "ref",
        lambda both, a, b: _change("REFERENCE_YEAR_CHANGED", both & (year(a) != year(b)), year(a), year(b)),
        lambda both, a, b: _change("REFERENCE_AUTHOR_CHANGED", both & (author(a) != author(b)), author(a), author(b)),
    )


def parent_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of any kind that hang from another parent or stand at another level: changes of the hierarchy."""
    a = left.groupBy("doc_id", "id").agg(F.min(F.struct("parent", "level")).alias("a"))
    b = right.groupBy("doc_id", "id").agg(F.min(F.struct("parent", "level")).alias("b"))
    x = a.join(b, ["doc_id", "id"])
    found = [
        _change("PARENT_CHANGED", ~F.col("a.parent").eqNullSafe(F.col("b.parent")), F.col("a.parent"), F.col("b.parent")),
        _change("DEPTH_CHANGED", ~F.col("a.level").eqNullSafe(F.col("b.level")), F.col("a.level"), F.col("b.level")),
    ]
    return x.select("doc_id", "id", F.explode(F.filter(F.array(*found), lambda c: c.isNotNull())).alias("c")).select("doc_id", "id", "c.*")


def structure_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """All changes of structure, with the ``part`` that found them."""
    parts = {"heading": heading_diff, "list": list_diff, "footnote": footnote_diff, "reference": reference_diff, "hierarchy": parent_changes}
    out = None
    for name, f in parts.items():
        rows = f(left, right).withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def layout_diff(left: DataFrame, right: DataFrame, least: float = 3.0) -> DataFrame:
    """(doc_id, id, dx, dy): blocks that both sides have and whose upper left corner moved by more than ``least`` points.

    Sides have x0 and y0 beside the columns of blocks; null places don't move.
    """
    side = lambda s, n: s.groupBy("doc_id", "id").agg(F.min(F.struct("x0", "y0")).alias(n))
    x = side(left, "a").join(side(right, "b"), ["doc_id", "id"])
    x = x.select("doc_id", "id", (F.col("b.x0") - F.col("a.x0")).alias("dx"), (F.col("b.y0") - F.col("a.y0")).alias("dy"))
    return x.where((F.abs("dx") > least) | (F.abs("dy") > least))
