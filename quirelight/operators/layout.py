"""Layout steps whose next choice depends on the last one: grouped Python over one page or document.

Everything that windows can say is in ``operators.relational``; these keep running
means, open lists or earlier choices. A group is a page (or a document's blocks).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.operators.hierarchy import current_zones

# Markers that open a list item.
MARKERS = (("number", re.compile(r"\s*\d+[.)]\s")), ("roman", re.compile(r"\s*[ivxlc]+[.)]\s")), ("letter", re.compile(r"\s*[A-Za-z][.)]\s")), ("bullet", re.compile(r"\s*[•*●■▪◆♦‣⁃–—-]\s")))
INDENT, NESTED, GAP, ITEMS = 4.0, 12.0, 2.2, 2


def _pages(df: DataFrame, f, schema: str) -> DataFrame:
    return df.groupBy("doc_id", "page").applyInPandas(f, schema)


def physical_lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """words (doc_id, page, word_no, x0, y0, x1, y1) -> (word_no, line): by y centre against the line's running mean."""

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.assign(cy=(d["y0"] + d["y1"]) / 2).sort_values(["cy", "x0", "word_no"], kind="stable")
        out, mean, n, line = [], 0.0, 0, -1
        for no, cy in zip(d["word_no"], d["cy"]):
            if n and abs(cy - mean) <= tolerance:
                n += 1
                mean += (cy - mean) / n
            else:
                line, mean, n = line + 1, cy, 1
            out.append((key[0], key[1], no, line))
        return pd.DataFrame(out, columns=["doc_id", "page", "word_no", "line"])

    return _pages(words, one, "doc_id bigint, page int, word_no bigint, line int")


def _marker(text: str | None) -> str | None:
    return next((k for k, p in MARKERS if p.match(text or "")), None)


def list_runs(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_id, x0, y0, y1, text) -> (line_id, run, kind, depth): items of lists of two or more.

    An item belongs to the run whose marker kind and indent it has; a deeper marker
    opens a nested run, an unmarked deeper line goes on with its item, a wide gap or
    a line back at the margin ends everything open.
    """

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["y0", "x0", "line_id"], kind="stable")
        height = (d["y1"] - d["y0"]).median() or 10.0
        open_: list[dict] = []
        done: list[dict] = []
        bottom = None
        for r in d.itertuples():
            kind = _marker(r.text)
            if bottom is not None and r.y0 - bottom > GAP * height:
                done, open_ = done + open_, []
            bottom = r.y1
            if kind is None:
                while open_ and r.x0 <= open_[-1]["x"] + INDENT:
                    done.append(open_.pop())
                continue
            while open_ and r.x0 < open_[-1]["x"] - INDENT:
                done.append(open_.pop())
            top = open_[-1] if open_ else None
            if top and abs(r.x0 - top["x"]) <= INDENT and top["kind"] == kind:
                top["items"].append(r.line_id)
                continue
            if top and abs(r.x0 - top["x"]) <= NESTED:
                done.append(open_.pop())
            open_.append({"kind": kind, "x": r.x0, "items": [r.line_id], "depth": len(open_) + 1})
        rows = [(key[0], key[1], i, k, run["kind"], run["depth"]) for k, run in enumerate(done + open_) if len(run["items"]) >= ITEMS for i in run["items"]]
        return pd.DataFrame(rows, columns=["doc_id", "page", "line_id", "run", "kind", "depth"])

    return _pages(lines, one, "doc_id bigint, page int, line_id bigint, run int, kind string, depth int")


def pdf_columns(blocks: DataFrame, share: float = 0.15, most: int = 4) -> DataFrame:
    """blocks (doc_id, page, block_no, x0, x1) -> (block_no, column_no, columns): bands opened by left edges far from the last band's start."""

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        width, bands = d["x1"].max(), []
        for x in sorted(d["x0"]):
            if not bands or x - bands[-1] > share * width:
                bands.append(x)
        bands = bands[:most]
        at = [max(k for k, b in enumerate(bands) if x >= b) for x in d["x0"]]
        return pd.DataFrame({"doc_id": key[0], "page": key[1], "block_no": d["block_no"], "column_no": at, "columns": len(bands)})

    return _pages(blocks, one, "doc_id bigint, page int, block_no int, column_no int, columns int")


def index_entries(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_id, x0, y0, y1, text) -> (line_id, entry): lines of one index entry.

    A line of page numbers alone always goes on; a deeper line does while the entry
    has no page number yet; a gap of 1.8 heights always ends the entry.
    """
    number, only = re.compile(r"\d\s*$|[,.]\s*(see|see also)\b", re.I), re.compile(r"\s*\d+([-–—, ]+\d+)*\s*$")

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["y0", "x0", "line_id"], kind="stable")
        out, entry, text, x, bottom, height = [], -1, "", 0.0, None, 0.0
        for r in d.itertuples():
            t = r.text or ""
            far = bottom is not None and r.y0 - bottom > 1.8 * height
            goes_on = entry >= 0 and not far and (bool(only.match(t)) or r.x0 > x + INDENT and not number.search(text))
            if goes_on:
                text += " " + t
            else:
                entry, text, x = entry + 1, t, r.x0
            bottom, height = r.y1, max(r.y1 - r.y0, 0.0)
            out.append((key[0], key[1], r.line_id, entry))
        return pd.DataFrame(out, columns=["doc_id", "page", "line_id", "entry"])

    return _pages(lines, one, "doc_id bigint, page int, line_id bigint, entry int")


def decide_tags(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, block_no, kind, n_lines) -> (block_no, tag, score): greedy, each choice seeing the last.

    A block's own evidence weighs 0.7 and whether its tag may follow the chosen one
    0.3; ties take the first in alphabetical order.
    """
    # Tags of a block kind, and tags that may follow one another.
    tags = {"text": {"p": 0.9, "title": 0.3}, "running": {"runhead": 0.8, "p": 0.4}, "page_number": {"folio": 0.9, "p": 0.2}, "footnote": {"fn": 0.8, "p": 0.4}, "list_item": {"list-item": 0.8, "p": 0.4}, "verse_line": {"verse": 0.7, "p": 0.4}}
    follows = {("fn", "p"): 0.0, ("folio", "p"): 0.2}

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for r in d.sort_values("block_no", kind="stable").itertuples():
            scores = {t: 0.7 * s + 0.3 * (1.0 if last is None else follows.get((last, t), 0.8)) for t, s in tags.get(r.kind, {"p": 0.5}).items()}
            last = min(scores, key=lambda t: (-scores[t], t))
            out.append((key[0], key[1], r.block_no, last, scores[last]))
        return pd.DataFrame(out, columns=["doc_id", "page", "block_no", "tag", "score"])

    return _pages(blocks, one, "doc_id bigint, page int, block_no int, tag string, score double")


def figure_match(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """left, right (doc_id, fig_no, hash, caption, width, height) -> (fig_no, match, score): each target used once.

    Score: perceptual hash 3, caption 2, aspect ratio 1, of six.
    """
    import difflib

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, out = {r.fig_no: r for r in b.itertuples()}, []
        for r in a.sort_values("fig_no").itertuples():
            def score(t):
                h = 1 - bin((int(r.hash) ^ int(t.hash)) & (1 << 64) - 1).count("1") / 64
                c = difflib.SequenceMatcher(None, r.caption or "", t.caption or "", autojunk=False).ratio()
                return (3 * h + 2 * c + (abs(r.width / r.height - t.width / t.height) <= 0.05)) / 6

            best = max(free.values(), key=lambda t: (score(t), -t.fig_no), default=None)
            if best is not None and score(best) >= least:
                out.append((key[0], r.fig_no, best.fig_no, score(best)))
                del free[best.fig_no]
            else:
                out.append((key[0], r.fig_no, None, None))
        return pd.DataFrame(out, columns=["doc_id", "fig_no", "match", "score"]).astype({"match": "Int32"})

    return left.groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInPandas(one, "doc_id bigint, fig_no int, match int, score double")


def index_hierarchy(zones: DataFrame) -> DataFrame:
    """(zone_id, parent): for each current zone with a level, the nearest zone before it in its document with a smaller level.

    Zones come sorted within their document; a task holds one stack, of the levels open at the zone.
    """
    cur = current_zones(zones, "doc_id", "page", "serial", "created_order", "level").where("zone_id is not null and level is not null")
    cur = cur.select("doc_id", "page", F.coalesce("serial", F.lit(2147483647)).alias("serial"), "created_order", "zone_id", "level")
    ordered = cur.repartition("doc_id").sortWithinPartitions("doc_id", "page", "serial", "created_order", "zone_id").select("doc_id", "zone_id", "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, here = [], None
        for batch in batches:
            ids, parents = batch.column(1), []
            for doc, zone, level in zip(*(c.to_pylist() for c in batch.columns)):
                if doc != here:
                    stack, here = [], doc
                while stack and stack[-1][0] >= level:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                stack.append((level, zone))
            yield pa.RecordBatch.from_arrays([ids, pa.array(parents, pa.string())], names=["zone_id", "parent"])

    return ordered.mapInArrow(run, "zone_id string, parent string")
