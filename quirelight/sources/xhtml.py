"""XHTML and EPUB: archives to pages in spine order, pages to blocks, style sheets to rules.

Files come from Spark's ``binaryFile`` source, one row a file, and are taken apart in
Arrow batches with the standard library; a file that can't be read gives no rows.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "page_no int, block_no int, kind string, level int, list_depth int, text string, links array<string>, ids array<string>"
# Elements of blocks, and elements whose text doesn't count.
_BLOCK = {"p": "paragraph", "li": "list_item", "td": "cell", "th": "cell", "figcaption": "caption", "caption": "caption", "blockquote": "quote", "aside": "footnote", "pre": "paragraph", **{f"h{k}": "heading" for k in range(1, 7)}}
_SKIP = {"script", "style", "head", "title", "nav", "template"}


class _Blocks(HTMLParser):
    """Blocks in document order; unclosed and crossing elements end with their block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.now: dict | None = None
        self.lists = self.skip = 0

    def _close(self):
        if self.now:
            self.now["text"] = " ".join("".join(self.now["text"]).split())
            if self.now["text"]:
                self.rows.append(self.now)
        self.now = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag in ("ul", "ol"):
            self._close()
            self.lists += 1
        elif tag in _BLOCK:
            self._close()
            kind = _BLOCK[tag]
            if "footnote" in (a.get("epub:type") or a.get("role") or ""):
                kind = "footnote"
            self.now = {"kind": kind, "level": int(tag[1]) if kind == "heading" and tag[1:].isdigit() else None, "list_depth": self.lists if kind == "list_item" else 0, "text": [], "links": [], "ids": []}
        if self.now is not None:
            if a.get("id"):
                self.now["ids"].append(a["id"])
            if tag == "a" and a.get("href"):
                self.now["links"].append(a["href"])
            if tag == "br":
                self.now["text"].append(" ")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            self._close()
            self.lists = max(0, self.lists - 1)
        elif tag in _BLOCK:
            self._close()

    def handle_data(self, data):
        if self.skip:
            return
        if self.now is None and data.strip():
            self.now = {"kind": "paragraph", "level": None, "list_depth": 0, "text": [], "links": [], "ids": []}
        if self.now is not None:
            self.now["text"].append(data)


def blocks_of(html: str | None) -> list[dict]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p._close()
    return p.rows


def parse_xhtml_blocks(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, html) -> doc_id and BLOCKS."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = [(r.doc_id, r.page_no, k, b["kind"], b["level"], b["list_depth"], b["text"], b["links"], b["ids"]) for r in d.itertuples() for k, b in enumerate(blocks_of(r.html))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "block_no", "kind", "level", "list_depth", "text", "links", "ids"]).astype({"level": "Int32"})

    return pages.select("doc_id", "page_no", "html").mapInPandas(run, f"doc_id bigint, {BLOCKS}")


def spine(data: bytes) -> list[tuple[str, str]]:
    """(name, text) of an EPUB's content documents in reading order; of a bare archive by name."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    order = sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
    if "META-INF/container.xml" in names:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next((e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile")), None)
        if opf in names:
            pack = ElementTree.fromstring(z.read(opf))
            files = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(opf), e.get("href", ""))) for e in pack.iter() if e.tag.endswith("}item") or e.tag == "item"}
            listed = [files.get(e.get("idref")) for e in pack.iter() if e.tag.endswith("itemref")]
            order = [n for n in listed if n in names] or order
    return [(n, z.read(n).decode("utf-8", "replace")) for n in order]


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, name, html) of all EPUB files under ``path``, one row a content document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for r in d.itertuples():
                try:
                    rows += [(r.path, k, n, t) for k, (n, t) in enumerate(spine(r.content), 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "name", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page_no int, name string, html string")


# Properties of a style sheet, the values that set a flag, and what a property says of others.
WEIGHTS = ("bold", "bolder", "black", "heavy", "semibold", "demibold")
SLANTS = ("italic", "oblique")


def css_rules(sheets: DataFrame) -> DataFrame:
    """sheets (sheet, css) -> (sheet, selector, flags map<string,boolean>): one row for each simple selector.

    A sheet is cut at its braces and semicolons; of several blocks of one selector the
    last holds. Simple selectors are an element, a class, an id, or an element with
    either; others and blocks without a known property are left out. Null sheets give none.
    """
    plain = F.regexp_replace("css", r"(?s)/\*.*?\*/", " ")
    x = sheets.select("sheet", F.posexplode(F.split(F.lower(plain), "[}]")).alias("at", "block"))
    x = x.select("sheet", "at", F.substring_index("block", "{", 1).alias("names"), F.split(F.element_at(F.split("block", "[{]"), -1), ";").alias("items")).where(F.size("items") > 0)
    pair = F.transform("items", lambda i: F.struct(F.trim(F.substring_index(i, ":", 1)).alias("k"), F.trim(F.element_at(F.split(i, ":", 2), -1)).alias("v")))

    def flag(name: str, prop: str, value) -> Column:
        own = F.filter("pair", lambda p: p.k == prop)
        return F.when(F.size(own) > 0, F.map_from_arrays(F.array(F.lit(name)), F.array(value(F.element_at(own, -1).v))))

    number = lambda v: F.coalesce(v.try_cast("int") >= 600, F.lit(False))
    raised = lambda v: v.contains("super")
    flags = [
        flag("bold", "font-weight", lambda v: v.isin(*WEIGHTS) | number(v)),
        flag("italic", "font-style", lambda v: v.isin(*SLANTS)),
        flag("underline", "text-decoration", lambda v: v.contains("underline")),
    ]
    moved = F.filter("pair", lambda p: (p.k == "vertical-align") & (p.v.contains("super") | p.v.contains("sub")))
    at = F.element_at(moved, -1).v
    flags.append(F.when(F.size(moved) > 0, F.create_map(F.lit("superscript"), raised(at), F.lit("subscript"), ~raised(at))))
    none = F.create_map().cast("map<string,boolean>")
    x = x.withColumn("pair", pair).select("sheet", "at", "names", F.map_concat(*[F.coalesce(f, none) for f in flags]).alias("flags")).where(F.size("flags") > 0)
    x = x.select("sheet", "at", "flags", F.explode(F.transform(F.split("names", ","), lambda s: F.trim(s))).alias("selector")).where(F.col("selector").rlike(r"^(?=.)[\w-]*(?:[.#][\w-]+)?$"))
    return x.groupBy("sheet", "selector").agg(F.max_by("flags", "at").alias("flags"))


def element_styles(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """elements (sheet, id, tag, class, ident) -> (sheet, id, flags): the flags of the element's name, then of its classes, then of its ident."""
    tag, none = F.lower("tag"), F.array().cast("array<string>")
    classes = F.filter(F.split(F.lower(F.trim(F.coalesce("class", F.lit("")))), r"\s+"), lambda c: c != "")
    ident = F.lower(F.trim(F.coalesce("ident", F.lit(""))))
    keys = F.concat(F.array(tag), F.flatten(F.transform(classes, lambda c: F.array(F.concat(F.lit("."), c), F.concat(tag, F.lit("."), c)))), F.when(ident != "", F.array(F.concat(F.lit("#"), ident), F.concat(tag, F.lit("#"), ident))).otherwise(none))
    x = elements.select("sheet", "id", F.posexplode(keys).alias("at", "selector")).join(rules, ["sheet", "selector"])
    x = x.select("sheet", "id", "at", F.explode("flags").alias("flag", "value")).groupBy("sheet", "id", "flag").agg(F.max_by("value", "at").alias("value"))
    return x.groupBy("sheet", "id").agg(F.map_from_entries(F.collect_list(F.struct("flag", "value"))).alias("flags"))
