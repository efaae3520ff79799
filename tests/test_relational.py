"""Relational operators on literal fixtures, and against DuckDB on small tables."""

import random

import duckdb
import pytest

from quirelight.operators import evidence as _evidence  # noqa: F401
from quirelight.operators import layout as L
from quirelight.operators import relational as R

BOX = ("x0", "y0", "x1", "y1")


def zone(i, box=(0, 0, 10, 10), **kw):
    return {"zone_id": i, "doc_id": 1, "page": 1, "tag": "p", "text": "t", "level": 0, "serial": 1, "created_order": 1, **dict(zip(BOX, map(float, box))), **kw}


@pytest.fixture(scope="module")
def zones(make):
    return make(
        "zones",
        [
            zone("z1"),
            zone("z2", (0, 0, 10, 9)),
            zone("z3", (50, 50, 60, 60), parent_id="z1", level=1),
            zone("z4", (0, 0, 0, 0), parent_id="gone"),
            zone("z5", (0, 0, 10, 10), tag="title", text=None, parent_id=" Z1 ", level=2),
            zone("z5", (0, 0, 10, 10), tag="title", text=None, parent_id=" Z1 ", level=2),
            zone("z6", (0, 0, 9, 9), doc_id=None, page=None),
        ],
    )


def test_joins(spark, zones):
    run = lambda n: {tuple(r) for r in R.run(spark, n, lambda _: zones).collect()}
    assert run("orphan_parents") == {("z4", "gone")}
    assert run("overlapping_zones") == {("z1", "z2")}
    assert ("z2", "z1") in run("smallest_container")
    assert ("z5", "WRONG_LEVEL") in run("validate_hierarchy") and ("z3", "OK") in run("validate_hierarchy")


@pytest.fixture(scope="module")
def tables(spark, make, zones):
    """Small tables with nulls and repeated rows, the same in DuckDB, and empty ones."""
    lines = make("line_features", [{"line_id": i, "doc_id": 1 + i % 2, "page": 1, "block_no": i // 3, "line_no": i, "x0": 10.0 * (i % 2), "y0": 12.0 * i, "x1": 90.0, "y1": 12.0 * i + 10, "text": t, "font_size": 9.0 + (i == 0) * 4, "bold": i == 0, "italic": False, "caps_ratio": 0.1, "source": "OCR"} for i, t in enumerate(["Title Here", "some text that goes on", "and ends.", None, "", "12", "l3", "x" * 5000, "well-", "known end"])])
    tokens = make("pdf_tokens", [{"token_id": i, "doc_id": 1, "page": 1, "paragraph": 0, "token_index": i, "text": t, "x0": 20.0 * i, "x1": 20.0 * i + 12, "y0": 1.0, "y1": 9.0, "token_kind": "word"} for i, t in enumerate(["a", "b", None, "b", "c"])])
    other = make("xhtml_tokens", [{"token_id": i, "doc_id": 1, "pdf_token_id": p, "text": t} for i, (p, t) in enumerate([(0, "a"), (1, "x"), (99, "y"), (None, "z")])])
    diffs = make("differences", [{"diff_id": 1, "doc_id": 1, "kind": "MISSING_WORD", "severity": "HIGH", "confidence": 0.95}, {"diff_id": 1, "doc_id": 1, "kind": "MISSING_WORD", "severity": "HIGH", "confidence": 0.95}, {"diff_id": 2, "doc_id": 2, "kind": "TEXT_CHANGED", "severity": None, "confidence": None}])
    blocks = spark.createDataFrame([(1, 1, 0, "text", "body", 0.0, 0.0, 90.0, 30.0, 0, 0, 1, 4, None), (1, 1, 1, "running", None, 0.0, 36.0, 90.0, 60.0, 0, 0, 2, 1, None), (1, 1, 1, "running", None, 0.0, 36.0, 90.0, 60.0, 0, 0, 2, 1, None)], "doc_id bigint, page int, block_no int, kind string, region string, x0 double, y0 double, x1 double, y1 double, column_no int, band int, block_order int, n_lines int, stored_text string")
    docs = make("documents", [{"doc_id": 1, "text": "some text", "n_chars": 9}, {"doc_id": 2, "text": None}])
    tables = {"zones": zones, "line_features": lines, "layout_blocks": blocks, "pdf_tokens": tokens, "xhtml_tokens": other, "differences": diffs, "documents": docs, "language_codes": make("language_codes")}
    con = duckdb.connect()
    for n, t in tables.items():
        con.register(n, t.toArrow())
    tables = {n: t.cache() for n, t in tables.items()}
    return tables, con, {n: spark.createDataFrame([], t.schema) for n, t in tables.items()}


@pytest.mark.parametrize("name", sorted(R.OPERATORS))
def test_same_as_sql(spark, tables, name):
    tables, con, empty = tables
    got = R.run(spark, name, tables.get)
    cols = sorted(got.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else list(map(str, v)) if isinstance(v, (list, tuple)) else v
    have = sorted((tuple(norm(v) for v in r) for r in got.select(*cols).collect()), key=repr)
    want = sorted((tuple(norm(v) for v in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({R.check_sql(name)})").fetchall()), key=repr)
    assert have == want
    R.run(spark, name, empty.get).collect()


def test_layout(spark):
    lines = spark.createDataFrame([(1, 1, i, x, 12.0 * i, 12.0 * i + 10, t) for i, (x, t) in enumerate([(0.0, "1. one"), (0.0, "2. two"), (20.0, "a) sub"), (20.0, "b) sub"), (0.0, "3. three"), (0.0, "plain"), (0.0, "1. alone")])], "doc_id bigint, page int, line_id bigint, x0 double, y0 double, y1 double, text string")
    got = {r.line_id: (r.kind, r.depth) for r in L.list_runs(lines).collect()}
    assert got == {0: ("number", 1), 1: ("number", 1), 4: ("number", 1), 2: ("letter", 2), 3: ("letter", 2)}
    words = spark.createDataFrame([(1, 1, i, 10.0 * i, y, 10.0 * i + 8, y + 8) for i, y in enumerate([0.0, 1.5, 3.0, 20.0])], "doc_id bigint, page int, word_no bigint, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in L.physical_lines(words).orderBy("word_no").collect()] == [0, 0, 1, 2]
    entries = spark.createDataFrame([(1, 1, i, x, 11.0 * i, 11.0 * i + 10, t) for i, (x, t) in enumerate([(0.0, "women lack"), (10.0, "strategy, 79"), (10.0, "careers, 12"), (0.0, "84, 90")])], "doc_id bigint, page int, line_id bigint, x0 double, y0 double, y1 double, text string")
    assert [r.entry for r in L.index_entries(entries).orderBy("line_id").collect()] == [0, 0, 1, 1]
    fig = "doc_id bigint, fig_no int, hash bigint, caption string, width double, height double"
    a = spark.createDataFrame([(1, 1, 255, "A map", 10.0, 5.0), (1, 2, -1, "Other", 5.0, 5.0)], fig)
    b = spark.createDataFrame([(1, 7, 254, "A map", 10.0, 5.0)], fig)
    assert {(r.fig_no, r.match) for r in L.figure_match(a, b).collect()} == {(1, 7), (2, None)}


def test_index_hierarchy_of_any_depth(spark, make, tmp_path):
    from quirelight.queries import queries

    rnd = random.Random(5)
    levels = {d: [0, 2, 1, 3, 70, 4, 69, 70, *(rnd.choice([0, 1, 2, 3, 5, 9, 70]) for _ in range(60))] for d in range(4)}
    made = [zone(f"{d}-{k}", doc_id=d, level=x, serial=k) for d, xs in levels.items() for k, x in enumerate(xs)]
    make("zones", [*made, made[5], zone("n", doc_id=1, level=None)]).write.parquet(f"{tmp_path}/zones.parquet")
    want = {(f"{d}-{k}", next((f"{d}-{j}" for j in reversed(range(k)) if xs[j] < xs[k]), None)) for d, xs in levels.items() for k in range(len(xs))}
    got = [tuple(r) for r in queries()["index_hierarchy"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
