"""Two-sided structure differences and references on small planted tables."""

from datetime import datetime

from quirelight.operators import references as R
from quirelight.operators import structure as S

BLOCK = "doc_id bigint, id string, kind string, text string, level int, parent string, pos int, x0 double, y0 double"


def side(spark, *rows):
    return spark.createDataFrame([(1, *r, *[0.0] * (8 - len(r))) for r in rows], BLOCK)


def got(df):
    return {(r.id, r.change, r.before, r.after) for r in df.collect()}


ROWS = [("t1", "title", "One", 1, None, 1), ("t2", "title", "Two", 1, None, 2), ("l", "list", "", 1, None, 3), ("i1", "list-item", "a", 2, "l", 4), ("i2", "list-item", "b", 2, "l", 5), ("f", "fn", "1 note", 2, None, 6), ("r", "ref", "2. Adams, B. (1970). Old. Town: House.", 2, None, 7)]


def test_equal_sides_have_no_differences(spark):
    a = side(spark, *ROWS)
    assert S.structure_diff(a, a).count() == 0 and S.layout_diff(a, a).count() == 0
    assert S.structure_diff(a, a.union(a)).count() == 0 and S.structure_diff(a.limit(0), a.limit(0)).count() == 0


def test_each_kind_of_difference(spark):
    a = side(spark, *ROWS)
    b = side(spark, ("t1", "title", "One", 2, None, 5), ("t2", "title", "Twe", 1, None, 2), ("l", "list", None, 1, None, 3), ("i1", "list-item", "a", 2, "x", 4), ("i3", "list-item", "c", 2, "l", 5), ("i2", "list-item", "b", 2, None, 6), ("f", "fn", "2 note", 2, None, 6), ("r", "ref", "2. Bell, B. (1971). Old. Town: House.", 2, None, 7, 9.0, 1.0))
    assert got(S.heading_diff(a, b)) == {("t1", "WRONG_HEADING_LEVEL", "1", "2"), ("t2", "HEADING_TEXT_CHANGED", "Two", "Twe"), ("t1", "HEADING_REORDERED", None, "t2"), ("t2", "HEADING_REORDERED", "t1", None)}
    assert got(S.list_diff(a, b)) == {("i3", "ADDED_LIST_ITEM", None, "c"), ("l", "LIST_STRUCTURE_CHANGED", "2", "1")}
    assert ("f", "FOOTNOTE_MARKER_CHANGED", "1", "2") in got(S.footnote_diff(a, b))
    assert {("r", "REFERENCE_YEAR_CHANGED", "1970", "1971"), ("r", "REFERENCE_AUTHOR_CHANGED", "Adams", "Bell")} <= got(S.reference_diff(a, b))
    assert got(S.parent_changes(a, b)) == {("i1", "PARENT_CHANGED", "l", "x"), ("i2", "PARENT_CHANGED", "l", None), ("t1", "DEPTH_CHANGED", "1", "2")}
    assert {(r.id, r.dx, r.dy) for r in S.layout_diff(a, b).collect()} == {("r", 9.0, 1.0)}
    assert got(S.heading_diff(a, b.limit(0))) == {("t1", "MISSING_HEADING", "One", None), ("t2", "MISSING_HEADING", "Two", None)}


def test_references(make):
    t = datetime(2024, 1, 1)
    texts = {"a": "3. Adams, B. and Cole, D. (1970). The old press. Town: House Press.", "b": "No shape at all", "c": "", "d": None, "e": "[4] Bell, E. (2001). Maps. 10.1000/x1"}
    z = make("zones", [{"zone_id": k, "tag": "ref", "text": v, "saved_at": t} for k, v in texts.items()] * 2)
    rows = {r.zone_id: r for r in R.parse_citation(z).collect()}
    assert set(rows) == {"a", "b", "e"}
    assert rows["a"][1:8] == ("3", "Adams, B. and Cole, D.", "1970", "The old press", "Town", "House Press", None)
    assert rows["b"].people is None and rows["b"].title == "No shape at all" and rows["e"].doi == "10.1000/x1"
    assert {(r.zone_id, r.pos, r.surname, r.given) for r in R.names(z).collect()} == {("a", 0, "Adams", "B."), ("a", 1, "Cole", "D."), ("e", 0, "Bell", "E.")}
    assert all(r.kept for r in R.citation_keeps_words(z).collect())


def test_look_alike_tokens(make):
    p = make("pdf_tokens", [{"token_id": i, "text": t} for i, t in enumerate(["сat", "cat", "dog", None, "рор"])])
    x = make("xhtml_tokens", [{"token_id": 10 + i, "pdf_token_id": i, "text": t} for i, t in enumerate(["cat", "cat", "dig", "a", "pop"])])
    assert {(r.token_id, r.places) for r in R.confusable_tokens(p, x).collect()} == {(0, 1), (4, 3)}
