"""Facts about single functions, and round trips."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirelight.functions import markup as M
from quirelight.functions import text as T
from quirelight.functions import unicode as U
from quirelight.functions.dialect import SPARK
from quirelight.operators import align as A
from quirelight.sources import dtd, xhtml


def value(spark, f, text, *args):
    df = spark.createDataFrame([(text,)], "text string")
    return df.selectExpr(f"{f('text', SPARK, *args)} AS v").first().v


# Facts about the functions.
FACTS = [
    (T.words_multilingual, "第3章 東京の歴史", ["第", "3", "章", "東", "京", "の", "歴", "史"]),
    (T.tokenize_exact, "don’t – 5 %", ["don", "’", "t", "–", "5", "%"]),
    (T.token_kind, "½", "number"),
    (T.token_kind, "±", "symbol"),
    (T.token_kind, "a1", "word"),
    (T.ends_sentence, "He said “no.”", True),
    (T.ends_sentence, "He said", False),
    (T.starts_lowercase, "“and so", True),
    (T.starts_caseless, "東京", True),
    (T.dominant_script, "Глава one два", "Cyrillic"),
    (T.dominant_script, "12 %", ""),
    (T.heading_kind, "3. References", "references"),
    (T.heading_kind, "Список литературы", "references"),
    (T.heading_kind, "目次", "contents"),
    (T.heading_kind, "A story", None),
    (T.page_number_like, " 12. ", True),
    (T.page_number_like, "12b", False),
    (T.extract_year, "Smith, J. (1987).", "1987"),
    (T.author_start, "van der Berg, A. A study", True),
    (T.author_start, "a lower line", False),
    (T.year_start, "1984: A study", False),
    (T.year_start, "1989. Discussion", True),
    (T.reference_number, "[12] Rose J.", "[12]"),
    (T.isbn_value, "ISBN 978-1-4028-9462-6 (cloth)", "9781402894626"),
    (T.isbn_format, "ISBN 978-1-4028-9462-6 (cloth)", "print"),
    (T.keywords, "Key words: tree; book · press", ["tree", "book", "press"]),
    (T.copyright_year, "© 1999, 2004 Some House", "2004"),
    (T.id_prefix, "07_abc_ch12", "ch12"),
    (T.running_signature, "Chapter IV  12", "chapter # #"),
    (T.strip_tags, "a <i>b</i> &amp; c", "a b & c"),
    (T.of_for_have, "they could of gone", "could of"),
    (T.odd_quotes, "“a” and “b", True),
    (T.index_page_only, "12, 45–7", True),
    (T.index_cross_reference, "women, see also gender", True),
    (T.bibliography_heading, "References.", True),
    (T.missing_callouts, "It ended.3 Then<sup>4</sup> more.", ["3"]),
]


@pytest.mark.parametrize("f,text,want", FACTS)
def test_facts(spark, f, text, want):
    assert value(spark, f, text) == want


@pytest.mark.parametrize("f", [T.ends_sentence, T.page_number_like, T.collapse, T.dominant_script, T.tokenize_exact, T.heading_kind])
def test_null_empty_and_long(spark, f):
    df = spark.createDataFrame([(None,), ("",), ("word " * 200_000,)], "text string")
    assert df.selectExpr(f"{f('text', SPARK)} AS v").count() == 3
    df.selectExpr(f"{f('text', SPARK)} AS v").collect()


def test_forms():
    assert U.normal(" éa­b c ") == "éab c" and U.normal(None) is None
    assert U.semantic("Oﬃce STRASSE ß") == "office strasse ss"
    assert U.code_points("a😀") == "U+0061 U+1F600"


@given(st.text(alphabet="abc <>&é\n", max_size=40), st.lists(st.tuples(st.integers(-3, 45), st.integers(-3, 45), st.sampled_from(["i", "b", "sup"])), max_size=6))
def test_markup_round_trip(plain, ranges):
    want = M.normalized(ranges, len(plain))
    text, got, issues = M.parse(M.build(plain, want))
    assert text == plain and M.normalized(got, len(plain)) == want and not issues


@given(st.lists(st.tuples(st.integers(-2, 9), st.integers(-2, 9), st.sampled_from("ib")), max_size=6))
def test_ranges_cover_the_same_places(ranges):
    covered = lambda rs: {(k, s) for a, b, s in rs for k in range(max(a, 0), min(b, 8))}
    got = M.normalized(ranges, 8)
    assert covered(got) == covered(ranges) and all(a < b for a, b, _ in got) and not any(x[2] == y[2] and x[1] == y[0] for x in got for y in got)


def test_ranges_of_a_table(spark):
    rows = [(1, 8, -1, 3, "i"), (1, 8, 3, 5, "i"), (1, 8, 6, 99, "i"), (1, 8, 2, 2, "b"), (2, 8, 4, 6, "b"), (2, 8, 4, 6, "b"), (2, 8, None, 6, "b")]
    got = {tuple(r) for r in M.merged_ranges(spark.createDataFrame(rows, "id int, size int, start int, stop int, style string")).select("id", "style", "start", "stop").collect()}
    assert got >= {(1, "i", 0, 5), (1, "i", 6, 8)} and {r for r in got if r[0] == 1} == {(1, "i", 0, 5), (1, "i", 6, 8)}


def test_markup_broken():
    assert M.parse("a<i>b<b>c</i>d</b></u>")[2] == ["crossing i", "unmatched u"]
    assert M.parse(None) == ("", [], [])
    assert M.restyle("abcd", 1, 3, "b") == "a<b>bc</b>d" and M.restyle("<b>abcd</b>", 1, 3, "b", False) == "<b>a</b>bc<b>d</b>"
    assert [M.style_at("a<i>bc</i>", *r, "i") for r in ((0, 1), (1, 3), (0, 3))] == ["none", "all", "mixed"]


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_pairs_cover_both_sides(a, b):
    rows = list(A.pairs(a, b))
    assert sorted(i for _, i, _ in rows if i is not None) == list(range(len(a))) and sorted(j for _, _, j in rows if j is not None) == list(range(len(b)))
    assert all(a[i] == b[j] for op, i, j in rows if op == "equal")


def test_char_classes():
    assert A.char_class("ofﬁce", "offi ce"[:4] + "ce") in ("LIGATURE_CHANGED", "TEXT_CHANGED")
    assert A.char_class("ﬁnd", "find") == "LIGATURE_CHANGED" and A.char_class("сat", "cat") == "HOMOGLYPH_SUBSTITUTION"
    assert A.char_class("5±1", "5+1") == "SPECIAL_CHARACTER_CHANGED" and A.char_class("a–b", "a-b") == "UNICODE_CODEPOINT_CHANGED" and A.char_class("café", "cafe") == "UNICODE_CODEPOINT_CHANGED" and A.char_class("abc", "abxyz") == "TEXT_CHANGED"


def test_word_differences(spark):
    left = spark.createDataFrame([(1, i, w) for i, w in enumerate("the old news paper is here now".split())], "doc_id bigint, pos bigint, text string")
    right = spark.createDataFrame([(1, i, w) for i, w in enumerate("the old newspaper is hеre now too".split())], "doc_id bigint, pos bigint, text string")
    got = {(r.type, r.original, r.converted) for r in A.word_differences(A.align(left, right)).collect()}
    assert got == {("MERGED_WORD", "news paper", "newspaper"), ("CHANGED_WORD", "here", "hеre"), ("ADDED_WORD", None, "too")}
    assert A.align(left.limit(0), right.limit(0)).count() == 0


def test_xhtml():
    rows = xhtml.blocks_of("<html><head><title>t</title><script>x<p>y</script></head><body><h2 id='a'>One</h2><p>two <b>three<p>four <a href='#a'>l</a><ul><li>i<ul><li>j</ul></ul></body>")
    assert [(r["kind"], r["text"], r["list_depth"]) for r in rows] == [("heading", "One", 0), ("paragraph", "two three", 0), ("paragraph", "four l", 0), ("list_item", "i", 1), ("list_item", "j", 2)]
    assert rows[0]["ids"] == ["a"] and rows[2]["links"] == ["#a"] and xhtml.blocks_of(None) == []


def test_style_sheets(spark):
    css = "/* p {font-style: italic} */ p, .x {font-weight: 700} p > b {font-style: italic} p.x {font-weight: 400; text-decoration: underline} .x {font-weight: heavy; vertical-align: super} a:hover {font-weight: bold} i {color: red}"
    rules = xhtml.css_rules(spark.createDataFrame([(1, css), (2, None), (3, "")], "sheet int, css string"))
    assert {r.selector: r.flags for r in rules.collect()} == {"p": {"bold": True}, ".x": {"bold": True, "superscript": True, "subscript": False}, "p.x": {"bold": False, "underline": True}}
    e = spark.createDataFrame([(1, 1, "P", "x y", None), (1, 2, "p", "", "n"), (1, 3, "i", None, None)], "sheet int, id int, tag string, class string, ident string")
    assert {r.id: r.flags for r in xhtml.element_styles(e, rules).collect()} == {1: {"bold": False, "underline": True, "superscript": True, "subscript": False}, 2: {"bold": True}}


def test_dtd(spark):
    first, last, follow = dtd.Model("(title?, (p | list)+, fn*)").sets()
    assert first == {"title", "p", "list"} and last == {"p", "list", "fn"} and ("p", "list") in follow and ("fn", "p") not in follow
    t = dtd.rule_tables(spark, "<!ENTITY % i 'b | i'><!ELEMENT p (#PCDATA | %i;)*><!ATTLIST p id ID #REQUIRED lang CDATA #IMPLIED>")
    assert {tuple(r) for r in t["allowed_child"].collect()} >= {("p", "b"), ("p", "i")} and [tuple(r) for r in t["required_attr"].collect()] == [("p", "id")]
