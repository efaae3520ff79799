r"""Problem 1: one consistent form for text that looks the same.

The form is one SQL query, planned once for each task and run by DuckDB over the Arrow batches of the
partition (one thread per task): ``nfc_normalize`` composes accents,
``translate`` maps single characters (width variants, radicals, look-alike
letters), a map the ones that stand for several (ligatures, Roman
numerals), and regular expressions remove what shows nothing and make all blanks
one. The mappings come from the Unicode data of Python by rule, but for the
look-alike letters, which are listed below.

What stays different: letter case, accents, dash lengths, quote shapes, a gap
against no gap, raised, circled and fraction digits, replacement and control
characters (traces of wrong decoding).

Defined cases: null stays null; a text of invisible characters and blanks alone
becomes empty; texts are processed whole; a wrong code point list (a number above
10FFFF) counts only its valid parts.
"""

from __future__ import annotations

import unicodedata as U
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts with the shape of a Latin letter.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ԝ": "W", "Х": "X", "Ӏ": "I",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "Տ": "S", "Օ": "O", "Ս": "U",
    "ɡ": "g", "ɑ": "a",
    "‐": "-", "‑": "-",
}

#: Decompositions whose two sides look the same, by tag; "<compat>" only where both are letters or numerals.
SAME_TAGS = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Different shapes in spite of a "<compat>" decomposition.
OTHER_SHAPE = {"ſ": "ſ", "ẛ": "ẛ", "ﬅ": "ſt"}


def _compat(ch: str) -> str | None:
    """What ``ch`` looks like, if its compatibility form is made of other characters."""
    if ch in OTHER_SHAPE:
        return OTHER_SHAPE[ch]
    d = U.decomposition(ch)
    tag = d.split(" ")[0]
    to = U.normalize("NFKC", ch)
    letters = U.category(ch) in ("Ll", "Lu", "Lt", "Lo", "Nl") and all(U.category(c)[0] in "LM" for c in to)
    radical = U.category(ch) == "So" and len(to) == 1 and U.category(to) == "Lo"
    return to if tag in SAME_TAGS or tag == "<compat>" and (letters or radical) else None


@cache
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """(one to one, one to several) for all characters but surrogates, private use and the astral ideographs."""
    one, several = {}, {}
    for cp in (*range(0x80, 0xD800), *range(0xF900, 0x20000)):
        ch = chr(cp)
        if not U.category(ch)[0] in "LMNPS":
            continue
        to = _compat(ch) or ch
        to = U.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in U.normalize("NFD", to)))
        if to == U.normalize("NFC", ch):
            continue
        (one if len(to) == 1 else several)[ch] = to
    return one, several


@cache
def invisible() -> str:
    """A regular-expression class of what leaves nothing to see."""
    found = [cp for cp in range(0x110000) if U.category(chr(cp)) == "Cf"]
    found += [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    return "[" + "".join(f"\\x{{{cp:X}}}" for cp in sorted(set(found))) + "]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ASCII_BLANKS = "[\\t\\n\\f\\r ]+"
BLANKS = "[\\s\\pZ]+"


@cache
def setup_sql() -> tuple[str, ...]:
    """What a connection needs before ``form_query``: the mapping of one character to several, and the steps as macros."""
    one, several = mappings()
    pairs = ", ".join(f"{_q(k)}: {_q(v)}" for k, v in several.items())
    spelt = "array_to_string(list_transform(string_split(t, ''), lambda c: coalesce(getvariable('several')[c], c)), '')"
    return (
        f"SET VARIABLE several = MAP {{{pairs}}}",
        f"CREATE MACRO bare(t) AS nfc_normalize(regexp_replace(t, {_q(invisible())}, '', 'g'))",
        f"CREATE MACRO spelt(t) AS CASE WHEN regexp_matches(t, {_q('[' + ''.join(several) + ']')}) THEN {spelt} ELSE t END",
        f"CREATE MACRO mapped(t) AS nfc_normalize(translate(t, {_q(''.join(one))}, {_q(''.join(one.values()))}))",
        f"CREATE MACRO closed(t) AS trim(regexp_replace(t, '{BLANKS}', ' ', 'g'))",
    )


def form_query(keys: str, columns: dict[str, str], source: str) -> str:
    """A query of ``keys`` and the form of each column of ``source`` (name: expression), a step a level; ASCII texts skip the steps that leave them alone."""
    names = list(columns)
    sql = f"SELECT {keys}, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"
    for step in ("bare", "spelt", "mapped"):
        sql = f"SELECT {keys}, {', '.join(f'CASE WHEN strlen({n}) = length({n}) THEN {n} ELSE {step}({n}) END AS {n}' for n in names)} FROM ({sql})"
    return f"SELECT {keys}, {', '.join(f'closed({n}) AS {n}' for n in names)} FROM ({sql})"


def _decoded(column: str) -> str:
    """The text of a list of code points in any spelling."""
    hexes = f"list_transform(regexp_extract_all({column}, '(?i)U\\+([0-9A-F]+)', 1), lambda h: TRY_CAST('0x' || h AS BIGINT))"
    return f"array_to_string(list_transform(list_filter({hexes}, lambda n: n > 0 AND n < 1114112 AND NOT n BETWEEN 55296 AND 57343), lambda n: chr(CAST(n AS INTEGER))), '')"


def duck(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """``sql`` over the table ``part`` by DuckDB inside the Python worker: one plan for each task, the Arrow batches of the partition streamed through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(iter(batches), None)
        if first is None:
            return
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            for s in setup_sql():
                con.execute(s)
            con.register("part", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
            yield from con.sql(sql).to_arrow_reader(20_000)
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def _plain(*columns: str) -> F.Column:
    return F.concat(*columns).rlike(r"^[\x01-\x7f]*$")


def consistent(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, form): the consistent form of each row's text."""
    kind = df.schema[id_col].dataType.simpleString()
    return duck(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), form_query("id", {"form": "t"}, "part"), f"id {kind}, form string").withColumnRenamed("id", id_col)


def same_look(df: DataFrame, left: str, right: str, decode: bool = False) -> DataFrame:
    """Rows (rec_id) whose sides differ in code points and have the same form.

    An empty form matches nothing: a side of invisible characters shows no text. Pairs of
    which both sides are ASCII can differ in their blanks alone, which Spark decides.
    """
    a, b = (_decoded(left), _decoded(right)) if decode else (left, right)
    source = f"(SELECT rec_id, {a} AS a, {b} AS b FROM part WHERE {left} IS NOT NULL AND {right} IS NOT NULL) WHERE a <> b AND a <> '' AND b <> ''"
    sql = f"SELECT rec_id FROM ({form_query('rec_id', {'a': 'a', 'b': 'b'}, source)}) WHERE a = b AND a <> ''"
    rows = df.select("rec_id", left, right)
    if decode:
        return duck(rows, sql, "rec_id bigint")
    closed = lambda c: F.trim(F.regexp_replace(c, ASCII_BLANKS, " "))
    blanks = rows.where(_plain(left, right)).where((closed(left) == closed(right)) & (closed(left) != "")).select("rec_id")
    return duck(rows.where(~_plain(left, right)), sql, "rec_id bigint").unionByName(blanks)


def found(pdf_tokens: DataFrame, xhtml_tokens: DataFrame, differences: DataFrame) -> DataFrame:
    """(rec_kind, rec_id) of aligned token pairs and differences that only look the same.

    Pairs with equal text are left out by the join already, so DuckDB sees the rest.
    """
    x = xhtml_tokens.where("pdf_token_id is not null and text is not null").select(F.col("pdf_token_id").alias("rec_id"), F.col("text").alias("b")).distinct()
    p = pdf_tokens.where("text is not null").select(F.col("token_id").alias("rec_id"), F.col("text").alias("a")).distinct()
    tokens = same_look(p.join(x, "rec_id").where("a <> b"), "a", "b")
    d = differences.where("pdf_unicode <> '' and xhtml_unicode <> ''").select(F.col("diff_id").alias("rec_id"), "pdf_unicode", "xhtml_unicode").where("pdf_unicode <> xhtml_unicode")
    diffs = same_look(d, "pdf_unicode", "xhtml_unicode", decode=True)
    return tokens.select(F.lit("token").alias("rec_kind"), "rec_id").unionByName(diffs.select(F.lit("difference").alias("rec_kind"), "rec_id")).distinct()
