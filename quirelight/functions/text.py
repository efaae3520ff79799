r"""Scalar text functions and predicates, each as a SQL expression over a column.

``f(c, d)`` takes the text of a column expression and a dialect and returns the
text of an expression; ``column(f, c)`` makes a Spark column of it. All of them stay
inside whole-stage code generation. Null texts give null (predicates: false).

Not here, since SQL has no form for them: composing and case folding
(``quirelight.functions.unicode``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions.dialect import SPARK, Spark

Expr = Callable[[str, Spark], str]


def column(f: Expr, c: str = "text", *args) -> Column:
    """A Spark column of an expression function."""
    return F.expr(f(c, SPARK, *args))


# Signs that end a sentence, and that close or open a quotation.
ENDS = ".!?。！？؟।॥…"
CLOSE = "\"'”’»)]}」』）】›"
OPEN = "\"'“‘«([{「『（【¿¡„‹"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SPACES = "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
NO_SPACE = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
_C, _O = "\"'”’»)\\]}」』）】›", "\"'“‘«(\\[{「『（【¿¡„‹"

# Formats of years, page ranges, links, page references, references' numbers, list markers and chapter codes.
YEAR = r"(1[5-9]\d{2}|20\d{2})"
_DASH = "[-–—]"
_PAGE = rf"\d+(?:\s*{_DASH}\s*\d+)?"
PAGE_REFS = rf"{_PAGE}(?:\s*,\s*{_PAGE})*"
PAGE_RANGE = rf"\b(?:S?\d+\s*{_DASH}\s*S?\d+)\b"
LINK = "(?i)" + "|".join(("https?://", r"www\.", r"doi\.org/", r"10\.\d{4,9}/"))
_NUMBERED, _LETTERED = r"\d+[.)]", r"[A-Za-z]{1,4}\d+[.)]"
REFERENCE_NUMBER = rf"^({_NUMBERED}|{_LETTERED}|\[\s*[A-Za-z]?\d+\s*\])\s*(.*)$"
REFERENCE_LABEL = r"^\s*(\[?\d+[a-z]?[.)\]]?)\s+"
_BULLETS = "•-*●■▪◆♦‣⁃–—"
LIST_MARKER = rf"^\s*(?:(?:\d+|[A-Za-z]|[ivxlc]+|[IVXLC]+)[.)]|[{_BULLETS.replace('-', '')}-])\s*"
COMPONENT = r"^\d+_[^_]+_(.+)$"
# Words of institutions and their acronyms, headings of bibliographies, words of book formats.
INSTITUTIONS = "Organization|Organisation|University|Institute|Association|Society|Foundation|Committee|Agency|Council|Union|Nations|Ministry|Department"
ACRONYMS = "WHO|UNESCO|UNICEF|NASA|NATO|UNDP|OECD|EU|UN"
BIBLIOGRAPHIES = ("bibliography", "references", "works cited", "references and notes", "reference list", "cited works", "literature cited")
ELECTRONIC, PRINTED = "e-?book|epub|electronic|pdf|online|ebk", "cloth|hard|paper|print|pbk|hbk"
# Plural subjects, singular verbs and modal verbs of the grammar rules.
SUBJECTS = "results|studies|findings|data|authors|researchers|scholars|critics|sources"
VERBS = "shows|proves|suggests|indicates|demonstrates|argues|claims|reveals|confirms"
MODALS = "would|could|should|might|must"
# Misread digits.
MISREAD_DIGITS = ("IliOo°SBGZ", "1110005862")


# ---- forms

def expand_ligatures(c, d):
    for a, b in LIGATURES.items():
        c = f"replace({c}, {d.q(a)}, {d.q(b)})"
    return c


def contains_ligature(c, d):
    return d.has(c, "[" + "".join(LIGATURES) + "]")


def collapse(c, d):
    """Spaces of any kind to one blank, soft hyphens out, ends trimmed (composing left to the caller)."""
    return f"trim({d.sub(d.translate(f'replace({c}, {d.q(chr(0xAD))}, {d.q("")})', SPACES, ' ' * len(SPACES)), '[ \\t\\n\\r\\f]+', ' ')})"


def sanitize_xml(c, d):
    return d.sub(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]")


def strip_tags(c, d):
    x = d.sub(c, "<[^>]+>")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, {d.q(a)}, {d.q(b)})"
    return x


def title_normalize(c, d):
    x = d.sub(c, "</?(?:bold|italic)>")
    x = d.sub(x, "[\xa0\u2000-\u200b\u202f\u205f\u3000\ufeff]", " ")
    return f"trim({d.sub(x, '[ \\t\\n\\r]+', ' ')})"


def strip_list_marker(c, d):
    return d.sub(c, LIST_MARKER)


def ocr_text_repair(c, d):
    x = f"replace({expand_ligatures(c, d)}, {d.q(chr(0xAD))}, {d.q('')})"
    return d.sub(x, r"(\s)±(\s)", "@1—@2")


def final_quotes(c, d):
    """Misread plus-minus signs to dashes, paired marks to quotes."""
    x = d.sub(c, r"([0-9])\s*±\s*([0-9])", "@1–@2")
    x = d.sub(x, r"([A-Za-z])\s±\s([A-Za-z])", "@1—@2")
    return f"replace(replace({x}, {d.q('``')}, {d.q('“')}), {d.q(chr(39) * 2)}, {d.q('”')})"


def running_signature(c, d):
    x = d.sub(f"lower({c})", "[0-9]+", "#")
    for _ in range(2):  # neighbours share the sign between them
        x = d.sub(x, r"(^|[^\p{L}\p{N}_])[ivxlcdm]+([^\p{L}\p{N}_]|$)", "@1#@2")
    return f"trim({d.sub(x, '[ \\t\\n]+', ' ')})"


def confusion_map(c, d):
    return d.translate(c, *MISREAD_DIGITS)


def id_prefix(c, d):
    return d.get(c, "([^_]*)$", 1)


def image_prefix(c, d):
    return d.sub(c, COMPONENT, "@1")


# ---- tokens

_TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\s\p{Z}\p{L}\p{N}\p{M}]"


def tokenize_exact(c, d):
    """Runs of letters, digits and marks; every other visible character alone."""
    return d.all(c, _TOKEN)


def token_kind(c, d):
    return f"""CASE WHEN {c} = '' OR {d.has(c, r'^[\p{L}\p{M}]+$')} THEN 'word' WHEN {d.has(c, r'^\p{N}+$')} THEN 'number'
        WHEN {d.has(c, r'\p{S}')} THEN 'symbol' WHEN {d.has(c, r'\p{P}')} THEN 'punctuation' ELSE 'word' END"""


def words_multilingual(c, d):
    """Words between blanks; each character of a script without spaces alone."""
    alone = "".join(d.script(s) for s in NO_SPACE)
    return d.all(c, rf"[{alone}]|[^\s\p{{Z}}{alone}]+")


def is_semantic_word(c, d):
    return d.has(c, r"[\p{L}\p{N}]")


def is_symbol_or_punct(c, d):
    return d.has(c, r"[\p{P}\p{S}]")


_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")


def dominant_script(c, d):
    """The script with most letters, the earlier in the list on a tie; empty without letters."""
    n = {s: d.count(f"coalesce({c}, '')", rf"[{d.script(s)}]") for s in _SCRIPTS}
    most = "greatest(" + ", ".join(n.values()) + ")"
    return f"CASE WHEN {most} = 0 THEN '' " + " ".join(f"WHEN {x} = {most} THEN '{s}'" for s, x in n.items()) + " END"


def is_rtl(c, d):
    return f"({dominant_script(c, d)}) IN ('Hebrew', 'Arabic')"


def mixed_script_word(c, d):
    """A word with letters of two of Latin, Greek and Cyrillic."""
    return "(" + " + ".join(f"CASE WHEN {d.has(c, f'[{d.script(s)}]')} THEN 1 ELSE 0 END" for s in ("Latin", "Greek", "Cyrillic")) + ") > 1"


def uppercase_ratio(c, d):
    return f"CASE WHEN {d.count(c, r'\p{L}')} = 0 THEN 0.0e0 ELSE {d.dbl(d.count(c, r'\p{Lu}'))} / {d.count(c, r'\p{L}')} END"


# ---- sentences across lines

def ends_sentence(c, d):
    return d.has(c, rf"[{ENDS}][{_C}\s]*$")


def starts_lowercase(c, d):
    return d.has(c, rf"^[\s{_O}\p{{P}}]*\p{{Ll}}")


def starts_caseless(c, d):
    return d.has(c, rf"^[\s{_O}\p{{P}}]*\p{{Lo}}")


def continues(prev, nxt, d):
    """Whether ``nxt`` goes on with the sentence that ``prev`` broke off."""
    stops = d.has(prev, rf"[\p{{L}}\p{{M}},、，;；:：\-‐][{_C}\s]*$")
    return f"(coalesce({prev}, '') <> '' AND coalesce({nxt}, '') <> '' AND NOT {ends_sentence(prev, d)} AND ({starts_lowercase(nxt, d)} OR ({starts_caseless(nxt, d)} AND {stops})))"


def joiner(prev, nxt, d):
    alone = "".join(d.script(s) for s in NO_SPACE)
    return f"CASE WHEN {d.has(prev, rf'[{alone}。、，；：！？「」『』（）]\s*$')} AND {d.has(nxt, rf'^\s*[{alone}「『（]')} THEN '' ELSE ' ' END"


def continuation_confidence(prev, nxt, d):
    end = ends_sentence(prev, d)
    low = starts_lowercase(nxt, d)
    return f"""CASE WHEN trim(coalesce({prev}, '')) = '' OR trim(coalesce({nxt}, '')) = '' THEN 0.5e0 WHEN NOT {end} AND {low} THEN 0.98e0
        WHEN NOT {end} OR {low} THEN 0.82e0 ELSE 0.3e0 END"""


def line_break_hyphen(line, nxt, d):
    return f"({d.has(line, r'\p{Ll}[-‐' + chr(0xAD) + r']\s*$')} AND {d.has(nxt, r'^\s*\p{Ll}')})"


def hyphenation_class(prefix, suffix, converted, was_break, d):
    """Verdict on a hyphen: both fragments, the converted text, and whether a line broke there."""
    p, s, v = f"rtrim({prefix})", f"trim({suffix})", f"lower(trim({converted}))"
    has = d.has(p, "[-‐" + chr(0xAD) + "]$")
    solid = f"lower(concat({d.sub(p, '[-‐' + chr(0xAD) + ']+$')}, {s}))"
    plain = d.sub(v, "[-‐" + chr(0xAD) + "]")
    return f"""CASE WHEN {has} AND {was_break} AND {v} = {solid} THEN 'NORMALIZED_HYPHENATION' WHEN {has} AND {was_break} THEN 'HYPHENATION_ERROR'
        WHEN {has} AND {v} = {solid} THEN 'HYPHEN_REMOVED' WHEN NOT {has} AND {plain} <> {v} AND {plain} = lower(concat({p}, {s})) THEN 'HYPHEN_ADDED' ELSE 'NONE' END"""


# ---- predicates of layout text

def page_number_like(c, d):
    return d.has(f"trim(trim({c}), '.-')" if d.name == "duck" else f"trim(BOTH '.-' FROM trim({c}))", r"^(?:\d{1,4}|[ivxlcdm]{1,15}|[IVXLCDM]{1,15})$")


def roman_valid(c, d):
    """A Roman numeral with a positive sum: no run of smaller signs before larger ones makes the whole negative."""
    return d.has(f"upper(trim({c}))", "^M{0,4}(?:CM|CD|D?C{0,4})(?:XC|XL|L?X{0,4})(?:IX|IV|V?I{0,4})$") + f" AND trim({c}) <> ''"


def page_range(c, d):
    return d.has(c, PAGE_RANGE)


def url_or_doi(c, d):
    return d.has(c, LINK)


_NAME = r"(?:[a-z]+\s+){0,2}\p{Lu}[\p{L}'’\-]*"


def author_start(c, d):
    t = f"trim({c})"
    return f"({d.has(t, rf'^{_NAME}\s*,\s*\p{{Lu}}')} OR {d.has(t, rf'^{_NAME}\s+\p{{Lu}}\.?\s')} OR {d.has(t, rf'^{_NAME}(?:\s*,\s*\p{{Lu}}[\p{{L}}.’-]*)?\s+et al')})"


def organization_start(c, d):
    t = f"trim({c})"
    return f"({d.has(t, rf'^[A-Z][\w&.,’ -]*\b(?:{INSTITUTIONS})\b')} OR {d.has(t, rf'^(?:{ACRONYMS})\b[.,]?\s')})"


def year_start(c, d):
    t = f"trim({c})"
    return f"({d.has(t, rf'^\(?{YEAR}\)?\s*[.,;]')} AND NOT {d.has(t, r'^\d{4}:\S')})"


def year_near_start(c, d):
    return d.has(f"substring(trim({c}), 1, 40)", YEAR)


def extract_year(c, d):
    return d.get(c, YEAR, 1)


def extract_author(c, d):
    t = f"trim({c})"
    return d.sub(d.get(t, rf"^({_NAME}\s*,\s*\p{{Lu}}|{_NAME}\s+\p{{Lu}}\.?\s)", 1), r"[, ]+$")


def bibliography_heading(c, d):
    return f"trim({d.sub(f'lower({c})', '[^a-z ]')}) IN ({', '.join(map(d.q, BIBLIOGRAPHIES))})"


def index_alpha_heading(c, d):
    return d.has(f"trim({c})", r"^[A-Za-z][.\-\s]*$")


def index_page_reference(c, d):
    return d.has(f"trim({c})", rf"{PAGE_REFS}\s*$")


def index_page_only(c, d):
    return d.has(f"trim({c})", rf"^{PAGE_REFS}$")


def index_cross_reference(c, d):
    return d.has(c, r"(?i)[,.]\s*(?:see also|see|véase|voir aussi|voir|siehe auch|siehe|vedi|zie)(?:[^\p{L}]|$)")


def index_complete(c, d):
    return f"({d.has(c, r'\d\s*$')} OR {index_cross_reference(c, d)})"


def blank_page_notice(c, d):
    phrases = "intentionally left blank|left blank by|this page is blank|página en blanco|page laissée blanche|seite bleibt frei|pagina bianca"
    return f"(length({c}) < 90 AND {d.has(f'lower({c})', phrases)})"


# ---- labels, references, credits

_LABEL_WORDS = {
    # Words of labels, longest first.
    "chapter": "hoofdstuk|rozdział|κεφάλαιο|capítulo|chapitre|capitolo|kapitel|chapter|розділ|глава|अध्याय|الفصل|บทที่|chap|cap|kap",
    "figure": "abbildung|рисунок|рисунка|εικόνα|rysunek|figure|figura|рис|चित्र|شكل|abb|afb|fig|rys|εικ",
    "table": "tableau|tabelle|tabella|таблица|таблиця|πίνακας|tabela|tabel|table|tabla|табл|जدول|tab",
    "part": "część|частина|часть|partie|parte|teil|deel|part|μέρος",
}


def match_label(c, d, kind: str, group: int = 1):
    """Label (group 1) or the rest after it (group 2) of a text that starts with one; empty if none."""
    return d.get(c, rf"(?i)^\s*((?:{_LABEL_WORDS[kind]})\.?\s*(?:\d+(?:[.\-–]\d+)*|[IVXLC]+\b))[\s.:：\-–—]*(.*)$", group)


# Headings of structural parts.
HEADINGS = {
    "references": ("references", "bibliography", "works cited", "literatur", "literaturverzeichnis", "bibliographie", "bibliografía", "bibliografia", "bibliografie", "список литературы", "література", "βιβλιογραφία", "参考文献", "参考資料"),
    "notes": ("notes", "endnotes", "footnotes", "anmerkungen", "notas", "note", "noten", "przypisy", "примечания", "примітки", "σημειώσεις", "注释", "注"),
    "index": ("index", "register", "índice", "indice", "indeks", "указатель", "покажчик", "ευρετήριο", "索引"),
    "contents": ("contents", "table of contents", "inhalt", "inhaltsverzeichnis", "sommaire", "contenido", "sumário", "indice generale", "spis treści", "содержание", "зміст", "περιεχόμενα", "目次", "目录"),
    "preface": ("preface", "vorwort", "préface", "prefacio", "prefácio", "prefazione", "voorwoord", "przedmowa", "предисловие", "передмова", "πρόλογος", "前言", "序"),
    "introduction": ("introduction", "einleitung", "introducción", "introdução", "introduzione", "inleiding", "wstęp", "введение", "вступ", "εισαγωγή"),
    "glossary": ("glossary", "glossar", "glossaire", "glosario", "glossário", "glossario"),
}


def heading_kind(c, d):
    t = d.sub(f"lower(trim({c}))", r"^\s*(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.:)\s]+")
    t = d.sub(d.sub(t, r"[\s.:：。]+$"), r"\s+", " ")
    arms = " ".join(f"WHEN {t} IN ({', '.join(map(d.q, words))}) THEN '{k}'" for k, words in HEADINGS.items())
    return f"CASE WHEN {c} IS NULL OR length({c}) > 60 THEN NULL {arms} END"


def reference_number(c, d, group: int = 1):
    p = REFERENCE_NUMBER
    return d.get(c, p, 1) if group == 1 else f"CASE WHEN {d.has(c, p)} THEN {d.get(c, p, 2)} ELSE trim({c}) END"


def reference_label(c, d):
    return d.get(c, REFERENCE_LABEL, 1)


def isbn_value(c, d):
    return d.sub(d.get(c, r"((?:97[89][\s-]?)?\d(?:[\s-]?\d){8}[\s-]?[\dXx])", 1), r"[\s-]")


def isbn_format(c, d):
    t = f"lower({c})"
    return f"CASE WHEN {d.has(t, ELECTRONIC)} THEN 'electronic' WHEN {d.has(t, PRINTED)} THEN 'print' END"


def copyright_year(c, d):
    return d.get(c, rf"^.*(?:^|\D){YEAR}(?:\D|$)", 1)


def copyright_holder(c, d):
    x = d.sub(d.sub(c, r"(?i)copyright|©|\(c\)"), rf"(^|[^\p{{L}}\p{{N}}]){YEAR}([^\p{{L}}\p{{N}}]|$)", "@1@3")
    return d.sub(d.sub(x, r"^[ .,]+"), r"[ .,]+$")


def keywords(c, d):
    x = d.sub(c, r"(?i)^\s*key\s*words?\s*[:\-]\s*")
    return d.keep(d.each(d.split(x, "[;,·•]"), "k", "trim(k)"), "k", "k <> ''")


# ---- checks

def of_for_have(c, d):
    return d.get(c, rf"(?i)\b((?:{MODALS})\s+of)\b", 1)


def subject_verb(c, d):
    return d.get(c, rf"(?i)\b((?:{SUBJECTS})\s+(?:{VERBS}))\b", 1)


def odd_quotes(c, d):
    return f"{d.count(c, '[\"“”]')} % 2 = 1"


def page_number_merge(c, d):
    """'trailing' or 'leading' where a number is glued to a heading, else empty."""
    t = f"trim({c})"
    return f"""CASE WHEN {d.has(t, r'^.*\S\s+(?:\p{Lu}\S*)\s+\d{1,4}$')} OR {d.has(t, r'^\S+\s+\p{Lu}\S*\d{1,4}$')} THEN 'trailing'
        WHEN {d.has(t, r'^\d{1,4}\s+\p{Lu}\S*\s+\S')} THEN 'leading' ELSE '' END"""


def missing_callouts(c, d):
    """Numbers glued to the end of a sentence outside superscripts."""
    x = d.sub(c, "<sup>[^<]*</sup>")
    return d.each(d.all(x, r"[\p{L}\"”’)][.!?]\d{1,3}(?:\s|$)"), "m", d.get("m", r"(\d{1,3})", 1))


def skippable_word(c, d):
    return f"({d.has(c, r'^\p{Lu}{2,}$')} OR {d.has(c, r'\d')} OR {d.has(c, r'^\p{Lu}')})"
