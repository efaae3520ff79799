"""Text forms that need Unicode data: Arrow-batched Python, one call a batch."""

from __future__ import annotations

import unicodedata as U

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions import text as T

_SPACES = {ord(c): " " for c in T.SPACES} | {0xAD: None}
#: Presentation forms of Arabic and Hebrew, and the Latin ligatures.
PRESENTATION = ((0xFB00, 0xFB06), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF))


def normal(t: str | None) -> str | None:
    """Composed, soft hyphens out, any space to one blank, trimmed."""
    return None if t is None else " ".join(U.normalize("NFC", t).translate(_SPACES).split())


def semantic(t: str | None) -> str | None:
    """The normal form with ligatures spelt out and case folded."""
    if t is None:
        return None
    t = normal(t)
    for a, b in T.LIGATURES.items():
        t = t.replace(a, b)
    return t.casefold()


def letters_of_forms(t: str | None) -> str | None:
    """Presentation forms to ordinary letters, everything else kept."""
    return None if t is None else "".join(U.normalize("NFKC", c) if any(a <= ord(c) <= b for a, b in PRESENTATION) else c for c in t)


def code_points(t: str | None) -> str | None:
    return None if t is None else " ".join(f"U+{ord(c):04X}" for c in t)


def script_of_name(c: str) -> str:
    """Script by the first word of a character's name; COMMON for others, UNKNOWN without a name."""
    name = U.name(c, "")
    first = name.split(" ")[0]
    known = ("LATIN", "GREEK", "CYRILLIC", "HEBREW", "ARABIC", "HIRAGANA", "KATAKANA", "HANGUL", "DEVANAGARI", "THAI", "ARMENIAN", "GEORGIAN")
    return first if first in known else "COMMON" if name else "UNKNOWN"


def _udf(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def text_normalize(c: str) -> Column:
    return _udf(normal)(F.col(c))


def text_semantic(c: str) -> Column:
    return _udf(semantic)(F.col(c))


def presentation_forms(c: str) -> Column:
    return _udf(letters_of_forms)(F.col(c))


def unicode_string(c: str) -> Column:
    return _udf(code_points)(F.col(c))


def first_script(c: str) -> Column:
    return _udf(lambda t: script_of_name(t[0]) if t else "")(F.col(c))


# Pairs of letters that look alike, Greek and Latin, then Cyrillic and Latin.
CONFUSABLE = (
    ("α", "a"), ("Α", "A"), ("β", "B"), ("Β", "B"), ("γ", "y"), ("ο", "o"), ("Ο", "O"), ("ρ", "p"), ("Ρ", "P"), ("χ", "x"), ("Χ", "X"),
    ("κ", "k"), ("Κ", "K"), ("μ", "m"), ("μ", "u"), ("Μ", "M"), ("ν", "v"), ("Ν", "N"), ("ι", "i"), ("Ι", "I"), ("ε", "e"), ("Ε", "E"),
    ("τ", "t"), ("Τ", "T"), ("η", "n"), ("Η", "H"), ("υ", "u"), ("Υ", "Y"), ("σ", "o"), ("Ζ", "Z"),
    ("а", "a"), ("А", "A"), ("е", "e"), ("Е", "E"), ("о", "o"), ("О", "O"), ("р", "p"), ("Р", "P"), ("с", "c"), ("С", "C"), ("х", "x"), ("Х", "X"),
    ("у", "y"), ("У", "Y"), ("і", "i"), ("І", "I"), ("ѕ", "s"), ("в", "b"), ("к", "k"), ("К", "K"), ("м", "m"), ("М", "M"), ("н", "h"), ("Н", "H"),
    ("т", "t"), ("Т", "T"), ("в", "v"),
)
# Special characters that a change of is told from other changes.
SPECIAL = "©®™°±≤≥≠×÷−αβγΔΩμπ§¶†‡•"


def confusable(a, b) -> Column:
    """Whether two characters look alike, in either order."""
    pair = F.concat(a, b)
    return pair.isin(*[x + y for x, y in CONFUSABLE], *[y + x for x, y in CONFUSABLE])
