"""Problem 5: text that was decoded with the wrong character encoding.

1. *Statistics.* Adjacent character pairs are counted over the whole corpus, each
   text with a blank before and after it. Sequences whose bytes form UTF-8 after
   all are left out, so that they can't vouch for themselves. Characters fall into
   at most ``SIZE`` classes (each Latin, Greek, Cyrillic and symbol character for
   itself, other scripts by block), so the table of counts has a fixed bound
   (SIZE x SIZE) and can be broadcast.
2. *Scores.* The mutual information of a pair is shrunk towards that of its kinds
   (script and category), which decides where a character is rare.
3. *Runs.* Over each text, ``THETA`` minus the information of a pair is the score
   of a position; maximum-scoring segments are the improbable runs.
4. *Inverse mappings* are tested only inside the runs, on each sequence of
   non-ASCII characters: encode with the encoding that was used by mistake, decode
   with the right one. A mapping is accepted if the text around becomes more
   likely by ``GAIN`` (``GAIN_UTF8`` where UTF-8 comes out, which hardly happens by
   chance). It is repeated up to three times for text that was spoilt repeatedly.

A record is found if a mapping is accepted, or a run holds a replacement character
or a C1 control, which no right text does.

Defined cases: null and empty texts are no cases; repeated rows count once; long
texts are processed whole; an empty table gives an empty result; a text that needs
no repair is returned unchanged.
"""

from __future__ import annotations

import unicodedata as U
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.charforms import LOOK_ALIKES
from quirelight.operators.hierarchy import current_zones

SIZE = 2048
THETA, PRIOR = 1.5, 50.0
GAIN, GAIN_EDGE, GAIN_UTF8 = 3.0, 1.5, 0.5
#: A sequence this long may be letters read as other letters; a shorter one must change its kind.
WORD = 3
#: Times that a text may have been spoilt.
DEPTH = 3
#: Encodings used by mistake, each with the right ones it can have stood for.
_LATIN = ("utf-8", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_u", "cp1253", "cp1256", "cp874", "gb18030", "shift_jis", "euc_jp", "euc_kr", "big5")
MISTAKES = {
    "cp1252": _LATIN,
    "latin-1": _LATIN,
    "mac_roman": ("utf-8", "cp1252"),
    "cp437": ("utf-8", "cp1252"),
    "cp850": ("utf-8", "cp1252"),
    "cp1250": ("utf-8", "cp1252"),
    "iso8859-2": ("utf-8", "cp1252"),
    "cp1251": ("utf-8", "koi8_u", "cp1252"),
    "koi8_u": ("utf-8", "cp1251"),
}
MULTI = ("gb18030", "shift_jis", "euc_jp", "euc_kr", "big5")
_OWN = ((0x20A0, 0x20D0), (0x2100, 0x2150), (0x2200, 0x2300), (0x2500, 0x2600), (0x2000, 0x2070), (0x370, 0x460), (0x2B0, 0x300))
_KINDS = ("space", "digit", "lower", "upper", "ext lower", "ext upper", "GREEK", "CYRILLIC", "ARABIC", "DEVANAGARI", "HANGUL", "THAI", "HIRAGANA", "KATAKANA", "CJK", "letter", "ascii punct", "quote or dash", "symbol", "control", "box", "mark", "format", "replacement", "wide punct")


_EXT, _QUOTE = _KINDS.index("ext lower"), _KINDS.index("quote or dash")
_GREEK = _KINDS.index("GREEK")
_LETTER, _MARK = _KINDS.index("letter"), _KINDS.index("mark")
_SCRIPTS = set(range(_KINDS.index("GREEK"), _KINDS.index("letter") + 1))
_EAST = {_KINDS.index(k) for k in ("HANGUL", "HIRAGANA", "KATAKANA", "CJK", "wide punct")}


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and the kind of each class."""
    cp = np.arange(0x110000)
    table = np.minimum(cp, 0x24F).astype(np.uint16)
    nxt = 0x250
    for a, b in _OWN:
        table[a:b] = np.arange(nxt, nxt + b - a)
        nxt += b - a
    for c in range(0x370, 0x460):  # words in capitals are the same words
        low = chr(c).lower()
        if len(low) == 1 and 0x370 <= ord(low) < 0x460:
            table[c] = table[ord(low)]
    rest = cp >= 0x250
    for a, b in _OWN:
        rest[a:b] = False
    table[rest] = nxt + (cp[rest] >> 8) % (SIZE - nxt - 1)
    table[0xFFFD] = SIZE - 1
    table[[9, 10, 11, 12, 13, 0xA0, 0x3000, *range(0x2000, 0x200B), 0x202F]] = 32
    table[ord("0") : ord("9") + 1] = ord("0")
    kinds = np.zeros(SIZE, np.uint8)
    first = {}
    for c, k in zip(range(0x10000), table[:0x10000].tolist()):
        if k not in first or first[k][1] in ("Cn", "Cs", "Co") or c == 0xFFFD:
            first[k] = (c, U.category(chr(c)))
    for k, (c, cat) in first.items():
        kinds[k] = _KINDS.index(_kind(chr(c), cat, k))
    return table, kinds


def _kind(ch: str, cat: str, k: int) -> str:
    c = ord(ch)
    if k == 32:
        return "space"
    if c == 0xFFFD:
        return "replacement"
    if cat == "Cc":
        return "control"
    if cat[0] == "N":
        return "digit" if c < 0x80 else "symbol"
    if cat[0] == "L":
        if c < 0x80:
            return "lower" if cat == "Ll" else "upper"
        if c < 0x250:
            return "symbol" if ch in "ªº" else "ext lower" if cat == "Ll" else "ext upper"
        name = U.name(ch, "").split(" ")[0]
        return name if name in _KINDS else "symbol" if cat == "Lm" else "letter"
    if cat[0] == "M":
        return "mark"
    if cat == "Cf":
        return "format"
    if 0x2500 <= c < 0x2600:
        return "box"
    if c < 0x80:
        return "ascii punct"
    if c >= 0x3000:
        return "wide punct"
    return "quote or dash" if cat[0] == "P" else "symbol"


@cache
def _utf8_like():
    """Sequences that are UTF-8 bytes read with a one-byte encoding."""
    import re

    parts = []
    for enc in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250"):
        ch = [bytes([b]).decode(enc, "replace") for b in range(256)]
        esc = lambda bs: "[" + "".join(re.escape(ch[b]) for b in bs if ch[b] != "�") + "]"  # noqa: E731, B023
        tail = esc(range(0x80, 0xC0))
        parts += [esc(range(0xC2, 0xE0)) + tail, esc(range(0xE0, 0xF0)) + tail + "{2}", esc(range(0xF0, 0xF5)) + tail + "{3}"]
    return re.compile("|".join(parts))


def _codes(texts: list[str]) -> np.ndarray:
    """Classes of all characters of the texts, a blank between any two and at both ends."""
    joined = " " + " ".join(texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return classes()[0][cp]


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n) over the column ``text``: counts of class pairs, pair = first * SIZE + second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, np.int64)
        broken = _utf8_like()
        for batch in batches:
            rows = [broken.sub("�", t) if not t.isascii() else t for t in batch.column(0).to_pylist() if t]
            if rows:
                c = _codes(rows).astype(np.int64)
                total += np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return texts.select("text").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def information(counts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(mutual information of each class pair, log probability of each class)."""
    n = np.zeros((SIZE, SIZE))
    for pair, k in counts:
        n[pair // SIZE, pair % SIZE] = k
    n[SIZE - 1, :] = n[:, SIZE - 1] = 0
    kinds = classes()[1]
    total = max(n.sum(), 1.0)
    a, b = n.sum(1), n.sum(0)
    hot = np.zeros((SIZE, len(_KINDS)))
    hot[np.arange(SIZE), kinds] = 1
    coarse = hot.T @ n @ hot
    ca, cb = coarse.sum(1), coarse.sum(0)
    ratio = (coarse + 1) / (np.outer(ca, cb) / total + 1)
    expected = np.outer(a, b) / total
    pmi = np.log((n + PRIOR * ratio[kinds][:, kinds]) / (expected + PRIOR))
    pmi[SIZE - 1, :] = pmi[:, SIZE - 1] = -12.0
    for k in np.flatnonzero(kinds == _KINDS.index("control")):
        pmi[k, :] = pmi[:, k] = -12.0
    return pmi.astype(np.float32), np.log((a + 0.5) / total).astype(np.float32)


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal segments of positive total score, [start, end), left to right, in linear time."""
    stack: list[list] = []  # start, end, sum before, sum through
    sums = np.cumsum(score, dtype=np.float64)
    at = np.flatnonzero(score > 0)
    for i, total, gain in zip(at.tolist(), sums[at].tolist(), score[at].tolist()):
        before = total - gain
        cur = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cur[2]:
                j -= 1
            if j < 0 or stack[j][3] >= cur[3]:
                stack.append(cur)
                break
            cur = [stack[j][0], cur[1], stack[j][2], cur[3]]
            del stack[j:]
    return [(s[0], s[1]) for s in stack]


class Repair:
    """Finds and undoes wrong decoding with a table of pair information."""

    def __init__(self, pmi: np.ndarray, logp: np.ndarray):
        import re

        self.pmi, self.logp = pmi, logp
        self.table, self.kinds = classes()
        self.foreign = re.compile("[^\x00-\x7f]+")
        self.cache: dict = {}

    def needed(self, left: str, piece: str, right: str, text: str, multi: bool) -> float | None:
        """The gain from which one-byte (or CJK) decoding is believed, by the kinds of characters; None: never."""
        if any(c == "\xa0" or "\x80" <= c <= "\x9f" or U.category(c) in ("Cf", "Sk", "Co", "Cn") for c in text):
            return None
        a, b = (self.kinds[self.table[[ord(c) for c in x]]].tolist() for x in (piece, text))
        if multi:
            return GAIN * len(text) if len(text) > 1 and all(k in _EAST for k in b) else None
        if len(piece) >= WORD:
            same = set(a) & _SCRIPTS and set(b) - set(a)
            return None if same or not all(_EXT <= k <= _QUOTE for k in b) else GAIN
        inside = left.isalpha() and right.isalpha()
        for x, y, c in zip(a, b, text):
            if x == y or y not in (_EXT, _EXT + 1, _QUOTE) or x in _SCRIPTS and not (x == _GREEK and inside):
                return None
            if (x, y) == (_EXT, _EXT + 1):
                return None
            if x == _EXT + 1 and not (left.islower() or right.islower()):
                return None  # a capital among capitals
            if c == "–" and not (left.isspace() and right.isspace()):
                return None
        if all(x > _QUOTE or x == _GREEK for x in a):
            return GAIN_UTF8 if inside else GAIN
        if _QUOTE in a and not inside:
            return GAIN + 4
        return GAIN if inside else GAIN_EDGE

    def lossy(self, left: str, piece: str, right: str, base: float) -> tuple[float, str | None]:
        """The best text for UTF-8 bytes of which the C1 controls were dropped, with its gain."""
        best, found = 0.0, None
        options: list[str] = []
        if piece[0] == "\xe2":  # the first byte of the signs from U+2000 on, the second (0x80) lost, and the third too if it was a control
            kept = "\xa0" <= piece[1:2] <= "\xbf"
            signs = [chr(0x2000 | ord(piece[1]) & 63)] if kept else [chr(0x2000 | k) for k in range(32)]
            options = [c + piece[1 + kept :] for c in signs if U.category(c)[0] == "P"]
        elif "Ã" <= piece[0] <= "ß" and right.islower() and len(piece) == 1:
            options = [chr((ord(piece[0]) & 31) << 6 | k) for k in range(32)]
            options = [c for c in options if c.isalpha()]
        for text in options:
            if text[:1] == "–" and not (left.isspace() and right.isspace()):
                continue
            gain = self.likelihood(left + text + right) - base - GAIN
            if gain > best:
                best, found = gain, text
        return best, found

    def likelihood(self, text: str) -> float:
        c = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return float(self.pmi[c[:-1], c[1:]].sum() + self.logp[c[1:]].sum())

    def restored(self, left: str, piece: str, right: str) -> tuple[str | None, bool]:
        """(restored piece or None, whether its text is wrongly decoded)."""
        key = (left, piece, right)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[key] = self._restored(left, piece, right, DEPTH)
        return self.cache[key]

    def _restored(self, left: str, piece: str, right: str, again: int) -> tuple[str | None, bool]:
        sure = any(c == "�" or "\x80" <= c <= "\x9f" for c in piece)
        if all(c in LOOK_ALIKES or U.category(c) == "Cf" for c in piece):
            return None, False
        base = self.likelihood(left + piece + right)
        best, found = self.lossy(left, piece, right, base)
        for wrong, rights in MISTAKES.items():
            raw = _encoded(piece, wrong)
            if raw is None:
                continue
            for right_enc in rights:
                try:
                    text = raw.decode(right_enc)
                except UnicodeDecodeError:
                    continue
                utf8 = right_enc == "utf-8"
                least = GAIN_UTF8 if utf8 else self.needed(left, piece, right, text, right_enc in MULTI)
                if text == piece or least is None or left.isspace() and U.category(text[0])[0] == "M":
                    continue
                gain = self.likelihood(left + text + right) - base - least
                if utf8:  # fewer characters are no gain in themselves
                    gain += 3.0 * (len(piece) - len(text)) - 6.0 * text.count("�")
                if gain > best and (utf8 or again == DEPTH):
                    best, found = gain, text
        if found is not None and again > 1 and not found.isascii():
            found = self._restored(left, found, right, again - 1)[0] or found
        return found, sure or found is not None

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """The improbable sequences of non-ASCII characters of a text."""
        padded = " " + text + " "
        c = self.table[np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)]
        score = THETA - self.pmi[c[:-1], c[1:]]
        score[(c[:-1] < 0x80) & (c[1:] < 0x80)] = -1.0
        if not (score > 0).any():
            return []
        out = []
        for a, b in segments(score):
            # positions a..b-1 join padded[a]..padded[b], that is text[a-1]..text[b-1]
            lo, hi = max(a - 1, 0), min(b, len(text))
            while lo > 0 and text[lo] > "\x7f" and text[lo - 1] > "\x7f":
                lo -= 1
            while hi < len(text) and text[hi - 1] > "\x7f" and text[hi] > "\x7f":
                hi += 1
            out += [(lo + m.start(), lo + m.end()) for m in self.foreign.finditer(text[lo:hi])]
        return sorted(set(out))

    def suspects(self, texts: list[str]) -> list[int]:
        """Indices of the texts that have an improbable position at all, for a whole batch at once."""
        if not texts:
            return []
        joined = " " + " ".join(texts) + " "
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.table[cp]
        high = c >= 0x80
        hot = np.zeros(len(cp), bool)
        at = np.flatnonzero(high[:-1] | high[1:])
        hot[at] = self.pmi[c[at], c[at + 1]] < THETA
        # texts i covers positions ends[i-1]..ends[i]: its own characters and the blanks beside it
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        where = np.flatnonzero(hot)
        if not len(where):
            return []
        own = np.minimum(np.searchsorted(ends, where, side="left"), len(texts) - 1)
        also = np.minimum(np.searchsorted(ends, where, side="right"), len(texts) - 1)
        return np.unique(np.concatenate([own, also])).tolist()

    def text(self, text: str) -> tuple[str, bool]:
        """(restored text, whether it was wrongly decoded anywhere)."""
        if text.isascii():
            return text, False
        out, at, wrong = [], 0, False
        for a, b in self.pieces(text):
            if a < at:
                continue
            new, hit = self.restored(text[a - 1] if a else " ", text[a:b], text[b] if b < len(text) else " ")
            wrong |= hit
            out += [text[at:a], text[a:b] if new is None else new]
            at = b
        return "".join(out) + text[at:], wrong


def _encoded(piece: str, enc: str) -> bytes | None:
    """Bytes of a piece; cp1252 with its five free places as C1 controls; a lost character as a byte that decodes to nothing."""
    try:
        return piece.encode(enc)
    except UnicodeEncodeError:
        if enc != "cp1252" and enc != "cp1250":
            return None
    out = bytearray()
    for c in piece:
        try:
            out += c.encode(enc)
        except UnicodeEncodeError:
            if "\x80" <= c <= "\x9f":
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def table_of(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pair information of a corpus; at most SIZE x SIZE counts reach the driver."""
    return information([(r.pair, r.n) for r in pair_counts(texts).collect()])


def restored(df: DataFrame, info: tuple[np.ndarray, np.ndarray], *keys: str) -> DataFrame:
    """(keys, text, restored, wrong) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(info)
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repair(*shared.value)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            done = [(t, False) for t in texts]
            some = [i for i, t in enumerate(texts) if t and not t.isascii()]
            for k in fix.suspects([texts[i] for i in some]):
                done[some[k]] = fix.text(texts[some[k]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())], names=[*keys, "text", "restored", "wrong"])

    return df.select(*keys, "text").mapInArrow(run, f"{fields}, text string, restored string, wrong boolean")


def records(pdf_tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, text) of tokens and current zones that have text."""
    tokens = pdf_tokens.where("text <> ''").select(F.lit("pdf_token").alias("rec_kind"), F.col("token_id").cast("string").alias("rec_id"), "text").distinct()
    z = current_zones(zones, "text").where("text <> ''").select(F.lit("zone").alias("rec_kind"), F.col("zone_id").alias("rec_id"), "text")
    return tokens.unionByName(z)


def corpus(pdf_tokens: DataFrame, zones: DataFrame) -> DataFrame:
    return zones.select("text").unionByName(pdf_tokens.select("text"))


def repaired(pdf_tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, restored) of the wrongly decoded records."""
    info = table_of(corpus(pdf_tokens, zones))
    return restored(records(pdf_tokens, zones), info, "rec_kind", "rec_id").where("wrong").select("rec_kind", "rec_id", "restored")


def found(pdf_tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """(rec_kind, rec_id) of the wrongly decoded records."""
    return repaired(pdf_tokens, zones).select("rec_kind", "rec_id").distinct()
