"""Problem 2: the language of documents, zones and foreign segments, by rank-order profiles.

*Training* on a bounded sample (``PER_LABEL`` documents of each listed label,
chosen by hash): the ``PROFILE`` most frequent 1- to 3-grams of a language in
order of frequency. Labels may be wrong and texts mixed, so the lines of the
sample are classified once with the first profiles and only agreeing lines make
the final ones; a label whose lines are as near to another profile gets none.

*Classification* of a segment (a sentence, roughly): its ``TOP`` most frequent
n-grams are ranked, and the out-of-place distance to each profile of its script
is the mean of |rank - profile rank|, ``PROFILE`` for a missing n-gram. Scripts of
one language are decided by their letters alone; Chinese and Japanese by runs of segments
with and without kana, short runs going with their record. All texts of an Arrow batch are handled together in numpy arrays.

``segments`` gives the passages of each record with language and confidence.

The language with most letters is the record's; a segment changes it only if its
own language is nearer by ``FOREIGN_MARGIN``. A further language counts with
``MIN_FOREIGN`` letters. In documents, lines that recur all over the corpus (site
lines, by their words in small letters) don't count as foreign segments.

The confidence of a record's language is the share of its letters weighted by how
much nearer the language is than the next one.

Defined cases: null and empty texts and texts with fewer than ``MIN_LETTERS``
letters have no language; a label counts only in a spelling of ``language_codes``;
repeated rows count once; texts are processed whole. A text that is garbled for the
most part is classified after its encoding is undone (``readable``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm import sitelines
from quirelight.operators.hierarchy import current_zones
from quirelight.runtime import staged

PER_LABEL, PROFILE, TOP = 300, 400, 300
#: Longest text of the sample for the profiles.
SAMPLE_CHARS = 20_000
MARGIN, FOREIGN_MARGIN, MIN_LETTERS, MIN_FOREIGN = 12.0, 40.0, 20, 18
#: The same where the script alone tells the language.
MIN_OTHER_SCRIPT = 8
#: How much nearer a language's lines must be to its own profile than to any other (median).
OWN_GAP = 20.0
#: Share of kana in a Japanese segment; letters of a run of Chinese or Japanese segments that has a language of its own.
KANA, MIN_PASSAGE = 0.05, 40
#: Letters that a segment needs to be told from the languages of its own script.
MIN_SEGMENT = 16
#: Share of non-ASCII letters above which a Latin segment is no text of any language.
MAX_STRANGE = 0.4
SCRIPTS = ("none", "Latin", "Cyrillic", "Greek", "Arabic", "Devanagari", "Hangul", "Han", "Japanese", "Thai", "other")
_RANGES = (
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xAA, 0xAA), ("Latin", 0xBA, 0xBA), ("Latin", 0xC0, 0xD6), ("Latin", 0xD8, 0xF6), ("Latin", 0xF8, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x400, 0x52F), ("other", 0x530, 0x5FF), ("Arabic", 0x620, 0x6FF), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFC), ("Devanagari", 0x904, 0x97F), ("Thai", 0xE01, 0xE46), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0x3130, 0x318F), ("Hangul", 0xAC00, 0xD7A3),
    ("Japanese", 0x3041, 0x30FF), ("Japanese", 0xFF66, 0xFF9D), ("Han", 0x3400, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x3FFFF), ("Latin", 0xFF21, 0xFF3A), ("Latin", 0xFF41, 0xFF5A),
)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: script, letter code for n-grams (0: no letter), and what it does to a segment."""
    import unicodedata as U

    script = np.zeros(0x110000, np.uint8)
    for name, a, b in _RANGES:
        script[a : b + 1] = SCRIPTS.index(name)
    for c in range(0x10000):
        if script[c] and U.category(chr(c))[0] != "L":
            script[c] = 0
    code = np.zeros(0x110000, np.uint8)
    nxt = 1
    for a, b in ((0x61, 0x7A), (0xDF, 0xFF), (0x100, 0x17F), (0x430, 0x45F), (0x490, 0x491)):
        for c in range(a, b + 1):
            if chr(c).islower() and len(chr(c).lower()) == 1:
                code[c] = nxt
                nxt += 1
    for c in range(0x41, 0x500):
        low = chr(c).lower()
        if len(low) == 1 and not code[c]:
            code[c] = code[ord(low)]
    for k in range(26):
        code[0xFF21 + k] = code[0xFF41 + k] = code[0x61 + k]
    role = np.zeros(0x110000, np.uint8)  # 1: ends a sentence before a capital, 2: ends it, 3: blank, 4: capital or opening mark
    for c in ".!?…:":
        role[ord(c)] = 1
    for c in "。！？।\n\x01":
        role[ord(c)] = 2
    for c in " \t\xa0":
        role[ord(c)] = 3
    for c in range(0x10000):
        if chr(c).isupper() or chr(c) in "«“„‘\"¿¡—(":
            role[c] = 4
    return script, code, role


def ngram_codes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that end at each position; -1 where there is none.

    A word has a blank on either side; n-grams don't pass a blank.
    """
    c = code.astype(np.int64)
    b = np.concatenate([[0], c[:-1]])
    a = np.concatenate([[0, 0], c])[: len(c)]
    one = np.where(c > 0, c, -1)
    two = np.where((c > 0) | (b > 0), b << 8 | c, -1)
    three = np.where((b > 0) & ((a > 0) | (c > 0)), a << 16 | b << 8 | c, -1)
    return one, np.where(two >= 0, two | 1 << 24, -1), np.where(three >= 0, three | 1 << 25, -1)


class Profiles:
    """Rank profiles of languages, and the classification with them."""

    def __init__(self, langs: list[str], scripts: list[str], grams: list[np.ndarray], singles: dict[str, str]):
        self.langs, self.scripts, self.grams, self.singles = langs, scripts, grams, singles
        self.names = [*langs, *sorted(set(singles.values()))]

    def prepare(self) -> Profiles:
        if not hasattr(self, "index"):
            every = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.int64)
            self.size = len(every)
            kind = np.int16 if self.size < 1 << 15 else np.int32
            self.index = [np.full(1 << bits, -1, kind) for bits in (8, 16)]
            for k, g in enumerate(every.tolist()):
                if not g >> 25:
                    self.index[1 if g >> 24 else 0][g & 0xFFFF] = k
            # 3-grams by the number of their first two letters (0: none has these), so that the tables stay small
            three = np.flatnonzero(every >> 25)
            pairs, at = np.unique(every[three] >> 8 & 0xFFFF, return_inverse=True)
            self.pair = np.zeros(1 << 16, np.int32)
            self.pair[pairs] = np.arange(1, len(pairs) + 1, dtype=np.int32) << 8
            self.index.append(np.full(len(pairs) + 1 << 8, -1, kind))
            self.index[2][at + 1 << 8 | every[three] & 0xFF] = three
            self.rank = np.full((len(self.langs), len(every)), PROFILE, np.int16)
            for j, g in enumerate(self.grams):
                self.rank[j, np.searchsorted(every, g)] = np.arange(len(g))
            self.of_script = {s: np.array([x == s for x in self.scripts]) for s in ("Latin", "Cyrillic")}
        return self

    def distances(self, code: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
        """Mean out-of-place distance of each segment to each profile; ``PROFILE`` for empty segments."""
        c = code.astype(np.int32)
        two = c.copy()
        two[1:] |= c[:-1] << 8
        three = c.copy()
        three[1:] |= self.pair[two[:-1]]
        bits = self.size.bit_length()
        base = seg.astype(np.int64) << bits
        keys = []
        for table, key in zip(self.index, (c, two, three)):
            k = table[key]
            use = np.flatnonzero(k >= 0)
            keys.append(base[use] | k[use])
        out = np.full((n, len(self.langs)), float(PROFILE))
        key = np.concatenate(keys)
        if not len(key):
            return out
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        s, g = key >> bits, key & (1 << bits) - 1
        key = s << 36 | (0xFFFF - np.minimum(count, 0xFFFF)) << 20 | g  # n-gram numbers stay below 2**20
        key.sort()
        s, g = key >> 36, key & 0xFFFFF
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        rank = np.arange(len(s)) - np.repeat(start, size)
        if size.max() > TOP:
            keep = rank < TOP
            s, g, rank = s[keep], g[keep], rank[keep]
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(start, len(s)))
        rank = rank.astype(np.int16)
        at = s[start]
        for j, places in enumerate(self.rank):
            known = places[g]
            far = np.abs(known - rank)
            far[known == PROFILE] = PROFILE
            out[at, j] = np.add.reduceat(far, start, dtype=np.int32) / size
        return out

    def line_distances(self, texts: list[str]) -> np.ndarray:
        """Distances of whole texts to the profiles."""
        self.prepare()
        cp = np.frombuffer(("\x01".join(texts) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32)
        seg = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        return self.distances(tables()[1][cp], seg, len(texts))

    def segments(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Segments of all texts: record, first and last position, letters by script, distances."""
        self.prepare()
        script_of, code_of, role_of = tables()
        joined = "\x01".join(texts) + "\x01"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        script, code, role = script_of[cp], code_of[cp], role_of[cp]
        greek = script == SCRIPTS.index("Greek")
        if greek.any():  # a Greek letter alone among others is a sign or wrongly decoded
            script = np.where(greek & ~np.append(greek[1:], False) & ~np.append(False, greek[:-1]), 0, script)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        nxt, nxt2 = np.append(role, 0)[1:], np.append(role, [0, 0])[2:]
        stop = (role == 2) | (role == 1) & ((nxt == 4) & (np.append(script[1:], 0) != 0) | (nxt == 3) & (nxt2 == 4))
        seg = np.concatenate([[0], np.cumsum(stop[:-1])])
        n = int(seg[-1]) + 1
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        letters = np.bincount(seg * len(SCRIPTS) + script, minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
        letters[:, 0] = 0
        # Latin segments with so many letters beyond ASCII are wrongly decoded
        strange = np.bincount(seg, (script == 1) & (cp >= 0x80), n) > MAX_STRANGE * np.maximum(letters[:, 1], 1)
        lost = np.where(strange, letters[:, 1], 0)
        letters[strange, 1] = 0
        return {"rec": np.searchsorted(ends, first, side="right"), "first": first, "last": np.append(first[1:], len(cp)), "letters": letters, "lost": lost, "dist": self.distances(code, seg, n), "joined": joined, "start": ends - np.array([len(t) + 1 for t in texts])}

    def passages_of(self, texts: list[str]) -> dict[str, list]:
        """Passages of all texts: record, start, stop, language, confidence, in order."""
        texts = [_without_runs(t) for t in texts]
        _, _, s = self.classify(texts)
        letters, rec = s["letters"], s["rec"]
        col = {x: k for k, x in enumerate(self.names)}
        # by segment: the language of most of its letters, and the weight of that choice
        score = np.zeros((len(rec), len(self.names)))
        sure = np.zeros((len(rec), len(self.names)))
        for name, lang in self.singles.items():
            if name not in ("Han", "Japanese"):
                score[:, col[lang]] += letters[:, SCRIPTS.index(name)]
                sure[:, col[lang]] += letters[:, SCRIPTS.index(name)]
        use = np.flatnonzero(s["east"] >= 0)
        x = letters[:, SCRIPTS.index("Han")] + letters[:, SCRIPTS.index("Japanese")]
        score[use, s["east"][use]] += x[use]
        sure[use, s["east"][use]] += x[use]
        for j, name in enumerate(("Latin", "Cyrillic")):
            use = np.flatnonzero(s["lang"][:, j] >= 0)
            x = letters[use, SCRIPTS.index(name)]
            score[use, s["lang"][use, j]] += x
            sure[use, s["lang"][use, j]] += x * np.minimum(1.0, (s["margin"][use, j] + MARGIN) / (5 * MARGIN))
        best = np.where(score.any(1), score.argmax(1), -1)
        held = np.arange(len(rec))
        held[(best < 0) & np.concatenate([[False], rec[1:] == rec[:-1]])] = 0
        held = np.maximum.accumulate(held)  # a segment without letters goes with what is before it
        best = best[held]
        first = np.concatenate([[True], (rec[1:] != rec[:-1]) | (best[1:] != best[:-1])])
        run = np.cumsum(first) - 1
        n = np.bincount(run, score.sum(1))
        good = np.bincount(run, sure[np.arange(len(rec)), np.maximum(best, 0)])
        at = np.flatnonzero(first)
        keep = (best[at] >= 0) & (rec[at] < len(texts))
        ends = s["start"] + np.array([len(t) for t in texts])
        start = np.maximum(s["first"][at], s["start"][np.minimum(rec[at], len(texts) - 1)]) - s["start"][np.minimum(rec[at], len(texts) - 1)]
        stop = np.minimum(s["last"][np.append(at[1:], len(rec)) - 1], ends[np.minimum(rec[at], len(texts) - 1)]) - s["start"][np.minimum(rec[at], len(texts) - 1)]
        keep &= stop > start
        return {"rec": rec[at][keep].tolist(), "start": start[keep].tolist(), "stop": stop[keep].tolist(), "lang": [self.names[k] for k in best[at][keep]], "confidence": np.round(good[keep] / np.maximum(n[keep], 1), 6).tolist()}

    @staticmethod
    def passages(rec: np.ndarray, size: np.ndarray, kana: np.ndarray) -> np.ndarray:
        """For each segment 1 (Japanese) or 0 (Chinese), by the run of segments of one kind that it stands in; -1 where the run is short.

        Hardly a Japanese sentence has no kana, and no Chinese one has any, so neighbouring
        segments with and without kana make up the passages of a text.
        """
        out = np.full(len(rec), -1)
        use = np.flatnonzero(size > 0)
        if len(use):
            new = np.concatenate([[True], (rec[use][1:] != rec[use][:-1]) | (kana[use][1:] != kana[use][:-1])])
            run = np.cumsum(new) - 1
            long = np.bincount(run, size[use]) >= MIN_PASSAGE
            out[use] = np.where(long[run], kana[use].astype(int), -1)
        return out

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict]:
        """(letters of each record by language, confidence by language, segments with their languages)."""
        s = self.segments(texts)
        n, names = len(texts), self.names
        col = {x: k for k, x in enumerate(names)}
        letters, dist, rec = s["letters"], s["dist"], s["rec"]
        total = np.zeros((n, len(names)))
        sure = np.zeros((n, len(names)))
        for name, lang in self.singles.items():
            k = SCRIPTS.index(name)
            x = np.bincount(rec, letters[:, k], n)
            total[:, col[lang]] += x
            sure[:, col[lang]] += x
        east = np.full(len(rec), -1)
        if "zh" in col and "ja" in col:
            han, kana = (letters[:, SCRIPTS.index(k)] for k in ("Han", "Japanese"))
            x = han + kana
            for k in (col["zh"], col["ja"]):
                total[:, k] = sure[:, k] = 0
            rank = np.bincount(rec, x * (kana > KANA * x), n) > np.bincount(rec, x, n) / 2
            # a long passage is decided by its own kana, a short one goes with its record
            own = self.passages(s["rec"], x, kana > 0)
            east = np.where(x > 0, np.where(np.where(own >= 0, own == 1, rank[rec]), col["ja"], col["zh"]), -1)
            use = x > 0
            np.add.at(total, (rec[use], east[use]), x[use])
            np.add.at(sure, (rec[use], east[use]), x[use])
        lang = np.full((len(rec), 2), -1)
        margin = np.zeros((len(rec), 2))
        for j, name in enumerate(("Latin", "Cyrillic")):
            own = self.of_script[name]
            if not own.any():
                continue
            x = letters[:, SCRIPTS.index(name)]
            d = np.where(own[None, :], dist, 1e6)
            best = d.argmin(1)
            two = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.column_stack([d[:, 0], d[:, 0] + PROFILE])
            gap = np.minimum(two[:, 1] - two[:, 0], PROFILE)
            voting = (x >= MIN_SEGMENT) & (gap >= MARGIN / 2) & (two[:, 0] < 0.8 * PROFILE)
            votes = np.zeros((n, len(self.langs)))
            np.add.at(votes, (rec[voting], best[voting]), x[voting])
            weak = ~votes.any(1)
            if weak.any():  # only short or doubtful segments: the smallest summed distance
                sums = np.full((n, len(self.langs)), 0.0)
                np.add.at(sums, rec, np.where(own[None, :], dist * x[:, None], 0))
                some = np.bincount(rec, x, n)
                low = np.where(own[None, :], sums, np.inf).argmin(1)
                use = weak & (some > 0)
                votes[use, low[use]] = 1
            main = votes.argmax(1)
            near = d[np.arange(len(rec)), main[rec]] - d[np.arange(len(rec)), best]
            own_lang = np.where(voting & (near >= FOREIGN_MARGIN), best, main[rec])
            lang[:, j] = np.where(x > 0, own_lang, -1)
            margin[:, j] = np.where(own_lang == best, gap, 0)
            use = x > 0
            np.add.at(total, (rec[use], own_lang[use]), x[use])
            np.add.at(sure, (rec[use], own_lang[use]), x[use] * np.minimum(1.0, (np.where(own_lang == best, gap, 0)[use] + MARGIN) / (5 * MARGIN)))
        s |= {"lang": lang, "margin": margin, "east": east}
        return total, sure / np.maximum(total.sum(1), 1)[:, None], s


# Encodings used by mistake, and those of whole texts in other scripts that they stood for.
READ_AS, WRITTEN_IN = ("cp1252", "latin-1", "cp437", "mac_roman", "cp850", "cp1251"), ("utf-8", "cp1251", "koi8_u", "cp1253", "cp1256", "cp874", "shift_jis", "euc_kr", "gb18030", "big5")


def readable(text: str, again: int = 2) -> str | None:
    """A wholly garbled text with its encoding undone, as far as it can be; None if no encoding fits.

    An encoding fits if it loses few of the bytes and most letters come out in one
    script other than Latin; of several the one with the most small or
    caseless letters, UTF-8 before all.
    """
    script_of = tables()[0]
    best: tuple[float, str] | None = None
    for wrong in READ_AS:
        raw = bytearray()
        bad = 0
        for c in text:
            try:
                raw += c.encode(wrong)
            except UnicodeEncodeError:
                if "\x80" <= c <= "\x9f":
                    raw.append(ord(c))
                else:
                    bad += 1
        if bad > 0.1 * len(text):
            continue
        for right in WRITTEN_IN:
            if right == wrong:
                continue
            out = bytes(raw).decode(right, "ignore")
            # a lost byte takes its whole character along in UTF-8
            if len(out.encode(right, "ignore")) < (0.6 if right == "utf-8" else 0.9) * len(raw):
                continue
            if again and right == "utf-8" and sum(c in "ÃÂÐÑÎÏØÙâãåæçäéèêëìíïà" for c in out) > 0.1 * len(out):
                deeper = readable(out, again - 1)
                if deeper:
                    return deeper
            k = np.bincount(script_of[np.frombuffer(out.encode("utf-32-le"), np.uint32)], minlength=len(SCRIPTS))[1:]
            if not k.sum() or k[1:].max() + (k[SCRIPTS.index("Han") - 1] if k[1:].argmax() + 1 == SCRIPTS.index("Japanese") - 1 else 0) < 0.6 * k.sum() or k[0] > 0.1 * k.sum():
                continue
            if right == "utf-8":
                return out
            small = sum(c.isalpha() and not c.isupper() for c in out) / len(text)
            common = sum("\u3040" <= c <= "\u30ff" or "\uac00" <= c <= "\ud7a3" for c in out) - sum("\uff61" <= c <= "\uff9f" for c in out)
            if right in ("cp1251", "koi8_u", "cp1253", "cp1256") and k.sum() < 0.8 * len("".join(out.split())):
                continue  # signs among the letters
            if right == "cp874":  # Thai signs above and below stand on consonants or one another
                signs = [i for i, c in enumerate(out) if c == "\u0e31" or "\u0e34" <= c <= "\u0e3a" or "\u0e47" <= c <= "\u0e4e"]
                if sum(i > 0 and ("\u0e01" <= out[i - 1] <= "\u0e2e" or "\u0e31" <= out[i - 1] <= "\u0e4e") for i in signs) < 0.9 * len(signs):
                    continue
            if right == "euc_kr" and k[SCRIPTS.index("Hangul") - 1] < 0.95 * k.sum():
                continue
            score = small + common / max(1, len(out))
            if best is None or score > best[0]:
                best = (score, out)
    return best[1] if best else None


def train(rows: list[tuple[str, str]], scripts: dict[str, str]) -> Profiles:
    """Profiles from (language, text) rows; ``scripts``: the script of each language."""
    shared = {s for s in ("Latin", "Cyrillic")}
    singles = {}
    for lang, s in scripts.items():
        if s not in shared and s in SCRIPTS and s not in ("Han", "Japanese"):
            singles[s] = lang
    singles |= {s: lang for lang, s in scripts.items() if s in ("Han", "Japanese")}
    lines = [(lang, line) for lang, t in rows if scripts.get(lang) in shared for line in t.split("\n") if len(line) > 60]

    def profiles(own: list[tuple[str, str]]) -> Profiles:
        langs, grams = [], []
        for lang in sorted({x for x, _ in own}):
            code = tables()[1][np.frombuffer("\n".join(t for x, t in own if x == lang).encode("utf-32-le", "surrogatepass"), np.uint32)]
            g, k = np.unique(np.concatenate([x[x >= 0] for x in ngram_codes(code)]), return_counts=True)
            if len(g):
                langs.append(lang)
                grams.append(g[np.lexsort((g, -k))[:PROFILE]])
        return Profiles(langs, [scripts[x] for x in langs], grams, singles)

    while lines:  # labels without a language of their own: their lines are as near to the other profiles
        p = profiles(lines)
        lines = [x for x in lines if x[0] in p.langs]  # lines without a letter of their script make no profile
        if not lines:
            break
        near: dict[str, list] = {x: [] for x in p.langs}
        for k in range(0, len(lines), 2000):
            part = lines[k : k + 2000]
            d = p.line_distances([t for _, t in part])
            for (lang, _), row in zip(part, d):
                j = p.langs.index(lang)
                near[lang].append((row[j], np.delete(row, j).min() if len(row) > 1 else PROFILE))
        gap = {x: np.median([b - a for a, b in v]) for x, v in near.items()}
        worst = min(gap, key=lambda x: gap[x])
        if gap[worst] >= OWN_GAP:
            break
        lines = [x for x in lines if x[0] != worst]
    if lines:
        kept = []
        for k in range(0, len(lines), 2000):
            part = lines[k : k + 2000]
            kept += [x for x, row in zip(part, p.line_distances([t for _, t in part])) if p.langs[row.argmin()] == x[0]]
        lines = kept
    return profiles(lines)


def labels(df: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    """Adds ``labelled``: the language that ``label`` spells, null where it is no listed spelling.

    The list of spellings is a small fixed table, one row for each spelling.
    """
    c = codes.groupBy("spelling").agg(F.min("lang_code").alias("labelled"))
    return df.join(c, F.col(label) == F.col("spelling"), "left").drop("spelling")


def fit(documents: DataFrame, codes: DataFrame, per_label: int = PER_LABEL) -> Profiles:
    """Profiles from a bounded sample: about ``per_label`` documents of each label of at most SAMPLE_CHARS characters, at most twice as many in all."""
    scripts = {r.lang_code: r.script for r in codes.select("lang_code", "script").distinct().collect()}
    known = labels(documents.where("text <> ''").where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "lang"), codes, "lang").where("labelled is not null")
    sizes = known.groupBy("labelled").agg(F.count("*").alias("n")).collect()  # one row for each listed language
    if not sizes:
        return train([], scripts)
    n = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.labelled, r.n)]), F.col("labelled"))
    pick = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * n < F.lit(per_label << 20))
    rows = pick.select("doc_id", "labelled", "text").limit(2 * per_label * max(1, len(scripts))).collect()
    return train([(r.labelled, r.text) for r in sorted(rows, key=lambda r: r.doc_id)], scripts)


_RUN = re.compile(r"([^\W\d_])\1{7,}")


def _with_runs(texts: list[str]) -> list[int]:
    """Which texts hold some letter eight times in a row; one look at all of them."""
    cp = np.frombuffer("\x01".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    same = np.flatnonzero(cp[1:] == cp[:-1])
    at = same[:-6][same[6:] - same[:-6] == 6]
    if not len(at):
        return []
    letter = [c for c in np.unique(cp[at]).tolist() if _RUN.match(chr(c) * 8)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.unique(np.searchsorted(ends, at[np.isin(cp[at], letter)], side="right")).tolist()


def _without_runs(text: str) -> str:
    """Blanks for runs of one letter, which are in no language, if other letters remain."""
    t = _RUN.sub(lambda m: " " * len(m.group()), text)
    return t if t is text or any(c.isalpha() for c in t) else text


_SCHEMA = "rec_kind string, rec_id string, labelled string, source string, copy bigint, letters bigint, langs array<struct<lang:string,letters:bigint,confidence:double>>, foreign array<struct<lang:string,letters:bigint,line:string>>"


def identified(df: DataFrame, profiles: Profiles) -> DataFrame:
    """rows (rec_kind, rec_id, labelled, source, text) -> languages of each record, and its foreign lines.

    ``copy`` is the hash of the text, the same for all copies.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    kind = pa.struct([("lang", pa.string()), ("letters", pa.int64()), ("confidence", pa.float64())])
    part_kind = pa.struct([("lang", pa.string()), ("letters", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.prepare()
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                part = batch.slice(k, 400)
                texts = [t or "" for t in part.column(5).to_pylist()]
                for r in _with_runs(texts):
                    texts[r] = _without_runs(texts[r])
                total, sure, s = p.classify(texts)
                lost = np.bincount(s["rec"], s["lost"], len(texts))
                spoilt = np.flatnonzero(lost > total.sum(1))
                if len(spoilt):
                    total[spoilt], sure[spoilt], _ = p.classify([readable(texts[r]) or "" for r in spoilt])
                    s["lang"][np.isin(s["rec"], spoilt)] = -1
                letters = total.sum(1).astype(int)
                langs = [[{"lang": p.names[j], "letters": int(t[j]), "confidence": round(float(c[j]), 6)} for j in np.argsort(-t, kind="stable") if t[j] > 0] for t, c in zip(total, sure)]
                foreign = [[] for _ in texts]
                main = total.argmax(1)
                for j, script in enumerate(("Latin", "Cyrillic")):
                    x = s["letters"][:, SCRIPTS.index(script)]
                    for q in np.flatnonzero((s["lang"][:, j] >= 0) & (s["lang"][:, j] != main[s["rec"]]) & (x > 0)):
                        r = s["rec"][q]
                        a = s["joined"].rfind("\n", s["start"][r], s["first"][q] + 1) + 1 or s["start"][r]
                        b = s["joined"].find("\n", s["first"][q] + 1, s["start"][r] + len(texts[r]))
                        line = texts[r][max(a - s["start"][r], 0) : b - s["start"][r] if b >= 0 else None]
                        foreign[r].append({"lang": p.langs[s["lang"][q, j]], "letters": int(x[q]), "line": line})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(5)), pa.array(letters, pa.int64()), pa.array(langs, pa.list_(kind)), pa.array(foreign, pa.list_(part_kind))], names=["rec_kind", "rec_id", "labelled", "source", "copy", "letters", "langs", "foreign"])

    return df.select("rec_kind", "rec_id", "labelled", "source", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, _SCHEMA)


def segments(df: DataFrame, profiles: Profiles) -> DataFrame:
    """rows (rec_kind, rec_id, text) -> (rec_kind, rec_id, start, stop, lang, confidence): the passages of each record.

    A passage is a run of neighbouring segments of one language; ``start`` and ``stop``
    are code points, half-open, and the passages of a record cover its text. Segments
    without letters go with what is before them. The confidence is the share of a
    passage's letters weighted by how much nearer the language is than the next one.
    Null and empty texts and texts without letters have no passage; a text that is garbled for
    the most part has none either.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.prepare()
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                part = batch.slice(k, 400)
                rows = p.passages_of([t or "" for t in part.column(2).to_pylist()])
                at = pa.array(rows["rec"], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(rows["start"], pa.int32()), pa.array(rows["stop"], pa.int32()), pa.array(rows["lang"], pa.string()), pa.array(rows["confidence"], pa.float64())], names=["rec_kind", "rec_id", "start", "stop", "lang", "confidence"])

    return df.where("text <> ''").select("rec_kind", "rec_id", "text").mapInArrow(run, "rec_kind string, rec_id string, start int, stop int, lang string, confidence double")


def site_lines(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of the lines (source, key) that stand in a tenth of their source's documents, three at least, by the keys of problem 7.

    All lines of the documents count, foreign there or not; copies of a text count once.
    """
    own = documents.where("source is not null and text <> ''").select("source", "text", F.xxhash64("text").alias("copy"))
    sizes = own.select("source", "copy").distinct().groupBy("source").agg(F.count("*").alias("n_source"))
    lines = own.select("source", "copy", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("source", "copy", sitelines.line_key(F.col("line")).alias("key")).where("key is not null")
    counts = lines.join(wanted, ["source", "key"], "left_semi").distinct().groupBy("source", "key").agg(F.count("*").alias("n"))
    over = (F.col("n") >= sitelines.MIN_DOCS) & (F.col("n") >= F.col("n_source") * F.lit(sitelines.MIN_SHARE))
    return counts.where(F.col("n") >= sitelines.MIN_DOCS).join(sizes, "source").where(over).select("source", "key")


def without_site_lines(found: DataFrame, documents: DataFrame, singles: list[str]) -> DataFrame:
    """(rec_kind, rec_id, lang, letters, confidence, main): languages of each record, site lines of documents left out."""
    f = found.where("rec_kind = 'document' and source is not null and size(foreign) > 0").select("rec_id", "source", F.explode("foreign").alias("f"))
    f = f.select("rec_id", "source", "f.lang", "f.letters", sitelines.line_key(F.col("f.line")).alias("key")).where("key is not null")
    site = site_lines(f.select("source", "key").distinct(), documents)
    minus = f.join(site, ["source", "key"], "left_semi").groupBy("rec_id", "lang").agg(F.sum("letters").alias("minus")).withColumn("rec_kind", F.lit("document"))
    rows = found.select("rec_kind", "rec_id", "labelled", F.col("letters").alias("all_letters"), F.posexplode("langs").alias("pos", "l")).select("rec_kind", "rec_id", "labelled", "all_letters", (F.col("pos") == 0).alias("main"), "l.*")
    return rows.join(minus, ["rec_kind", "rec_id", "lang"], "left").withColumn("letters", F.col("letters") - F.coalesce("minus", F.lit(0))).drop("minus").where(F.col("main") | (F.col("letters") >= F.when(F.col("lang").isin(singles), MIN_OTHER_SCRIPT).otherwise(MIN_FOREIGN)))


def records(documents: DataFrame, zones: DataFrame, codes: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, labelled, source, text) of documents and of current zones with tag p, title or fn."""
    d = documents.select(F.lit("document").alias("rec_kind"), F.col("doc_id").cast("string").alias("rec_id"), F.col("lang").alias("label"), "source", "text").where("text <> ''")
    z = zones.where("tag in ('p', 'title', 'fn')").withColumn("label", F.col("attributes")["lang"])
    z = current_zones(z, "tag", "label", "text").where("text <> ''").select(F.lit("zone").alias("rec_kind"), F.col("zone_id").alias("rec_id"), "label", F.lit(None).cast("string").alias("source"), "text")
    return labels(d.unionByName(z), codes, "label").drop("label")


def languages(documents: DataFrame, zones: DataFrame, codes: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, lang, letters, confidence, main, labelled): every language of every record."""
    p = fit(documents, codes)
    found = staged(identified(records(documents, zones, codes), p), "languages")
    return without_site_lines(found, documents, sorted(set(p.singles.values()))).where(F.col("all_letters") >= MIN_LETTERS)


def cases(rows: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, lang) of the records whose label is missing or wrong or that are in two languages."""
    own = rows.groupBy("rec_kind", "rec_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("lang") == F.col("labelled"), F.lit(False))).alias("right"))
    hit = own.where("n > 1 or not right").select("rec_kind", "rec_id")
    return rows.join(hit, ["rec_kind", "rec_id"], "left_semi").select("rec_kind", "rec_id", "lang").distinct()


def found(documents: DataFrame, zones: DataFrame, codes: DataFrame) -> DataFrame:
    return cases(languages(documents, zones, codes))
