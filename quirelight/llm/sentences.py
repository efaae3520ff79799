"""Problem 6: sentence boundaries across languages and scripts.

A *flow* is the text of one paragraph or heading, its lines joined, furniture and
notices left out; every end is mapped back to the stored text of its line or zone.

*Spaced scripts*: the terminators of a flow, each together with the quotes and brackets that
close after it, are the nodes of a lattice, its edges the possible sentences between
two of them; the best path makes the ends. A node's weight is the log odds that a sentence
ends there: signs that settle it (a small letter, an opening word, a closing quote
and the speaking clause after it) weigh ``SURE``, seeds (``NEVER``, ``MAY``, ``MONTHS``) as much,
and any other word before a point weighs by the corpus: how often it stands with its
point before a small letter, and how often before a capital (``Dots``). Weights depend on where the
sentence began, so near predecessors are tried one by one. A sentence needs a letter or digit.

*Spaceless scripts* (Chinese, Japanese, Thai): a dictionary is counted from the corpus by
accessor variety (how many different neighbours a string has on its poorer side), and the
word lattice of a run of letters is solved for the path of the highest weight (``Words``).
Over the whole corpus the words before and after each gap are counted, at gaps with a blank or mark and in
all. Chinese and Japanese end at their own marks; after a closed quote the sentence goes on before a particle, a
speaking clause (seeds: ``_SPOKEN``) or words that the corpus never opens a sentence with. Thai ends where a blank follows. Where a line
break hides whether there was a blank, the gap ends a sentence if no word of the
lattice spans it and its final and opening words stand there oftener at ends than inside.

Bounds: ``DICTIONARY`` words and ``FORMS`` dotted forms, the most frequent of
the whole corpus, are all that is broadcast; rarer ones count as unknown.

Defined cases: null and empty texts hold no sentence; the end of a flow ends one
even without a mark; a flow without letters or digits holds none; repeated rows
count once; of zones only the current row counts, wrongly decoded ones are left
out; lines of furniture and notices hold no ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm import mojibake, scanfix
from quirelight.runtime import staged

# Fixed values, seeds: abbreviations that a sentence doesn't end with.
NEVER = set(
    "dr mr mrs ms messrs prof st co no nos vol vols p pp fig figs sect sec ch chap cf vs viz approx ca al ed eds rev hon jr gen col capt lt "
    "bd bde s abb nr vgl hrsg bzw ggf evtl zzgl inkl frl hr "
    "mme mlle mm env éd art "
    "sr sra srta dra pág págs aprox núm d dña cap "
    "sig dott ing pag pagg cfr "
    "mevr dhr dl blz afb bijv "
    "zob por rys tab ok tj np dz t "
    "проф см ср рис табл гл стр с т е акад им др див пор напр "
    "βλ τόμ σελ σ εικ περ δηλ κ κα δρ πρβλ "
    "ج ص د "
    "डॉ पृ श्री प्रो "
    "i.e e.g c.-à-d d.h z.b d.w.z o.a m.in u.a v.a п.а т.е п.э sig.ra dott.ssa p.ex z h u v w".split()
)
# Fixed values, seeds: abbreviations that may end one.
MAY = set("etc usw ecc enz itd itp др пр тд д г р r م إلخ р.х н.э μ.χ π.χ κ.λπ p.m a.m m.e.z inc ltd bros esq".split())
YEARS = {"г", "р", "r"}
# Month names that a day number with a point comes before.
MONTHS = set("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Verbs of speaking clauses.
SPEAKS = set("said says asked asks shouted cried replied answered whispered called exclaimed murmured wrote added".split())

_TERM = re.compile(r"[.!?…。！？।॥؟．｡]+|;(?=[»”\"’)]*(?:\s|$))|;")
_CLOSE = "”’»\"')]}」』）】›"
_OPEN_TOO = "“‘"
_THAI_BLANK = re.compile(r"([ก-๛][”\"’)]*)[  ]+")
_THAI = re.compile("[ก-๛]")
_SPACED_CLOSE = re.compile(r"[   ]»")
_TOKEN = re.compile(r"[^\s(\[«“„‚‘\"¿¡—–…,;:!?]+$")
_INITIAL = re.compile(r"[A-ZА-ЯЁІЇЄҐΑ-Ω]\.")
_SPEECH = re.compile(r"[A-ZÀ-ÖØ-Þ][\w’-]+ (?:[A-Z][\w’-]+ )?(\w+)")
_QUOTES = "”»“’\"‘」』›"
_STOPS = r"。！？…，、；：,.!?;:।॥؟،؛“”«»「」『』\""
_W = rf"[^\s{_STOPS}]+"
_HERE = r"\s*(?:[。！？…，、；,.!?;।॥؟،؛]|$)"
_C = rf"[^\s{_STOPS}]"
# What follows a closed quotation that its sentence goes on after, by script: speaking clauses, and particles that begin no sentence.
_SPOKEN = [
    (
        re.compile(r"[぀-ヿ㐀-鿿]"),
        re.compile(
            rf"(?!{_C}*(?:[没沒]有?人|[没沒]有?[说說问問]|不[说說问問])){_C}{{0,16}}(?:(?<![小传傳学學据據听聽])[说說]|(?<![学學顾顧疑访訪质質])[问問]|[说說问問喊叫写寫答喝笑骂罵叹嘆嚷][道着著]|回答|[喊嚷]|大叫)[了道]?(?:[他她它我你您][们們]?|大家|一[句声聲])?{_HERE}"
            rf"|[他她我你您][们們]?{_C}{{0,4}}[问問](?![题題世]){_C}{{1,8}}{_HERE}"
            r"|的|一[词詞句声聲](?=[^一])|[这這]一?[句话話]"
            r"|と(?!ても|ころ|き[はにの、]|きどき|なり|にかく|もかく|うとう|もに|ある|たん|りあえず|っくに)|って|を|(?:では|には)|[のはがにでもへや](?=[一-鿿ァ-ヴ々])|は、|など"
            rf"|(?!{_C}*を){_C}{{1,14}}[はがも]{_C}{{0,10}}(?:言った|言いました|言う|尋ねた|尋ねました|たずねた|聞いた|聞きました|訊いた|問いかけた|問うた|叫んだ|叫びました|答えた|答えました|つぶやいた|呟いた|ささやいた|囁いた){_HERE}"
        ),
    ),
    (
        re.compile(r"[가-힣]"),
        re.compile(rf"(?:이?라고|하고|하며|하면서|이?라며|이?라면서)(?![가-힣])|(?!(?:{_W} )*?{_W}(?:[을를]|[다냐라자]고) )(?:{_W} ){{1,6}}(?:물었|되물었|말했|대답했|답했|외쳤|소리쳤|속삭였|덧붙였|중얼거렸)(?:다|습니다|어요){_HERE}"),
    ),
    (
        re.compile(r"[ऀ-ॿ]"),
        re.compile(
            rf"(?:{_W} ){{0,4}}(?:{_W})?ने (?:{_W} ){{0,6}}(?:कहा|पूछा|(?:उत्तर|जवाब) दिया|पुकारा|दोहराया)(?: था| है)?{_HERE}"
            rf"|(?:{_W} ){{1,5}}(?:बोला|बोली|बोले|चिल्लाया|चिल्लाई|चिल्लाए|फुसफुसाया|फुसफुसाई){_HERE}|(?:का|की|के|को|में|से|नामक|वाला|वाली|वाले) "
        ),
    ),
    (
        re.compile(r"[؀-ۿ]"),
        re.compile(rf"(?!{_W}(?: {_W})*? (?:إن|أن|إنه|إنها|أنه|أنها|بأن|عن|هل|كيف|متى|لماذا) )(?:قال|سأل|أجاب|صاح|هتف|همس|صرخ|رد|أضاف|تساءل)(?:ت|وا)?(?: {_W}){{0,7}}{_HERE}"),
    ),
    (
        re.compile(r"[א-ת]"),
        re.compile(rf"(?!{_W}(?: {_W})*? (?:כי|על|אם) )(?:(?:הוא|היא|הם) )?(?:אמר|אמרה|אמרו|שאל|שאלה|ענה|ענתה|השיב|השיבה|צעק|צעקה|לחש|לחשה|הוסיף|הוסיפה)(?: {_W}){{0,7}}{_HERE}"),
    ),
    (re.compile(r"[ก-๛]"), re.compile(r"[ก-๛]{0,24}?(?<!คำ)(?:ถาม|กล่าว|พูด|ตอบ|ตะโกน|เอ่ย|กระซิบ)(?!ว่า|สนอง|แทน|ถึง)")),
]
_EAST = re.compile(r"[぀-ヿ㐀-鿿]")
_LATE = re.compile(r"[\wऀ-ॿ฀-๛]")


def _uncased(ch: str) -> bool:
    return ch.isalpha() and not ch.isupper() and not ch.islower() or "ก" <= ch <= "๛"


def _after_close(s: str, e: int) -> int:
    """Position after the quotes and brackets that close at ``e``."""
    n = len(s)
    while e < n:
        c = s[e]
        if c in _CLOSE or c in _OPEN_TOO and (e + 1 == n or s[e + 1].isspace() or s[e + 1] in ",.;:)”»"):
            e += 1
        elif _SPACED_CLOSE.match(s, e):
            e += 2
        else:
            break
    return e


def _speaking(rest: str) -> bool:
    m = _SPEECH.match(rest)
    return bool(m) and m.group(1) in SPEAKS


def _carried(s: str, k: int, spaced: bool, words: Words | None = None) -> bool:
    """Whether the sentence that carries a quotation goes on after it, at the caseless letter ``k``."""
    if "가" <= s[k] <= "힣" and not spaced:
        return True
    for script, goes_on in _SPOKEN:
        if script.match(s, k):
            rest = s[k : k + 160]
            if goes_on.match(rest.replace("\n", "") if script is _SPOKEN[0][0] else re.sub(r"\s+", " ", rest)):
                return True
            return words is not None and script is _SPOKEN[0][0] and words.never_opens(s[k : k + 40])
    return False


def _aside(s: str, last: int, e: int) -> bool:
    """Whether the bracket that closes at ``e`` was opened inside the sentence from ``last``."""
    at = max(s.rfind(c, last, e) for c in "(（[")
    return at > last and bool(_LATE.search(s, last, at))


def _dash(s: str, k: int) -> str | None:
    """The first character after a dash at ``k``, None if there is no dash."""
    if s[k] not in "—–-":
        return None
    while k < len(s) and (s[k] in "—–-" or s[k].isspace()):
        k += 1
    return s[k] if k < len(s) else ""


#: Weight of a sign that settles a terminator; how far back another end changes the reading of one.
SURE, NEAR = 6.0, 40


def ends(s: str, words: Words | None = None, dots: dict | None = None) -> list[int]:
    """End offsets of the sentences of a flow, the best path through its terminators; line breaks are blanks."""
    stop = len(s.rstrip())
    found = [(m.start(), m.end(), m.group()) for m in _TERM.finditer(s)]
    if not s.isascii() and _THAI.search(s):
        found += [(m.end(1), m.end(1), "") for m in _THAI_BLANK.finditer(s)]
        for m in re.finditer(r"(?<=[ก-๛0-9])\n(?=[ก-๛])", s):
            if words and words.gap_ends(s[: m.start()], s[m.end() :]):
                found.append((m.start(), m.start(), ""))
        found.sort()
    at, best, back = [0], [0.0], [0]  # nodes: the place where a sentence may end, the weight of the best path to it, and the node before
    top = 0  # the node with the best path so far
    for i, e, t in found:
        j = _after_close(s, e)
        k = j
        while k < stop and s[k].isspace():
            k += 1
        near = [top]
        p = len(at) - 1
        while p >= 0 and at[p] >= i - NEAR:
            if p != top:
                near.append(p)
            p -= 1
        choice = None
        for p in near:
            last = at[p]
            if j > last and _LATE.search(s, last, j):
                value = best[p] + (SURE if not t or k >= stop else _weight(s, last, i, e, t, j, k, words, dots))
                if choice is None or value > choice:
                    choice, pick = value, p
        if choice is not None:
            at.append(min(j, stop))
            best.append(choice)
            back.append(pick)
            if choice > best[top]:
                top = len(at) - 1
    out: list[int] = []
    n = top
    while n:
        out.append(at[n])
        n = back[n]
    out.reverse()
    last = out[-1] if out else 0
    if last < stop and _LATE.search(s, last, stop):
        out.append(stop)
    return out


def _weight(s: str, last: int, i: int, e: int, t: str, j: int, k: int, words: Words | None, dots: dict | None) -> float:
    """The log odds that the sentence from ``last`` ends at a terminator."""
    v = _ends_here(s, last, i, e, t, j, k, words)
    if v is not None:
        return SURE if v else -SURE
    m = _TOKEN.search(s, max(last, i - 40), i)
    low, up = dots.get(m.group().lower(), (0, 0)) if dots and m else (0, 0)
    return max(-SURE, min(SURE, log((up + 1) / (DOT_RATIO * low + 0.01))))


def _ends_here(s: str, last: int, i: int, e: int, t: str, j: int, k: int, words: Words | None) -> bool | None:
    """What the signs around a terminator and the seeds say; None where the word before a point decides."""
    nxt, closed, spaced = s[k], j > e, k > j
    east = t[-1] in "。！？｡．" or t[0] == "…" and (i and _EAST.match(s[i - 1]) is not None)
    if nxt in "。！？!?.…" and not spaced:
        return False
    quoted = closed and any(c in _QUOTES for c in s[e:j])
    if east:
        if quoted and _uncased(nxt) and _carried(s, k, spaced, words):
            return False
        if closed and not quoted and (nxt == "と" or t[-1] in "！？" and (nxt.isalpha() or nxt.isdigit()) and _aside(s, last, e)):
            return False
        return not (nxt.islower() and nxt.isascii() and t[-1] != "。") and nxt not in "，、,"
    if t[-1] in "।॥":
        return not (quoted and _uncased(nxt) and _carried(s, k, spaced, words))
    if t in (";", ";"):
        greek = i and "Ͱ" <= s[i - 1] <= "Ͽ"
        return bool(greek) and not nxt.islower() and (t == ";" or closed or not nxt.islower())
    after = _dash(s, k)
    if after is not None:
        nxt = after or nxt
        if after and (after.islower() or not spaced and not closed):
            return False
    if nxt.islower() or nxt in ",;:)؛،":
        return False
    if quoted and _uncased(nxt):
        return not _carried(s, s.index(nxt, k), spaced, words)
    if t[-1] != ".":
        if t[-1] == "…" and not spaced and not closed:
            return nxt.isupper()
        if quoted:
            return not (nxt.isupper() and _speaking(s[k : k + 80]))
        return True
    if not spaced and not closed:
        if not (nxt.isupper() or _uncased(nxt)):
            return False
        m = _TOKEN.search(s, max(last, i - 40), i)
        w = m.group() if m else ""
        if "." in w and w.lower() not in MAY or "/" in w or "@" in w or len(w) < 2:
            return False
        return w.lower() not in NEVER and not s[i - 1].isupper()
    m = _TOKEN.search(s, max(last, i - 40), i)
    w = m.group() if m else ""
    low = w.lower()
    if closed and s[e] in ")]":
        return True
    if len(w) == 1 and w.isupper() and not closed:
        return False
    if low in MAY and not closed:
        if low in YEARS and (_INITIAL.match(s, k) or len(s[last:i].split()) <= 3):
            return False
        return not nxt.isdigit() or low not in YEARS
    if low in NEVER and not closed:
        return False
    if "." in low and low.replace(".", "").isalpha() and max(map(len, low.split("."))) <= 2 and not closed:
        return False
    if "." in w and not closed and w.rpartition(".")[2].lower() in NEVER and len(w.rpartition(".")[2]) > 1:
        return False
    if w.isdigit() and len(w) <= 2 and nxt.isupper() and re.match(r"\w+", s[k : k + 20]).group() in MONTHS:
        return False
    return True if closed or not w.isalpha() or not nxt.isupper() else None


#: Words of the dictionary, dotted forms, longest word by script, and least variety of a word.
DICTIONARY, FORMS, MAX_THAI, MAX_EAST, VARIETY = 65_536, 65_536, 8, 4, 3
#: How much more a small letter after a point says than a capital.
DOT_RATIO = 4.0
_RUN = re.compile(r"(?P<thai>[ก-๛][ก-๛9]*)|[々〆ぁ-ヿ㐀-鿿]+")
_CLUSTER = re.compile("[เ-ไ]*[ก-ฯ]?[ะ-ฺๅ-๎]*|.")
_OPENED = "([«“„‚‘\"¿¡—–…"
#: Letters of the words beside a gap that it is judged by.
UNIT = 4


def _spaceless(text: str) -> str:
    """The text with numbers as one digit each, so that any number is the same word."""
    return re.sub(r"[0-9]+(?:[.,][0-9]+)*", "9", text)


class Words:
    """Words of spaceless scripts, and how often their last and first ones stand at gaps that end a sentence.

    ``finals``: the words before a gap (as many as make up UNIT letters) -> (gaps in all, gaps that end a
    sentence); ``openings``: the words after a gap likewise.
    """

    def __init__(self, weights: dict[str, float], finals: dict | None = None, openings: dict | None = None):
        self.weights, self.cache = weights, {}
        self.finals, self.openings = finals or {}, openings or {}
        self.gaps, self.ends = (1 + sum(c[k] for c in self.finals.values()) for k in range(2))

    def path(self, run: str) -> list[str]:
        """The words of a run of letters: the path of the highest weight through its lattice."""
        if run not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[run] = self._path(run)
        return self.cache[run]

    def _path(self, run: str) -> list[str]:
        thai = "ก" <= run[0] <= "๛"
        n, longest, get = len(run), MAX_THAI if thai else MAX_EAST, self.weights.get
        # words begin and end between clusters of a consonant and its vowels and signs
        at = [m.start() for m in _CLUSTER.finditer(run)] + [n] if thai else range(n + 1)
        best: dict[int, float] = dict.fromkeys(at, -1.0)
        step = {}
        best[0] = 0.0
        for k, i in enumerate(at[:-1]):
            here, nxt = best[i], at[k + 1]
            if here > best[nxt]:
                best[nxt], step[nxt] = here, i
            for j in at[k + 1 : k + 1 + longest]:
                if j - i > longest:
                    break
                w = get(run[i:j])
                if w is not None and here + w > best[j]:
                    best[j], step[j] = here + w, i
        out = []
        while n:
            out.append(run[step[n] : n])
            n = step[n]
        return out[::-1]

    @staticmethod
    def before(path: list[str], k: int) -> str:
        """The words before the gap k of a path, UNIT letters or a little more."""
        out = ""
        while k and len(out) < UNIT:
            k -= 1
            out = path[k] + out
        return out

    @staticmethod
    def after(path: list[str], k: int) -> str:
        out = ""
        while k < len(path) and len(out) < UNIT:
            out += path[k]
            k += 1
        return out

    def gap_ends(self, left: str, right: str) -> bool:
        """Whether a sentence ends at a gap between two runs of Thai: no word spans it, and the words beside it stand oftener at ends than inside."""
        a = re.search(r"[ก-๛9]*$", _spaceless(left[-60:].replace("\n", ""))).group()
        b = re.match(r"[ก-๛9]*", _spaceless(right[:60].replace("\n", ""))).group()
        if not a or not b:
            return False
        path = self.path(a + b)
        places = {0: 0}
        for k, w in enumerate(path, 1):
            places[next(reversed(places)) + len(w)] = k
        if len(a) not in places:
            return False
        k = places[len(a)]
        n, e = self.finals.get(self.before(path, k), (0, 0))
        m, o = self.openings.get(self.after(path, k), (0, 0))
        inside = 1 + self.gaps - self.ends
        odds = log((e + 0.5) / self.ends) - log((n - e + 0.5) / inside) + log((o + 0.5) / self.ends) - log((m - o + 0.5) / inside)
        return odds + log(self.ends / inside) > 0

    def never_opens(self, text: str) -> bool:
        """Whether the first words of a text are known ones that open no sentence of the corpus."""
        m = _RUN.match(_spaceless(text))
        n, o = self.openings.get(self.after(self.path(m.group()), 0), (0, 0)) if m else (0, 0)
        return n >= 50 and o == 0


def _batches_of(cols: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=names)


def learn_words(texts: DataFrame) -> Words:
    """The dictionary and its counts over (text, whole): whether the text's own ends are known to be ends of what was written.

    Two passes over the texts with spaceless letters: strings up to a word's length with the neighbours that they have,
    and the words beside the gaps of all lattices. At most DICTIONARY rows of each kind reach the driver.
    """
    some = texts.select("text", "whole").where(F.col("text").rlike("[ก-๛々-ヿ㐀-鿿]"))
    spark = texts.sparkSession

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: Counter = Counter()
        n: Counter = Counter()

        def rows():
            for run, k in runs.items():
                padded, longest = f"^{run}$", (MAX_THAI if "ก" <= run[0] <= "๛" else MAX_EAST) + 2
                for size in range(3, longest):
                    for i in range(len(padded) - size + 1):
                        n[padded[i : i + size]] += k
                if len(n) > 400_000:
                    yield _batches_of([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["s", "n"])
                    n.clear()
            runs.clear()
            yield _batches_of([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["s", "n"])
            n.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                runs.update(m.group() for m in _RUN.finditer(_spaceless(t)))
            if len(runs) > 100_000:
                yield from rows()
        yield from rows()

    seen = some.mapInArrow(strings, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    size = F.length("s")
    edge = lambda c: F.when(c.isin("^", "$"), F.col("n")).otherwise(F.lit(1))
    before = F.struct(F.expr("substring(s, 2)").alias("w"), edge(F.substring("s", 1, 1)).alias("left"), F.lit(0).cast("bigint").alias("right"))
    after = F.struct(F.expr("substring(s, 1, length(s) - 1)").alias("w"), F.lit(0).cast("bigint").alias("left"), edge(F.substring("s", -1, 1)).alias("right"))
    sides = seen.where(size >= 3).select(F.inline(F.array(before, after))).where(~F.col("w").rlike("[$^]"))
    variety = sides.groupBy("w").agg(F.sum("left").alias("left"), F.sum("right").alias("right")).select("w", F.least("left", "right").alias("v")).where(F.col("v") >= VARIETY)
    words = variety.where(~F.substring("w", 1, 1).rlike("[ะ-ฺๅ-๎]")).orderBy(F.desc(F.col("v") * F.length("w")), "w").limit(DICTIONARY).collect()
    plain = Words({r.w: len(r.w) * log(r.v) for r in words})
    shared = spark.sparkContext.broadcast(plain.weights)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, hits = Words(shared.value), Counter(), Counter()

        def rows():
            keys = list(n)
            yield _batches_of([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([hits[k] for k in keys], pa.int64())], ["opens", "w", "n", "hits"])
            n.clear()
            hits.clear()

        for batch in batches:
            for text, whole in zip(*(c.to_pylist() for c in batch.columns)):
                t = _spaceless(text)
                for m in _RUN.finditer(t):
                    path, thai = words.path(m.group()), m.group("thai") is not None
                    for k in range(1, len(path)):
                        n[False, words.before(path, k)] += 1
                        n[True, words.after(path, k)] += 1
                    left, right = t[: m.start()].rstrip(_QUOTES + _OPEN_TOO + "「『")[-1:] if not thai else t[m.start() - 1 : m.start()], t[m.end() : m.end() + 1]
                    if whole or right:
                        key = False, words.before(path, len(path))
                        n[key] += 1
                        hits[key] += right in ("", " ", "\xa0") if thai else right in ("", "。", "！", "？")
                    if whole or left:
                        key = True, words.after(path, 0)
                        n[key] += 1
                        hits[key] += left in ("", " ", "\xa0") if thai else left in ("", "。", "！", "？")
            if len(n) > 300_000:
                yield from rows()
        yield from rows()

    got = some.mapInArrow(places, "opens boolean, w string, n bigint, hits bigint").groupBy("opens", "w").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    finals, openings = ({r.w: (r.n, r.hits) for r in got.where(F.col("opens") == o).orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()} for o in (False, True))
    return Words(plain.weights, finals, openings)


def learn_dots(texts: DataFrame) -> dict[str, tuple[int, int]]:
    """Words that stand with a point before a small letter: (times before a small letter, before anything else)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, every = Counter(), Counter()

        def rows():
            keys = [(w, w.lstrip(_OPENED).lower()) for w in every]
            keys = [(w, k) for w, k in keys if k.isalpha()]
            yield _batches_of([pa.array([k for _, k in keys], pa.string()), pa.array([low[w] for w, _ in keys], pa.int64()), pa.array([every[w] - low[w] for w, _ in keys], pa.int64())], ["w", "low", "up"])
            low.clear()
            every.clear()

        for batch in batches:
            parts = "\x01 ".join(t for t in batch.column(0).to_pylist() if t).replace("\n", " ").replace("\xa0", " ").split(". ")
            words = [p[p.rfind(" ") + 1 :] for p in parts[:-1]]
            every.update(words)
            low.update(w for w, p in zip(words, parts[1:]) if p[:1].islower())
            if len(every) > 200_000:
                yield from rows()
        yield from rows()

    n = texts.select("text").mapInArrow(run, "w string, low bigint, up bigint").groupBy("w").agg(F.sum("low").alias("low"), F.sum("up").alias("up")).where("low > 0")
    return {r.w: (r.low, r.up) for r in n.orderBy(F.desc("low"), "w").limit(FORMS).collect()}


def flow_ends(pieces: list[tuple[str, str]], words: Words, dots: dict) -> Iterator[tuple[str, int]]:
    """(rec_id, end_pos) of a flow of (rec_id, text) pieces."""
    s = "\n".join(t for _, t in pieces)
    starts = np.cumsum([0, *(len(t) + 1 for _, t in pieces)])
    for e in ends(s, words, dots):
        k = int(np.searchsorted(starts, e, side="left")) - 1
        yield pieces[k][0], e - int(starts[k])


_OUT = "rec_kind string, rec_id string, end_pos int"


def _batch(kind: str, rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["rec_kind", "rec_id", "end_pos"])


def zone_ends(zones: DataFrame, kinds: DataFrame, words: Words, dots: dict, info: tuple | None) -> DataFrame:
    """Sentence ends of current zones with tag p; with ``info`` the wrongly decoded ones are left out."""
    texts = staged(scanfix.zone_texts(zones), "zones")
    furniture = scanfix.zone_furniture(texts, kinds)
    p = texts.where("tag = 'p'").select("zone_id", "text")
    shared = zones.sparkSession.sparkContext.broadcast((words, dots, info))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dots, info = shared.value
        fix = mojibake.Repair(*info) if info is not None else None
        for batch in batches:
            ids, texts, skips = (c.to_pylist() for c in batch.columns)
            wrong = set()
            if fix:
                some = [i for i, t in enumerate(texts) if not t.isascii()]
                wrong = {some[k] for k in fix.suspects([texts[i] for i in some]) if fix.text(texts[some[k]])[1]}
            rows: list[tuple[str, int]] = []
            for i, (z, t, skip) in enumerate(zip(ids, texts, skips)):
                if i in wrong:
                    continue
                if not skip:
                    rows += [(z, e) for e in ends(t, words, dots)]
                    continue
                lines = t.split("\n")
                at = np.cumsum([0, *(len(x) + 1 for x in lines)])
                kept = [(str(k), x) for k, x in enumerate(lines) if k not in skip]
                rows += [(z, int(at[int(k)]) + e) for k, e in flow_ends(kept, words, dots)]
            yield _batch("zone", rows)

    return p.join(furniture, "zone_id", "left").select("zone_id", "text", "skip").mapInArrow(run, _OUT)


def line_ends(kinds: DataFrame, words: Words, dots: dict) -> DataFrame:
    """Sentence ends in the lines of body text and headings.

    Lines come sorted within their document; a flow is given out when its paragraph
    or heading ends, so that a task holds one paragraph at a time.
    """
    ls = kinds.where("text <> ''").select("doc_id", "page", "block_no", "line_no", "line_id", "kind", "text")
    ordered = ls.repartition("doc_id").sortWithinPartitions("doc_id", "page", "block_no", "line_no", "line_id")
    shared = kinds.sparkSession.sparkContext.broadcast((words, dots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, dots), flow, before, rows, broken = shared.value, [], None, [], False
        for batch in batches:
            for doc, page, block, _, line, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind not in ("text", "heading"):
                    broken = True
                    continue
                here = (doc, kind, page, block)
                if before is not None and here != before and _parts(before, here, flow[-1][1], text, broken):
                    rows += flow_ends(flow, words, dots)
                    flow = []
                flow.append((str(line), text))
                before, broken = here, False
            yield _batch("line", rows)
            rows = []
        if flow:
            yield _batch("line", list(flow_ends(flow, words, dots)))

    return ordered.mapInArrow(run, _OUT)


def _parts(before: tuple, here: tuple, above: str, text: str, broken: bool) -> bool:
    """Whether a paragraph ends between two lines of different blocks.

    Furniture and notices between them (``broken``) may have cut one paragraph in
    two blocks, and so does a new page; then only a mark tells its end.
    """
    if before[:2] != here[:2]:
        return True
    if broken or before[2] != here[2] and before[1] != "heading":
        return False
    goes_on = text.lstrip()[:1].islower() or re.search(rf"[^\W\d_][{scanfix.MARKS}]\s*$", above)
    return before[1] == "heading" or not goes_on or bool(re.search(scanfix.FINISHED, above.strip()))


def sentence_ends(zones: DataFrame, lines: DataFrame, pdf_tokens: DataFrame | None = None) -> DataFrame:
    """(rec_kind, rec_id, end_pos) of every sentence end in zones with tag p and in body lines and headings."""
    both = zones.select("text", F.lit(True).alias("whole")).unionByName(lines.select("text", F.lit(False).alias("whole")))
    words, dots = learn_words(both), learn_dots(both)
    info = mojibake.table_of(mojibake.corpus(pdf_tokens, zones)) if pdf_tokens is not None else None
    kinds = staged(scanfix.line_kinds(lines), "kinds")
    return zone_ends(zones, kinds, words, dots, info).unionByName(line_ends(kinds, words, dots)).distinct()
