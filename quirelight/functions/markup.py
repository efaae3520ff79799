"""Inline markup: texts with tags, ranges of styles over plain text, and runs of one style.

Ranges are half-open code-point offsets into the plain text. A tagged text that is
cut, crossed or unbalanced still gives plain text and ranges; what was wrong is told
in ``issues``.
"""

from __future__ import annotations

import re
from collections import Counter
from html import escape, unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)[^<>]*?(/?)>")
#: Order of nesting, innermost first.
NESTING = ("sup", "sub", "smallcaps", "i", "italic", "b", "bold", "underline", "u", "strike", "s")

RANGE = "array<struct<start:int,stop:int,style:string>>"


def parse(tagged: str | None) -> tuple[str, list[tuple[int, int, str]], list[str]]:
    """(plain text, ranges, issues) of a tagged text.

    The tags of each name pair up among themselves, the innermost first, whatever lies
    between; two pairs of which each holds one tag of the other cross. A tag without a
    partner reaches to the end of the text (opening) or counts for nothing (closing).
    """
    tagged = tagged or ""
    cuts = [m for m in _TAG.finditer(tagged) if not m.group(3)]
    bounds = [0, *(p for m in cuts for p in m.span()), len(tagged)]
    texts = [unescape(re.sub(_TAG, "", tagged[a:b])) for a, b in zip(bounds[::2], bounds[1::2])]
    before = [0, *accumulate(map(len, texts))]
    waiting: dict[str, list[int]] = {}
    partner: dict[int, int] = {}
    lonely = []
    for k, m in enumerate(cuts):
        name = m.group(2)
        if not m.group(1):
            waiting.setdefault(name, []).append(k)
        elif waiting.get(name):
            partner[waiting[name].pop()] = k
        else:
            lonely.append(k)
    never = len(cuts)
    open_to = {**{k: never for ks in waiting.values() for k in ks}, **partner}
    told = {k: f"unmatched {cuts[k].group(2)}" for k in lonely}
    for a, z in partner.items():
        if any(a < k < z < end for k, end in open_to.items()):
            told[z] = f"crossing {cuts[a].group(2)}"
    issues = [told[k] for k in sorted(told)] + [f"unclosed {cuts[k].group(2)}" for k in sorted(k for ks in waiting.values() for k in ks)]
    ranges = [(before[a + 1], before[-1] if z == never else before[z + 1], cuts[a].group(2)) for a, z in open_to.items()]
    return "".join(texts), sorted(ranges, key=lambda r: (r[0], -r[1], r[2])), issues


def normalized(ranges: list[tuple[int, int, str]], size: int) -> list[tuple[int, int, str]]:
    """What each style covers inside [0, size), as the fewest ranges, by counting how often each place is covered."""
    out = []
    for style in {s for _, _, s in ranges}:
        step: Counter = Counter()
        for a, b, s in ranges:
            if s == style and min(b, size) > max(a, 0):
                step[max(a, 0)] += 1
                step[min(b, size)] -= 1
        places = sorted(p for p, n in step.items() if n)
        depth = list(accumulate(step[p] for p in places))
        starts = [p for p, n, d in zip(places, [0, *depth], depth) if n == 0 and d]
        stops = [p for p, d in zip(places, depth) if d == 0]
        out += [(a, b, style) for a, b in zip(starts, stops)]
    return sorted(out, key=lambda r: (r[0], -r[1], r[2]))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (id, size, start, stop, style) -> (id, style, start, stop): ``normalized`` as windows over a table of ranges."""
    x = ranges.select("id", "style", F.greatest("start", F.lit(0)).alias("start"), F.least("stop", "size").alias("stop")).where("stop > start")
    order = Window.partitionBy("id", "style").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("island", F.sum(F.when(reach >= F.col("start"), 0).otherwise(1)).over(order))
    return x.groupBy("id", "style", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def build(plain: str, ranges: list[tuple[int, int, str]]) -> str:
    """Well-nested markup for ranges over a plain text, with the fewest runs."""
    cuts = sorted({0, len(plain), *(min(max(p, 0), len(plain)) for a, b, _ in ranges for p in (a, b))})
    runs: list[list] = []
    for a, b in zip(cuts, cuts[1:]):
        styles = frozenset(s for x, y, s in ranges if x <= a and y >= b)
        if runs and runs[-1][1] == styles:
            runs[-1][0] += plain[a:b]
        else:
            runs.append([plain[a:b], styles])
    place = {n: k for k, n in enumerate(NESTING)}
    out = []
    for text, styles in runs:
        text = escape(text, quote=False)
        for s in sorted(styles, key=lambda n: (place.get(n, len(place)), n)):
            text = f"<{s}>{text}</{s}>"
        out.append(text)
    return "".join(out)


def restyle(tagged: str | None, start: int, stop: int, style: str, on: bool = True) -> str:
    """A style set or cleared on [start, stop) of the plain text."""
    plain, ranges, _ = parse(tagged)
    if on:
        ranges = normalized([*ranges, (start, stop, style)], len(plain))
    else:
        other = [r for r in ranges if r[2] != style]
        own = [r for r in ranges if r[2] == style]
        ranges = normalized(other + [(a, min(b, start), style) for a, b, _ in own] + [(max(a, stop), b, style) for a, b, _ in own], len(plain))
    return build(plain, ranges)


def style_at(tagged: str | None, start: int, stop: int, style: str) -> str:
    """'all', 'none' or 'mixed': how much of [start, stop) has a style."""
    plain, ranges, _ = parse(tagged)
    stop = min(stop, len(plain))
    if start >= stop:
        return "none"
    covered = sum(max(0, min(b, stop) - max(a, start)) for a, b, s in normalized(ranges, len(plain)) if s == style)
    return "none" if covered == 0 else "all" if covered == stop - start else "mixed"


def parse_ranges(c: str) -> Column:
    """Struct (plain, ranges, issues) of a column of tagged texts."""

    @F.pandas_udf(f"plain string, ranges {RANGE}, issues array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [parse(t) for t in s]
        return pd.DataFrame({"plain": [r[0] for r in rows], "ranges": [[{"start": a, "stop": b, "style": x} for a, b, x in r[1]] for r in rows], "issues": [r[2] for r in rows]})

    return run(F.col(c))


def rebuilt(c: str) -> Column:
    """Tagged texts with their markup normalised: balanced, nested, no empty runs."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            plain, ranges, _ = parse(t)
            return build(plain, normalized(ranges, len(plain)))

        return s.map(one, na_action="ignore")

    return run(F.col(c))
