"""DTD content models to rule tables: allowed children, what may follow what, required attributes.

A DTD is a small file: it is parsed on the driver and its tables are joined as rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DECL = re.compile(r"<!(ELEMENT|ATTLIST|ENTITY\s+%)\s+([\w.:-]+)\s+(.*?)>", re.S)


def parse(text: str) -> tuple[dict[str, str], dict[str, dict[str, tuple[str, bool]]]]:
    """(content model by element, (type, required) by element and attribute), parameter entities put in."""
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    entities = {n: v.strip().strip("\"'") for k, n, v in _DECL.findall(text) if k.startswith("ENTITY")}
    fill = lambda s: re.sub(r"%([\w.:-]+);", lambda m: entities.get(m.group(1), ""), s)
    models: dict[str, str] = {}
    attributes: dict[str, dict[str, tuple[str, bool]]] = {}
    for kind, name, body in _DECL.findall(text):
        for _ in range(8):
            if "%" not in body:
                break
            body = fill(body)
        if kind == "ELEMENT":
            models[name] = " ".join(body.split())
        elif kind == "ATTLIST":
            for a, t, d in re.findall(r"([\w.:-]+)\s+(\([^)]*\)|\w+)\s+(#\w+(?:\s+[\"'][^\"']*[\"'])?|[\"'][^\"']*[\"'])", body):
                attributes.setdefault(name, {})[a] = (t, d.startswith("#REQUIRED"))
    return models, attributes


class Model:
    """First, last and follow sets of a content model, by the positions of its names."""

    def __init__(self, model: str):
        self.tokens = re.findall(r"#?[\w.:-]+|[(),|?*+]", model)
        self.at = 0
        self.follow: dict[int, set[int]] = {}
        self.names: list[str] = []
        self.empty, self.first, self.last = self._choice() if self.tokens else (True, set(), set())

    def _next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _item(self):
        t = self._next()
        self.at += 1
        if t == "(":
            out = self._choice()
            self.at += self._next() == ")"
        else:
            self.names.append(t)
            k = len(self.names) - 1
            self.follow[k] = set()
            out = (t in ("#PCDATA", "EMPTY"), {k}, {k})
        mark = self._next()
        if mark and mark in "?*+":
            self.at += 1
            empty, first, last = out
            if mark in "*+":
                for k in last:
                    self.follow[k] |= first
            out = (empty or mark in "?*", first, last)
        return out

    def _choice(self):
        empty, first, last = self._item()
        while self._next() and self._next() in "|,":
            sep = self._next()
            self.at += 1
            e, f, la = self._item()
            if sep == "|":
                empty, first, last = empty or e, first | f, last | la
            else:
                for k in last:
                    self.follow[k] |= f
                first, last, empty = (first | f if empty else first), (last | la if e else la), empty and e
        return empty, first, last

    def sets(self) -> tuple[set[str], set[str], set[tuple[str, str]]]:
        n = self.names
        return {n[k] for k in self.first}, {n[k] for k in self.last}, {(n[a], n[b]) for a, bs in self.follow.items() for b in bs}


def rule_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """allowed_child, allowed_next, first_child and required_attr as tables."""
    models, attributes = parse(text)
    child, nxt, first = [], [], []
    for e, m in models.items():
        model = Model(m)
        a, _, f = model.sets()
        child += [(e, c) for c in sorted(set(model.names) - {"EMPTY", "ANY"})]
        nxt += [(e, x, y) for x, y in sorted(f)]
        first += [(e, c) for c in sorted(a)]
    required = [(e, a) for e, x in attributes.items() for a, (_, need) in x.items() if need]
    return {
        "allowed_child": spark.createDataFrame(child, "parent string, child string"),
        "allowed_next": spark.createDataFrame(nxt, "parent string, prev string, child string"),
        "first_child": spark.createDataFrame(first, "parent string, child string"),
        "required_attr": spark.createDataFrame(required, "element string, attribute string"),
    }


def violations(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """(parent, child, n) pairs that the content models don't allow, by an anti join."""
    return pairs.join(allowed, ["parent", "child"], "left_anti").groupBy("parent", "child").agg(F.sum("n").alias("n"))
