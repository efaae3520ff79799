"""One text for an expression, in Spark SQL for the engine and in DuckDB SQL for its check."""

from __future__ import annotations


class Spark:
    """Spark SQL: Java regular expressions, backslashes doubled in literals."""

    name = "spark"

    def q(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def script(self, name: str) -> str:
        return rf"\p{{Is{name}}}"

    def has(self, c: str, p: str) -> str:
        return f"coalesce({c} rlike {self.q(p)}, false)"

    def sub(self, c: str, p: str, r: str = "") -> str:
        return f"regexp_replace({c}, {self.q(p)}, {self.q(r.replace('@', '$'))})"

    def get(self, c: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({c}, {self.q(p)}, {g})"

    def all(self, c: str, p: str) -> str:
        return f"regexp_extract_all({c}, {self.q(p)}, 0)"

    def count(self, c: str, p: str) -> str:
        return f"regexp_count({c}, {self.q(p)})"

    def translate(self, c: str, a: str, b: str) -> str:
        return f"translate({c}, {self.q(a)}, {self.q(b)})"

    def split(self, c: str, p: str) -> str:
        return f"split({c}, {self.q(p)}, -1)"

    def keep(self, a: str, x: str, cond: str) -> str:
        return f"filter({a}, {x} -> {cond})"

    def each(self, a: str, x: str, to: str) -> str:
        return f"transform({a}, {x} -> {to})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.q(sep)})"

    def dbl(self, x: str) -> str:
        return f"cast({x} as double)"

    def sort(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"


class Duck(Spark):
    """DuckDB SQL: RE2 expressions, lambdas with a keyword."""

    name = "duck"

    def q(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def script(self, name: str) -> str:
        return rf"\p{{{name}}}"

    def has(self, c: str, p: str) -> str:
        return f"coalesce(regexp_matches({c}, {self.q(p)}), false)"

    def sub(self, c: str, p: str, r: str = "") -> str:
        return f"regexp_replace({c}, {self.q(p)}, {self.q(r.replace('@', chr(92)))}, 'g')"

    def get(self, c: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({c}, {self.q(p)}, {g})"

    def all(self, c: str, p: str) -> str:
        return f"regexp_extract_all({c}, {self.q(p)})"

    def count(self, c: str, p: str) -> str:
        return f"len(regexp_extract_all({c}, {self.q(p)}))"

    def split(self, c: str, p: str) -> str:
        return f"regexp_split_to_array({c}, {self.q(p)})"

    def keep(self, a: str, x: str, cond: str) -> str:
        return f"list_filter({a}, lambda {x}: {cond})"

    def each(self, a: str, x: str, to: str) -> str:
        return f"list_transform({a}, lambda {x}: {to})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.q(sep)})"

    def sort(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"


SPARK, DUCK = Spark(), Duck()
