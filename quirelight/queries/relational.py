"""Registered queries of ``operators.relational`` and ``operators.evidence``: one of each, over the whole tables."""

from __future__ import annotations

from quirelight.operators import evidence as _evidence  # noqa: F401  (adds its operators)
from quirelight.operators import relational as R
from quirelight.runtime import table

QUERIES = {name: (lambda s, d, n=name: R.run(s, n, lambda t: table(s, d, t))) for name in R.OPERATORS}
SQL = {name: R.check_sql(name) for name in R.OPERATORS}
