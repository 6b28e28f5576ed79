"""The registered queries.

Each is a function of the input tables. Its SQL says the same in DuckDB's
dialect and is what the results are checked against.
"""

from __future__ import annotations

from brindle.plans import aggregates, expressions, joins, ordered, sets, streams
from brindle.plans.registry import Plan

ALL: dict[str, Plan] = {}
for _module in (aggregates, joins, ordered, sets, expressions, streams):
    ALL |= _module.plans.found

__all__ = ["ALL", "Plan"]
