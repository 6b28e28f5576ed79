from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from brindle.sources import Tables


@dataclass(frozen=True)
class Plan:
    build: Callable[[Tables], DataFrame]
    sql: str


class Plans:
    """Collects a module's queries: ``@plans(sql)`` above a function of the tables."""

    def __init__(self) -> None:
        self.found: dict[str, Plan] = {}

    def __call__(self, sql: str) -> Callable:
        def register(build: Callable[[Tables], DataFrame]) -> Callable:
            self.found[build.__name__] = Plan(build, sql)
            return build
        return register
