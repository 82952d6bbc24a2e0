"""Registry of named queries: Spark builder + oracle body + notes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_adapters

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class QuerySpec:
    name: str
    build: Builder
    oracle_body: str | None
    headline: bool = False

    @property
    def oracle(self) -> str | None:
        return None if self.oracle_body is None else with_adapters(self.oracle_body)


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, oracle: str | None, headline: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, oracle, headline)
        return fn
    return deco


def all_queries() -> dict[str, QuerySpec]:
    from . import catalog  # noqa: F401  (registers everything)
    return REGISTRY
