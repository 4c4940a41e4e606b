"""Catalogue of runnable queries with their independent SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None
    covers: tuple[str, ...]


CATALOGUE: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under the function's name; ``covers`` names the operators it exercises."""

    def register(build: Build) -> Build:
        name = build.__name__
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Entry(build, sql, tuple(covers.split()))
        return build

    return register
