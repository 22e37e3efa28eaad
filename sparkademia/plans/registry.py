"""A list of named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, name: str | None = None):
        def add(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if oracle:
                self.oracles[key] = oracle
            return f

        return add

    def add(self, name: str, f: Callable, oracle: str | None = None) -> None:
        self.query(oracle, name)(f)
