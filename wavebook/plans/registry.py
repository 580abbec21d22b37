"""A list of queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(
        self, sql: str | None = None, transform: str | None = None, name: str | None = None
    ) -> Callable:
        """Register a function under its name or another; ``transform`` selects from the SQL."""

        def register(function: Callable) -> Callable:
            key = name or function.__name__
            self.queries[key] = function
            if sql is not None:
                self.sql[key] = f"{transform} ({sql})" if transform else sql
            return function

        return register
