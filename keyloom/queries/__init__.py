"""Queries over the derived key spaces, and SQL that gives the same rows."""


class Book:
    """Collects (function, SQL) pairs under the function's name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, sql: str | None = None, *, also: str | None = None):
        """``also``: a second name under which the query is known."""

        def keep(f):
            for name in filter(None, (f.__name__, also)):
                self.queries[name] = f
                if sql:
                    self.oracles[name] = sql
            return f

        return keep
