"""The table of registered queries: a callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from graphloom.plans import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a function under its name; ``names`` are the views that its oracle reads."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = views.with_views(sql, *names)
        return fn

    return add
