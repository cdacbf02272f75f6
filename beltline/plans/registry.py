"""Named queries over a data folder, each with its cross-check SQL where plain SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from .oracle_views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views=(), sql: str | None = None):
    def keep(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return keep
