"""Where the catalog modules register their queries and oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from candorframe.tables import view_oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, *views: str) -> str:
    """``sql`` with the named views in front as common table expressions."""
    sql = sql.strip()
    if not views:
        return sql
    heads = ", ".join(f"{v} AS ({view_oracle(v)})" for v in views)
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {heads}, {sql[5:]}"
    return f"WITH {heads} {sql}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return add
