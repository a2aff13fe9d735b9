"""CTE registry for the oracle.

Each oracle query is a final SELECT plus the named CTEs it needs; ``query``
assembles the adapter views and these CTEs in dependency order into one
statement DuckDB runs on the pre-registered test tables.
"""

from __future__ import annotations

from rxgrid.sources.adapter import BASE_TABLES, VIEWS

# name -> (sql, deps)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
# query name -> (final select, deps)
ORACLE: dict[str, str] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (sql, deps)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in BASE_TABLES:
            return
        if n in VIEWS:
            deps = VIEWS[n][1]
        else:
            deps = CTES[n][1]
        for d in deps:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def query(final_sql: str, deps: tuple[str, ...] | list[str]) -> str:
    parts = []
    for n in _order(deps):
        if n in VIEWS:
            sql, vdeps = VIEWS[n]
            body = sql.format(**{d: d for d in vdeps})
        else:
            body = CTES[n][0]
        parts.append(f"{n} AS (\n{body}\n)")
    if not parts:
        return final_sql
    return "WITH " + ",\n".join(parts) + "\n" + final_sql


def register(name: str, deps: tuple[str, ...] | list[str], final_sql: str) -> None:
    ORACLE[name] = query(final_sql, deps)
