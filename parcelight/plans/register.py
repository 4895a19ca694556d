"""A registry of queries with their SQL."""

from __future__ import annotations

import inspect


def half_up(sql: str) -> str:
    """round(x, n) as floor(x * 10^n + 0.5) / 10^n, which is what the library computes, to the last bit."""
    while (at := sql.find("round(")) >= 0:
        depth, comma, end = 0, None, at + 6
        while depth or sql[end] != ")":
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and not depth else comma
            end += 1
        scale = f"1{'0' * int(sql[comma + 1 : end])}.0"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]})::DOUBLE * {scale} + 0.5) / {scale}){sql[end + 1 :]}"
    return sql


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(run):
            queries[run.__name__] = run
            if sql:
                oracles[run.__name__] = half_up(inspect.cleandoc(sql))
            return run

        return add

    return queries, oracles, query
