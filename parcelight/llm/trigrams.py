"""Boolean trigram queries from regular expressions.

A query is a list of clauses, each a set of trigrams: a text can only match if it holds all trigrams of at least one
clause. None says that nothing is required, so every text is a candidate. Everything is in lower case.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

#: Exact sets and disjunctions beyond these sizes are given up, which only widens the candidates.
MOST_STRINGS, MOST_CLAUSES = 48, 48


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def clauses_of(strings: set[str]) -> list[frozenset[str]] | None:
    """The query that one of strings occurs."""
    found = {trigrams(s) for s in strings}
    return None if frozenset() in found else minimal(found)


def minimal(found) -> list[frozenset[str]]:
    return sorted((c for c in found if not any(d < c for d in found)), key=sorted)


def both(a, b):
    """Conjunction; where it would grow too large, the more selective side alone."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=len)
    return minimal({x | y for x in a for y in b})


def either(parts):
    if any(p is None for p in parts):
        return None
    found = {c for p in parts for c in p}
    return minimal(found) if len(found) <= MOST_CLAUSES else None


def analyse(node) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """(all strings that the sequence can match, if they are few; the query)."""
    exact: set[str] | None = {""}
    run, query = {""}, None  # run: strings that must occur, ending where the sequence now is

    def close():
        nonlocal run, query
        query, run = both(query, clauses_of(run)), {""}

    for item in node:
        strings, inner = analyse_item(*item)
        exact = {a + b for a in exact for b in strings} if exact is not None and strings is not None and len(exact) * len(strings) <= MOST_STRINGS else None
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            close()
            if strings is not None:
                run = set(strings)
            query = both(query, inner)
        else:
            run = {a + b for a in run for b in strings}
    close()
    return exact, query


def analyse_item(kind, value):
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN:
        chars = set()
        for k, v in value:
            if k is op.LITERAL:
                chars.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 4 else (None, None)
    if kind is op.SUBPATTERN:
        return analyse(value[3])
    if kind is op.BRANCH:
        parts = [analyse(p) for p in value[1]]
        strings = set().union(*(s or () for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        queries = [both(q, clauses_of(s)) if s is not None else q for s, q in parts]
        return (strings, None) if strings is not None and len(strings) <= MOST_STRINGS else (None, either(queries))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = analyse(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, (both(query, clauses_of(strings)) if strings is not None else query) if low else None
    if kind is op.AT:
        return {""}, None
    return None, None


def query_of(pattern: str) -> list[frozenset[str]] | None:
    exact, query = analyse(parser.parse(pattern))
    return both(query, clauses_of(exact)) if exact is not None else query
