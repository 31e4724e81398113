"""How queries are registered, and SQL pieces that oracles share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from specforge.functions.text import ACCENTED, PLAIN


def registry() -> tuple[dict, dict, Callable]:
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def norm(c: str) -> str:
    return rf"regexp_replace(translate(regexp_replace(lower(coalesce({c}, '')), '^\s+|\s+$', '', 'g'), '{ACCENTED}', '{PLAIN}'), '\s+', ' ', 'g')"


def found(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


def times(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(pattern)}))"
