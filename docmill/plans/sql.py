"""Pieces of DuckDB SQL shared by the query catalogues."""

from __future__ import annotations

import re


def quoted(text: str) -> str:
    """A string as SQL writes it; line ends as character codes."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def re2(pattern: str) -> str:
    """Escapes of code points as DuckDB's engine writes them."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)


def matches(col: str, pattern: str, flags: str = "i") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_matches({col}, {quoted(prefix + re2(pattern))})"


def holds(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(t)})" for t in terms) + ")" if terms else "false"


def holds_lower(col: str, terms) -> str:
    return holds(f"lower({col})", [t.lower() for t in terms])


def stripped(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {quoted(re2(pattern))}))"


def values(rows: list[tuple], names: str) -> str:
    """A literal table; strings, numbers, booleans and nulls."""
    def shown(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "[" + ", ".join(map(shown, x)) + "]" if isinstance(x, list) else quoted(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") AS v({names})"
