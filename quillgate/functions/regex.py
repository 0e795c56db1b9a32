"""One pattern, two dialects: Spark's Java expressions and DuckDB's RE2, with the same
matches as an ASCII-boundary, Unicode-space expression."""

from __future__ import annotations

import re

_SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_LINE = r"[^\n\r\u2028\u2029]"


def _walk(pattern: str, edge: str, space: str, any_char: str) -> str:
    """Replaces escapes and the dot, inside and outside of character classes."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        if c == "\\":
            out.append({r"\b": edge, r"\d": "0-9" if in_class else "[0-9]", r"\s": space if in_class else f"[{space}]"}.get(two, two))
            i += 2
            continue
        if c in "[]":
            in_class = c == "["
        out.append(any_char if c == "." and not in_class else c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    return _walk(pattern, _EDGE, _SPACE, _LINE)


def re2(pattern: str) -> str:
    wide = lambda s: re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", s)
    return _walk(pattern, r"\b", wide(_SPACE), wide(_LINE))


def sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
