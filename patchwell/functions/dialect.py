"""The same pattern in two regular-expression dialects.

The fixed patterns are in ECMAScript notation. Three things mean something else
in Java and RE2: ``\\s`` (ECMAScript includes NBSP and friends), ``.`` and ``$``
(line terminators), and ``\\b`` (Java 17's is Unicode-aware).
"""

from __future__ import annotations

_JAVA = {
    "space": r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff",
    "b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))",
    ".": r"[^\n\r\u2028\u2029]",
}
_RE2 = {
    "space": r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{feff}",
    "b": r"\b",
    ".": r"[^\n\r\x{2028}\x{2029}]",
}


def _spell_out(pattern: str, words: dict[str, str], any_case: bool) -> str:
    out = ["(?i)"] if any_case else []
    in_class = False
    chars = iter(pattern)
    for c in chars:
        if c == "\\":
            c = next(chars)
            if c == "s":
                out.append(words["space"] if in_class else f"[{words['space']}]")
            elif c == "S":
                out.append(f"[^{words['space']}]")
            elif c == "b":
                out.append(words["b"])
            else:
                out.append("\\" + c)
        elif in_class:
            in_class = c != "]"
            out.append(c)
        elif c == ".":
            out.append(words["."])
        elif c == "$":
            out.append(r"\z")
        else:
            in_class = c == "["
            out.append(c)
    return "".join(out)


def java(pattern: str, any_case: bool = False) -> str:
    """``pattern`` for Spark's ``rlike`` / ``regexp_*`` functions."""
    return _spell_out(pattern, _JAVA, any_case)


def re2(pattern: str, any_case: bool = False) -> str:
    """``pattern`` for DuckDB's ``regexp_*`` functions (used by the oracles)."""
    return _spell_out(pattern, _RE2, any_case)
