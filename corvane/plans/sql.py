"""Pieces of DuckDB SQL that the oracles share.

RE2 knows no look-around, and its \\s and \\b are ASCII; the pieces below spell out the Unicode classes.
"""

from __future__ import annotations

#: White space, as a class without brackets.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHAR = r"\p{L}\p{M}\p{N}\p{Pc}"


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return replace(x, f"^[{SPACE}]+|[{SPACE}]+$")


def collapse(x: str) -> str:
    return replace(x, f"[{SPACE}]+", " ")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda w: w <> '')"


def unicode_pattern(pattern: str) -> str:
    r"""A pattern for a test, with \b at its ends and \s, \w in it, spelled out for RE2."""
    start, end = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    body = pattern[2 if start else 0 : len(pattern) - 2 if end else None]
    body = body.replace(r"\s", f"[{SPACE}]").replace(r"\w", f"[{WORD_CHAR}]")
    if r"\b" in body:
        raise ValueError(f"a word border inside {pattern}")
    return (f"(?:^|[^{WORD_CHAR}])" if start else "") + body + (f"(?:[^{WORD_CHAR}]|$)" if end else "")


def matches(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {q(unicode_pattern(pattern))}, {q(flags)})"


def any_matches(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(matches(x, p) for p in patterns) + ")"


def uuid5(name: str, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> str:
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    variant = f"substr('89ab', (CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4) + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


#: What a code fence holds, and the outermost braces, of a reply r.
FENCED = "regexp_extract(r, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1)"
BRACES = "regexp_extract(r, '(?s)\\{.*\\}', 0)"
