"""The location grammar of feature tables: a recursive descent over spans, join, order and complement."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_ONE = re.compile(r"([<>]?)(\d+)(?:\.\.([<>]?)(\d+)|\^(\d+))?(?=[,)]|$)")


@dataclass(frozen=True)
class Part:
    start0: int
    end0: int
    strand: int = 1
    start_fuzzy: str = ""
    end_fuzzy: str = ""


def parse_location(text: str, length: int = 0, circular: bool = False) -> tuple[str | None, list[Part]] | None:
    """(operator, parts in biological order), or None for what isn't understood, such as places in other records.

    A span that ends before it starts runs over the origin of a circular record and gives two parts.
    """
    text = re.sub(r"\s+", "", text)
    try:
        operator, parts, at = _expression(text, 0, length, circular)
    except (ValueError, RecursionError):
        return None
    return (operator, parts) if at == len(text) and parts else None


def _expression(s: str, at: int, length: int, circular: bool):
    for word in ("complement", "join", "order"):
        if s.startswith(word + "(", at):
            operator, parts, at = _arguments(s, at + len(word) + 1, length, circular)
            if word == "complement":
                return operator, [replace(p, strand=-p.strand) for p in reversed(parts)], at
            return (word if len(parts) > 1 else operator), parts, at
    return _span(s, at, length, circular)


def _arguments(s: str, at: int, length: int, circular: bool):
    parts, operator = [], None
    while True:
        inner, more, at = _expression(s, at, length, circular)
        parts += more
        operator = operator or inner
        if at >= len(s) or s[at] not in ",)":
            raise ValueError(f"neither , nor ) at {at} of {s}")
        at += 1
        if s[at - 1] == ")":
            return operator, parts, at


def _span(s: str, at: int, length: int, circular: bool):
    m = _ONE.match(s, at)
    if not m:
        raise ValueError(f"no span at {at} of {s}")
    low_fuzzy, low, high_fuzzy, high, after = m.groups()
    first = int(low)
    if after:  # between two bases
        return None, [Part(first, first)], m.end()
    last = int(high) if high else first
    fuzzy = (low_fuzzy if low_fuzzy == "<" else "", high_fuzzy or "" if high else (low_fuzzy if low_fuzzy == ">" else ""))
    if last < first:
        if not circular or not length:
            raise ValueError("a span that ends before it starts")
        return "join", [Part(first - 1, length, 1, fuzzy[0], ""), Part(0, last, 1, "", fuzzy[1])], m.end()
    return None, [Part(first - 1, last, 1, *fuzzy)], m.end()


def render_location(operator: str | None, parts: list[Part]) -> str:
    """Text of a location; on the reverse strand as the complement of the joined parts."""

    def span(p: Part) -> str:
        if p.end0 == p.start0:
            return f"{p.start0}^{p.start0 + 1}"
        low, high = f"{p.start_fuzzy}{p.start0 + 1}", f"{p.end_fuzzy}{p.end0}"
        return low if p.end0 == p.start0 + 1 and not p.start_fuzzy and not p.end_fuzzy else f"{low}..{high}"

    if len(parts) > 1 and all(p.strand == -1 for p in parts):
        return f"complement({operator or 'join'}({','.join(span(p) for p in reversed(parts))}))"
    each = [f"complement({span(p)})" if p.strand == -1 else span(p) for p in parts]
    return each[0] if len(each) == 1 else f"{operator or 'join'}({','.join(each)})"
