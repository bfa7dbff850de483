"""The boolean tag query language: parsed on the driver into a Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnspark.functions.scalars import trimmed

from .tags import SYMBOLS


def normalize_text(text: str) -> str:
    return reduce(lambda s, row: s.replace(row[1], row[0]), SYMBOLS, text.strip().lower())


def is_tag_query(text: str) -> bool:
    return len(text) >= 4 and text[:4].lower() == "tag:"


def has_operator(text: str) -> bool:
    return bool(re.search(r"\s(AND|OR)\s", text, re.I)) or '"' in text


def parse(text: str) -> tuple[str, list[str]]:
    """Mode (single, AND, OR) and normalized terms of a query tag:..."""
    expr = text.strip()[4:].strip()
    if len(expr) >= 2 and expr[0] == expr[-1] == '"':
        expr = expr[1:-1].strip()
    upper = expr.upper()
    for mode in ("AND", "OR"):
        if f" {mode} " in upper:
            return mode, [t for t in (normalize_text(x) for x in upper.split(f" {mode} ")) if t]
    term = normalize_text(expr)
    return "single", [term] if term else []


def matches(text: str, tags: Column) -> Column:
    """Whether an array of normalized tags satisfies the query."""
    mode, terms = parse(text)
    if not terms:
        return F.lit(False)
    tests = [F.array_contains(tags, t) for t in terms]
    return reduce(lambda a, b: a & b if mode == "AND" else a | b, tests)


def route(text: str, vocabulary_loaded: bool) -> str:
    """What a changed search text asks for."""
    if not text.strip():
        return "recent"
    if is_tag_query(text.strip()):
        if has_operator(text):
            return "backendTagSuggest"
        return "noop" if vocabulary_loaded else "tagFetchDistinct"
    return "backendSuggest"


def route_of(text: Column, vocabulary_loaded: Column) -> Column:
    """route() as a column; a null text is empty."""
    typed = trimmed(F.coalesce(text, F.lit("")))
    boolean = F.substr(typed, F.lit(5)).rlike(r'(?i)\s(AND|OR)\s|"')
    tag = F.when(boolean, "backendTagSuggest").when(vocabulary_loaded, "noop").otherwise("tagFetchDistinct")
    return F.when(typed == "", "recent").when(F.lower(F.left(typed, F.lit(4))) == "tag:", tag).otherwise("backendSuggest")
