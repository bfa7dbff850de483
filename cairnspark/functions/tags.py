"""Tag normalization, enrichment and formatting as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clipped, trimmed

#: Key, symbol, name.
SYMBOLS = [
    ("*", "⭐", "star"),
    ("$", "💲", "money"),
    ("done", "✅", "done"),
    ("todo", "☐", "todo"),
    ("!", "❗", "important"),
    ("?", "❓", "question"),
    ("+", "➕", "plus"),
    ("-", "➖", "minus"),
    ("x", "❌", "x"),
    ("@", "📧", "email"),
    ("#", "🔖", "tag"),
    ("%", "📊", "percent"),
    ("&", "🔗", "link"),
    ("home", "🏠", "home"),
    ("work", "💼", "work"),
    ("food", "🍽️", "food"),
    ("gas", "⛽", "gas"),
    ("coffee", "☕", "coffee"),
    ("hotel", "🏨", "hotel"),
    ("restaurant", "🍴", "restaurant"),
    ("shopping", "🛒", "shopping"),
    ("park", "🌳", "park"),
    ("beach", "🏖️", "beach"),
    ("mountain", "⛰️", "mountain"),
    ("hospital", "🏥", "hospital"),
    ("school", "🏫", "school"),
    ("church", "⛪", "church"),
    ("bank", "🏦", "bank"),
    ("urgent", "🚨", "urgent"),
    ("favorite", "💖", "favorite"),
    ("important", "⚡", "important"),
    ("diving", "🤿", "diving"),
]


def normalized(tag: Column) -> Column:
    """Trimmed, lower-cased, symbols replaced by their keys; runs are kept."""
    return reduce(lambda c, row: F.replace(c, F.lit(row[1]), F.lit(row[0])), SYMBOLS, F.lower(trimmed(tag)))


def _found(at: int, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for row in SYMBOLS for v in (row[0], row[at]))), key)


def enriched(tag: Column) -> Column:
    """raw, emoji, name, display, normal of a tag."""
    raw = trimmed(tag)
    first = F.lower(F.left(raw, F.lit(1)))
    whole, single = _found(1, F.lower(raw)), _found(1, first)
    run = (F.octet_length(raw) > 1) & (F.replace(raw, F.left(raw, F.lit(1)), F.lit("")) == "")
    emoji = F.when(raw == "", None).when(whole.isNotNull(), whole).when(run, single)
    name = F.when(raw == "", None).when(whole.isNotNull(), _found(2, F.lower(raw))).when(run, _found(2, first))
    display = F.when(raw == "", tag).when(whole.isNotNull() & (F.octet_length(raw) == 1), whole).when(whole.isNotNull(), F.concat(whole, F.lit(" "), raw)).when(run & single.isNotNull(), F.repeat(single, F.length(raw))).otherwise(raw)
    return F.struct(F.when(raw == "", tag).otherwise(raw).alias("raw"), emoji.alias("emoji"), name.alias("name"), display.alias("display"), F.when(raw == "", F.lit("")).otherwise(normalized(tag)).alias("normal"))


def symbol_form(text: Column) -> Column:
    """Lower case, star and money symbols as * and $, runs of those as one, trimmed."""
    plain = F.replace(F.replace(F.lower(text), F.lit("⭐"), F.lit("*")), F.lit("💲"), F.lit("$"))
    return trimmed(F.regexp_replace(F.regexp_replace(plain, r"\*+", "*"), r"\$+", r"\$"))


def joined(displays: Column) -> Column:
    return clipped(F.array_join(displays, ", "), 40, 37)
