"""Vocabulary look-ups, fall-backs and cell formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill import fixed
from citemill.functions.text import squash


def lookup(key: Column, table: dict, default: Column) -> Column:
    """Literal map look-up with a default."""
    if not table:
        return default
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty; empty text if there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def role_label(role: Column) -> Column:
    return lookup(role, fixed.ROLE_LABELS, role)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Si").otherwise("No")


def section_weight(section: Column, weights: dict[str, int]) -> Column:
    return lookup(section, weights, F.lit(weights.get("other", 1)))


def relation_weight(association: Column, confidence: Column) -> Column:
    return lookup(association, fixed.ASSOCIATION_WEIGHTS, F.lit(0.0)) * lookup(
        confidence, fixed.CONFIDENCE_WEIGHTS, F.lit(1.0)
    )


def category_or_label(category: Column, label: Column) -> Column:
    filled = first_filled(F.trim(category), F.trim(label))
    return F.when(filled == "", fixed.NO_CATEGORY).otherwise(filled)


def section_or_blank(section: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(section), F.lit("")), F.lit(fixed.NO_SECTION))


def in_vocabulary(value: Column, names: tuple[str, ...]) -> Column:
    return value.isin(*names)


def counts_to_json(counts: Column) -> Column:
    """``map<string,int>`` to JSON text; key order is the map's own order."""
    items = F.transform(
        F.map_entries(counts),
        lambda e: F.concat(
            F.lit('"'), F.regexp_replace(e["key"], r'(["\\\\])', r"\\$1"), F.lit('": '), e["value"].cast("string")
        ),
    )
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def counts_from_json(text: Column) -> Column:
    """JSON text to ``map<string,int>``; anything unreadable becomes an empty map."""
    empty = F.create_map().cast("map<string,int>")
    return F.coalesce(F.from_json(text, "map<string,int>"), empty)


CONTROL_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def clean_cell(value: Column, limit: int = 32000) -> Column:
    return F.substring(F.regexp_replace(value, CONTROL_CHARS, ""), 1, limit)


def clip(value: Column, limit: int = 32000) -> Column:
    return F.substring(F.regexp_replace(squash(value), CONTROL_CHARS, ""), 1, limit)


def clip_marked(value: Column, limit: int = 220) -> Column:
    """Shorten a cell and mark the cut."""
    head = F.rtrim(F.substring(value, 1, limit - 4))
    return F.when(F.length(value) > limit, F.concat(head, F.lit(" […]"))).otherwise(value)
