"""Text expressions, built-in but for a running sum of integers, the number of words and the opening lines.

These cost a fraction of the JVM's regexes, and the scan of the terms sends the same texts to Python anyway.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.functions.regex import SPACE, UNUSUAL_OF_PYTHON, WORD

# ship these helpers with the job: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a run of whitespace behind . ! ? and before a capital or digit; the run's first
# character is tested before looking behind it
SENTENCE_BREAK = f"[{SPACE}](?<=[.!?][{SPACE}])[{SPACE}]*(?=[A-ZÁÉÍÓÚÜÑ0-9])"
_STARTER = "[A-ZÁÉÍÓÚÜÑ0-9]"
_UP_TO_LAST_BREAK = f"(?s)^.*[.!?][{SPACE}]+(?={_STARTER})"
_UP_TO_FIRST_BREAK = f"(?s)^.*?[.!?](?=[{SPACE}]+{_STARTER})"
SENTENCE_REACH = 900
# characters to both sides that stand for a sentence without any text
EMPTY_SENTENCE_RADIUS = 180
# characters of a text block
BLOCK = 4096
# whitespace runs other than one blank, which would be replaced by itself
_LOOSE_SPACE = f"(?![!-~])(?:[{SPACE}&&[^ ]][{SPACE}]*+| [{SPACE}]++)"
PAGE_BREAK = "\f"
PAGE_JOIN = "\n\f\n"


def squash(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim; null becomes empty."""
    # most runs are one line feed, which a plain replacement finds sooner than the regex
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), _LOOSE_SPACE, " "))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value evaluated once, where a plan would repeat it for each of its uses."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def clean_page(text: Column) -> Column:
    """Join soft hyphens over one line break, squeeze blanks and blank lines."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", " ")
    text = F.regexp_replace(text, f"([{WORD}])-[ \\t]*\\n[ \\t]*([{WORD}])", "$1$2")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "\\n{3,}", "\n\n")
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def cut(text: Column, start: Column, end: Column) -> Column:
    """Half-open slice ``[start, end)`` in characters."""
    start = F.greatest(start, F.lit(0))
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def context_window(text: Column, start: Column, end: Column, radius: int) -> Column:
    return squash(cut(text, start - radius, end + radius))


def _with_breaks(text: Column) -> Column:
    """Sentences and the separators behind them, in order."""
    return F.arrays_zip(
        F.split(text, SENTENCE_BREAK, -1).alias("body"),
        F.regexp_extract_all(text, F.lit(SENTENCE_BREAK), F.lit(0)).alias("gap"),
    )


def sentence_in(fragment: Column, at: Column, fallback: Column) -> Column:
    """First non-empty sentence of ``fragment`` that ends behind position ``at``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("hit"))

    def step(state: Column, part: Column) -> Column:
        size = F.length(part["body"])
        found = state["hit"].isNull() & (size > 0) & (state["pos"] + size > at)
        return F.struct(
            (state["pos"] + size + F.length(F.coalesce(part["gap"], F.lit("")))).alias("pos"),
            F.when(found, part["body"]).otherwise(state["hit"]).alias("hit"),
        )

    hit = squash(F.aggregate(_with_breaks(fragment), start, step, lambda s: s["hit"]))
    return F.when(hit != "", hit).otherwise(fallback)


def sentence_at(text: Column, start: Column, end: Column, reach: int = SENTENCE_REACH) -> Column:
    """Sentence that holds ``start``, looked up in a window around the match.

    A match that begins with a visible character lies inside one sentence, which runs
    from the last break before it to the first break behind it. A match that begins
    with whitespace may start inside a break, so the breaks are walked in order.
    """
    left = F.greatest(start - reach, F.lit(0))
    right = end + reach
    head = F.regexp_replace(cut(text, left, start + 1), _UP_TO_LAST_BREAK, "")
    rest = cut(text, start, right)
    first = F.regexp_extract(rest, _UP_TO_FIRST_BREAK, 0)
    tail = F.when(first != "", first).otherwise(rest)
    inside = squash(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), tail))
    walked = sentence_in(cut(text, left, right), start - left, context_window(text, start, end, EMPTY_SENTENCE_RADIUS))
    visible = ~cut(text, start, start + 1).rlike(f"^[{SPACE}]?$")
    return F.when(visible, inside).otherwise(walked)


def running_starts(lengths: Column) -> Column:
    """Where each part starts when parts of these lengths follow one another: linear, and only integers leave the JVM."""

    def starts(rows: pa.Array) -> pa.Array:
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype("int64")
        before = np.concatenate([[0], np.cumsum(flat)])
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype("int64")
        out = before[:-1] - np.repeat(before[edges[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(out, pa.int32()))

    starts.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(starts, "array<int>")(lengths)


def split_sentences(text: Column) -> Column:
    """``array<struct<start, end, sentence>>`` over the whole text, empties dropped. Linear in the text."""
    parts = _with_breaks(F.coalesce(text, F.lit("")))
    lengths = F.transform(parts, lambda p: F.length(p["body"]) + F.length(F.coalesce(p["gap"], F.lit(""))))
    placed = F.arrays_zip(running_starts(lengths).alias("start"), parts.alias("part"))
    items = F.transform(placed, lambda p: F.struct(
        p["start"].alias("start"), (p["start"] + F.length(p["part"]["body"])).alias("end"), squash(p["part"]["body"]).alias("sentence")))
    return F.filter(items, lambda s: s["sentence"] != "")


def word_count(text: Column) -> Column:
    def count(texts: pa.Array) -> pa.Array:
        words = re.compile(r"\w+")
        return pa.array([None if t is None else len(words.findall(t)) for t in (value.as_py() for value in texts)], pa.int32())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "int")(text)


def holds_unusual(text: Column) -> Column:
    """``is_unusual`` of whole texts; where it is false, it is so for each part of the text."""

    def test(texts: pa.Array) -> pa.Array:
        unusual = re.compile(UNUSUAL_OF_PYTHON)
        bodies = (value.as_py() or "" for value in texts)
        return pa.array([not body.isascii() and unusual.search(body) is not None for body in bodies], pa.bool_())

    test.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(test, "boolean")(text)


def first_line(text: Column, lines: int | None, shortest: int, longest: int, without: tuple[str, ...]) -> Column:
    """First of the opening ``lines``, squashed, of fitting length and without any of these lower-case fragments, or null."""

    def pick(texts: pa.Array) -> pa.Array:
        found = []
        for value in texts:
            # a line ends at the breaks that str.splitlines knows; str.split parts at the same blanks as SPACE
            squashed = (" ".join(line.split()) for line in (value.as_py() or "").splitlines()[:lines])
            fitting = (line for line in squashed if shortest <= len(line) <= longest)
            found.append(next((line for line in fitting if not any(w in line.lower() for w in without)), None))
        return pa.array(found, pa.string())

    pick.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(pick, "string")(text)


def has_words(text: Column, n: int) -> Column:
    """Whether a text has at least ``n`` words; reads no further than the n-th."""
    return text.rlike(f"^[^{WORD}]*+(?:[{WORD}]++[^{WORD}]*+){{{n}}}")


def page_breaks(text: Column) -> Column:
    """Offsets of the form feeds of a text, computed once per article."""
    parts = F.split(text, PAGE_BREAK, -1)
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        at = state["pos"] + F.length(part)
        return F.struct((at + 1).alias("pos"), F.concat(state["out"], F.array(at)).alias("out"))

    offsets = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begin, step, lambda s: s["out"])
    return F.when(F.size(parts) > 1, offsets).otherwise(F.array().cast("array<int>"))


def page_of(before: Column, n_breaks: Column, position: Column, pages: Column, length: Column) -> Column:
    """Page of a position with so many form feeds before it: counted, else proportional, else 1."""
    counted = before + 1
    share = (position / F.greatest(length, F.lit(1)) * pages).cast("int") + 1
    return (
        F.when(n_breaks > 0, F.when(pages > 0, F.least(counted, pages)).otherwise(counted))
        .when((pages <= 1) | (length == 0), F.lit(1))
        .otherwise(F.greatest(F.lit(1), F.least(pages, share)))
        .cast("int")
    )


def page_at(breaks: Column, position: Column, pages: Column, length: Column) -> Column:
    """Page of a position by the offsets of the form feeds of its text."""
    return page_of(F.size(F.filter(breaks, lambda b: b < position)), F.size(breaks), position, pages, length)
