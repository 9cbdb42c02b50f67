"""Section spans of an article, and the section of a match by the rank that the scan gave it.

All rules work on the header array inside the article's own row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.operators.scan import find_headers

MARKER = "array<struct<start:int,rank:int,name:string>>"


def _is_header(match: Column) -> Column:
    """Line start, set off by capitals or standing alone, short line or run-in mark."""
    opens_line = match["line_chars"] > 0
    marked = match["word"].rlike(r"^\p{IsUppercase}") | (
        match["line_chars"] == F.length(match["word"])
    )
    run_in = (match["after"] != "") & F.lit(fixed.RUN_IN_MARKS).contains(match["after"])
    return opens_line & marked & ((match["line_chars"] <= fixed.HEADER_LINE_CHARS) | run_in)


def _spans(markers: Column, length: Column) -> Column:
    """Each marker runs to the next one; zero-length spans are dropped."""
    ends = F.concat(
        F.transform(F.slice(markers, 2, F.greatest(F.size(markers) - 1, F.lit(0))), lambda m: m["start"]),
        F.array(length),
    )
    spans = F.zip_with(
        markers,
        ends,
        lambda m, e: F.struct(m["name"].alias("name"), m["start"].alias("start"), e.alias("end")),
    )
    return F.filter(spans, lambda s: s["end"] > s["start"])


def with_sections(articles: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """Add ``spans array<struct<name,start,end>>`` tiling each article's text, and ``span_starts``.

    The starts come from the markers, not from the spans, so that they need no text: only in an empty text is there one more of them.
    """
    # markers: the synthetic title loses ties on one offset, others tie by name
    markers = F.transform(
        F.filter("headers", _is_header),
        lambda m: F.struct(
            m["line_start"].alias("start"), F.lit(1).alias("rank"), m["section"].alias("name")
        ),
    )
    title = F.struct(F.lit(0).alias("start"), F.lit(0).alias("rank"), F.lit("title").alias("name"))
    df = articles.withColumn("headers", find_headers(F.col("text"), headers)).withColumn(
        "markers", F.array_sort(F.array_distinct(F.concat(F.array(title), markers).cast(MARKER)))
    )
    # the bibliography is the last "references" marker; nothing behind it counts
    terminal = F.array_max(
        F.transform(
            F.filter("markers", lambda m: m["name"] == fixed.TERMINAL_SECTION), lambda m: m["start"]
        )
    )
    last = F.struct(
        F.col("terminal").alias("start"), F.lit(1).alias("rank"),
        F.lit(fixed.TERMINAL_SECTION).alias("name"),
    )
    before = F.filter("markers", lambda m: (m["name"] != fixed.TERMINAL_SECTION) & (m < last))
    df = df.withColumn("terminal", terminal).withColumn(
        "markers",
        F.when(F.col("terminal").isNull(), F.col("markers")).otherwise(
            F.concat(before, F.array(last).cast(MARKER))
        ),
    )
    return df.withColumns({
        "spans": _spans(F.col("markers"), F.length("text")),
        "span_starts": F.array_distinct(F.transform("markers", lambda m: m["start"])),
    }).drop("headers", "markers", "terminal")


def section_of(spans: Column, rank: Column) -> Column:
    """Name of the span of that number, counted from 1; ``other`` before the first."""
    return F.when(rank > 0, F.get(spans, rank - 1)["name"]).otherwise("other")


def section_table(articles: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """One row per span: article_id, span_no, section, start, end."""
    return (
        with_sections(articles, headers)
        .select("article_id", F.posexplode("spans").alias("span_no", "span"))
        .select(
            "article_id", "span_no", F.col("span.name").alias("section"),
            F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        )
    )
