"""Assemble article texts from page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill.functions.text import PAGE_JOIN, clean_page

PAGES_PER_BLOCK = 256


def clean_pages(pages: DataFrame, clean: bool = True) -> DataFrame:
    """Clean each page on its own; a form feed inside a page is not a page break."""
    text = F.regexp_replace(F.coalesce("page_text", F.lit("")), "\f", "\n")
    return pages.select(
        "article_id", "page_no", (clean_page(text) if clean else F.col("page_text")).alias("page_text")
    )


def page_spans(pages: DataFrame, joiner: str = PAGE_JOIN) -> DataFrame:
    """Offsets of every cleaned page in its article, without building the article.

    The running length is taken inside blocks of pages and across blocks, so an article
    with most of the pages is still spread over many tasks.
    """
    gap = len(joiner)
    sized = pages.withColumn("chars", F.length("page_text")).withColumn(
        "block", F.floor(F.col("page_no") / PAGES_PER_BLOCK)
    )
    blocks = sized.groupBy("article_id", "block").agg(F.sum(F.col("chars") + gap).alias("block_chars"))
    before = W.partitionBy("article_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "article_id", "block", F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("block_start")
    )
    inside = W.partitionBy("article_id", "block").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("block_start") + F.coalesce(F.sum(F.col("chars") + gap).over(inside), F.lit(0))
    return sized.join(offsets, ["article_id", "block"]).select(
        "article_id", "page_no", start.alias("page_start"), (start + F.col("chars")).alias("page_end")
    )


def assemble(pages: DataFrame, joiner: str = PAGE_JOIN) -> DataFrame:
    """article_id, text, pages: page texts in order, joined in blocks first."""

    def joined(column: str, order: str):
        parts = F.array_sort(F.collect_list(F.struct(order, column)))
        return F.array_join(F.transform(parts, lambda p: p[column]), joiner)

    return (
        pages.withColumn("block", F.floor(F.col("page_no") / PAGES_PER_BLOCK))
        .groupBy("article_id", "block")
        .agg(joined("page_text", "page_no").alias("block_text"), F.count("*").alias("n"))
        .groupBy("article_id")
        .agg(joined("block_text", "block").alias("text"), F.sum("n").cast("int").alias("pages"))
    )
