"""Text folders as article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.operators.metadata import choose_metadata
from citemill.operators.pages import assemble, clean_pages

SUFFIXES = (".pdf", ".txt", ".md")
TEXT_SUFFIXES = (".txt", ".md")


def file_fields(path: Column) -> dict[str, Column]:
    """Name parts of a file path and the natural order of its stem."""
    name = F.element_at(F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    prefix = F.regexp_extract(stem, r"^([A-Za-z]+)(\d+)$", 1)
    number = F.regexp_extract(stem, r"^([A-Za-z]+)(\d+)$", 2)
    return {
        "article_id": stem, "suffix": suffix,
        "order_text": F.when(prefix != "", prefix).otherwise(stem),
        # numbers of any size: more digits are more, then the digits decide
        "order_digits": F.length(F.ltrim(number, F.lit("0"))), "order_number": F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0")),
        "order_suffix": F.when(prefix != "", "").otherwise(suffix),
    }


def natural_order() -> list[str]:
    return ["order_text", "order_digits", "order_number", "order_suffix"]


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus files directly in a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("source_path"))
    fields = file_fields(F.col("source_path"))
    return files.select("source_path", *[c.alias(n) for n, c in fields.items()]).where(
        F.col("suffix").isin(*SUFFIXES)
    )


def decode(value: Column) -> Column:
    """Drop undecodable bytes and normalise line ends."""
    valid = F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))
    return F.regexp_replace(valid, "\\r\\n?", "\n")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files of a folder: article_id, source_path, text, pages = 1."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    fields = file_fields(F.col("source_path"))
    return files.select("source_path", decode(F.col("value")).alias("text"), *[c.alias(n) for n, c in fields.items()]).where(
        F.col("suffix").isin(*TEXT_SUFFIXES)
    ).withColumn("pages", F.lit(1)).withColumn("embedded_title", F.lit(""))


def from_pages(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Articles from page texts (article_id, page_no, page_text), e.g. of parsed PDFs."""
    articles = assemble(clean_pages(pages)).withColumn("source_path", F.col("article_id"))
    if titles is None:
        return articles.withColumn("embedded_title", F.lit(""))
    return articles.join(titles.select("article_id", "embedded_title"), "article_id", "left")


def with_metadata(articles: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Attach the best metadata row; an empty map when there are no sources."""
    if sources is None:
        return articles.withColumn("metadata", F.create_map().cast("map<string,string>"))
    return choose_metadata(articles, sources)
