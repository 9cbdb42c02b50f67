"""Choose a metadata row per article and derive title, year and DOI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Limits
from citemill.functions.labels import first_filled
from citemill.functions.regex import contains_any, extract
from citemill.functions.text import first_line, squash
from citemill.operators.groups import top_rows

# Reach of the reference rules into a text, the defaults of parameters; None looks at the whole text.
_L = Limits()
SCANNED_CHARS, YEAR_CHARS, DOI_CHARS = _L.metadata_chars, _L.year_chars, _L.doi_chars
TITLE_LINES, CONTEXT_TITLE_LINES = _L.title_lines, _L.context_title_lines


def opening_of(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def title_tokens(title: Column, stopwords=fixed.TITLE_STOPWORDS, token: str = fixed.TITLE_TOKEN) -> Column:
    """Distinct lower-case words of at least five letters, stop words removed."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(token), F.lit(0))
    long = F.transform(F.filter(words, lambda w: F.length(w) >= 5), F.lower)
    return F.array_except(long, F.array(*[F.lit(w) for w in stopwords]))


def token_overlap(title: Column, text: Column, stopwords=fixed.TITLE_STOPWORDS,
                  token: str = fixed.TITLE_TOKEN, chars: int | None = SCANNED_CHARS) -> Column:
    """How many title tokens occur in the opening of the text."""
    opening = F.lower(opening_of(text, chars))
    return F.size(F.filter(title_tokens(title, stopwords, token), lambda t: opening.contains(t)))


def from_row(row: Column, keys: tuple[str, ...]) -> Column:
    return first_filled(*[F.element_at(row, F.lit(k)) for k in keys])


def best_metadata(articles: DataFrame, sources: DataFrame, keys=fixed.TITLE_KEYS,
                  stopwords=fixed.TITLE_STOPWORDS, token: str = fixed.TITLE_TOKEN, chars: int | None = SCANNED_CHARS) -> DataFrame:
    """(article_id, metadata): the source row whose title fits the text best; ties keep the first source.

    An article with one row takes it unseen. Only the openings of texts take part, and no column of the result is a text.
    """
    number = sources.groupBy("article_id").agg(F.count("*").alias("rows"))
    numbered = sources.join(number, "article_id")
    opening = articles.select("article_id", opening_of(F.col("text"), chars).alias("opening"))
    scored = numbered.where("rows > 1").join(opening, "article_id").select(
        "article_id", "source_ord", "row",
        token_overlap(from_row(F.col("row"), keys), F.col("opening"), stopwords, token, chars).alias("overlap"),
    )
    best = top_rows(scored, ["article_id"], [F.col("overlap").desc(), "source_ord"], 1)
    return numbered.where("rows = 1").select("article_id", F.col("row").alias("metadata")).unionByName(
        best.select("article_id", F.col("row").alias("metadata")))


def choose_metadata(articles: DataFrame, sources: DataFrame, keys=fixed.TITLE_KEYS,
                    stopwords=fixed.TITLE_STOPWORDS, token: str = fixed.TITLE_TOKEN) -> DataFrame:
    """Add ``metadata map<string,string>`` to articles; an empty map without a row.

    This joins all columns of ``articles``, their text included. The review job takes the sources instead
    and joins ``best_metadata`` after the text is gone.
    """
    best = best_metadata(articles, sources, keys, stopwords, token).withColumnRenamed("metadata", "row")
    empty = F.create_map().cast("map<string,string>")
    return articles.join(best, "article_id", "left").withColumn(
        "metadata", F.coalesce("row", empty)
    ).drop("row")


def listed_title(row: Column) -> Column:
    return first_filled(*[squash(F.element_at(row, F.lit(k))) for k in fixed.TITLE_KEYS])


def listed_year(row: Column) -> list[Column]:
    return [extract(squash(F.element_at(row, F.lit(k))), fixed.YEAR_PATTERN, 1, ignore_case=False) for k in fixed.YEAR_KEYS]


def listed_doi(row: Column) -> list[Column]:
    return [_doi_in(squash(F.element_at(row, F.lit(k)))) for k in fixed.DOI_KEYS]


def _doi_in(text: Column) -> Column:
    return F.when(text.contains("10."), extract(text, fixed.DOI_PATTERN, 0))  # every DOI holds "10.", a plain substring test


def guess_title(text: Column, embedded: Column, row: Column, lines: int | None = TITLE_LINES) -> Column:
    """Metadata title, else the embedded one, else the first plausible text line."""
    listed = listed_title(row)
    starts = [F.lower(embedded).startswith(p) for p in fixed.EMBEDDED_TITLE_PUBLISHERS]
    usable = (F.coalesce(embedded, F.lit("")) != "") & ~(starts[0] | starts[1] | starts[2])
    first = first_line(text, lines, 12, 260, fixed.TITLE_BOILERPLATE)
    return (
        F.when(listed != "", listed)
        .when(usable, F.substring(embedded, 1, 260))
        .otherwise(F.coalesce(first, F.lit("")))
    )


def guess_title_context(text: Column, embedded: Column, row: Column, lines: int | None = CONTEXT_TITLE_LINES) -> Column:
    """Single-variable variant: other keys, limits and stop fragments."""
    listed = first_filled(*[squash(F.element_at(row, F.lit(k))) for k in ("Paper name", "col3", "")])
    starts = [F.lower(embedded).startswith(p) for p in fixed.CONTEXT_TITLE_PUBLISHERS]
    blocked = starts[0] | starts[1] | starts[2] | starts[3] | starts[4]
    usable = (F.length(F.coalesce(embedded, F.lit(""))) >= 10) & ~blocked
    first = first_line(text, lines, 12, 220, fixed.CONTEXT_TITLE_BOILERPLATE)
    return (
        F.when(listed != "", listed)
        .when(usable, F.substring(embedded, 1, 240))
        .otherwise(F.coalesce(first, F.lit("")))
    )


def guess_year(text: Column, row: Column, chars: int | None = YEAR_CHARS) -> Column:
    opening = opening_of(text, chars)
    found = extract(opening, fixed.YEAR_PATTERN, 1, ignore_case=False)
    return first_filled(*listed_year(row), F.when(opening.contains("19") | opening.contains("20"), found))  # every year holds one of them


def guess_doi(text: Column, row: Column, chars: int | None = DOI_CHARS) -> Column:
    return F.rtrim(first_filled(*listed_doi(row), _doi_in(opening_of(text, chars))), F.lit("."))
