"""The review job: articles -> mentions -> summaries -> relations -> row tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Protocol
from citemill.functions.labels import counts_to_json, first_filled, role_label, yes_no
from citemill.functions.text import has_words, holds_unusual, squash, word_count
from citemill.operators.classify import article_kind, summarize
from citemill.operators.mentions import find_mentions
from citemill.operators.metadata import best_metadata, guess_doi, guess_title, guess_year, listed_doi, listed_title, listed_year, opening_of
from citemill.operators.relations import build_relations
from citemill.session import store

EXTRACTABLE_WORDS = 50


def describe_articles(raw: DataFrame, protocol: Protocol) -> DataFrame:
    """Derived article columns.

    ``raw`` has article_id, source_path, text, pages, embedded_title and metadata. ``protocol.limits`` says how far the rules look into a text.
    """
    text, row, limits = F.col("text"), F.col("metadata"), protocol.limits
    return (
        raw.select(
            "article_id", "source_path", "text", "pages", "metadata",
            guess_title(text, F.col("embedded_title"), row, limits.title_lines).alias("title"),
            guess_year(text, row, limits.year_chars).alias("year"),
            guess_doi(text, row, limits.doi_chars).alias("doi"),
            squash(F.element_at(row, F.lit(fixed.STUDY_TYPE_KEY))).alias("metadata_study_type"),
            word_count(text).alias("word_count"),
        )
        .withColumn("text_extractable", has_words(text, EXTRACTABLE_WORDS))
        .withColumn("article_kind", article_kind(F.col("title"), F.col("metadata_study_type"), text, protocol.cues, limits.kind_chars, holds_unusual(text)))
    )


@dataclass
class Review:
    """The four tables everything else is derived from."""

    protocol: Protocol
    articles: DataFrame
    mentions: DataFrame
    summaries: DataFrame
    relations: DataFrame


CARRIED = (
    "article_id", "source_path", "pages", "title", "year", "doi", "metadata_study_type", "word_count", "text_extractable", "article_kind",
)


def run_review(raw: DataFrame, protocol: Protocol, sources: DataFrame | None = None) -> Review:
    """Run the job once; each stage is a table in the shared folder.

    Articles and mentions come from one narrow pass over the texts, and nothing after it reads a text.
    With ``sources`` (metadata rows, see ``best_metadata``) the ``metadata`` column of ``raw`` is not needed: the
    chosen rows meet the article table, which has no text, and kinds reach the summaries from there.
    """
    if sources is None:
        scan = store(find_mentions(describe_articles(raw, protocol), protocol, CARRIED), "scan")
        articles = scan.where("article IS NOT NULL").select("article.*")
    else:
        bare = raw.withColumn("metadata", F.create_map().cast("map<string,string>"))
        described = describe_articles(bare, protocol).withColumn("article_kind", F.lit(None).cast("string"))
        described = described.withColumn("opening", opening_of(F.col("text"), protocol.limits.kind_chars))
        scan = store(find_mentions(described, protocol, (*CARRIED, "opening")), "scan")
        found = scan.where("article IS NOT NULL").select("article.*")
        articles = store(with_listed(found, best_metadata(raw, sources, chars=protocol.limits.metadata_chars), protocol), "articles")
    mentions = scan.where("start IS NOT NULL").drop("article")
    summaries = store(summarize(mentions, protocol, None if sources is None else articles), "summaries")
    relations = store(build_relations(mentions, summaries, protocol), "relations")
    return Review(protocol, articles, mentions, summaries, relations)


def with_listed(articles: DataFrame, metadata: DataFrame, protocol: Protocol) -> DataFrame:
    """Article columns that a metadata row decides, over those found in the text; ``opening`` is used up."""
    row, listed = F.col("metadata"), listed_title(F.col("metadata"))
    return (
        articles.join(metadata, "article_id", "left")
        .withColumn("title", F.when(F.coalesce(listed, F.lit("")) != "", listed).otherwise(F.col("title")))
        .withColumn("year", first_filled(*listed_year(row), F.col("year")))
        .withColumn("doi", F.rtrim(first_filled(*listed_doi(row), F.col("doi")), F.lit(".")))
        .withColumn("metadata_study_type", squash(F.element_at(row, F.lit(fixed.STUDY_TYPE_KEY))))
        .withColumn("article_kind", article_kind(F.col("title"), F.col("metadata_study_type"), F.col("opening"), protocol.cues, protocol.limits.kind_chars))
        .select(*CARRIED)
    )


def article_rows(articles: DataFrame) -> DataFrame:
    return articles.select(
        "article_id", "source_path", "title", "year", "doi", "metadata_study_type", "article_kind",
        "pages", "word_count", yes_no(F.col("text_extractable")).alias("text_extractable"),
    )


def mention_rows(mentions: DataFrame) -> DataFrame:
    return mentions.select(
        "article_id", "source_path", "entity_type", "entity_id", "label_es", "label_en", "category",
        "matched_text", "section", "page",
        *[yes_no(F.col(f"cue_{c}")).alias(f"cue_{c}") for c in fixed.MENTION_CUES],
        "context", "sentence",
    )


def summary_rows(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "article_id", "entity_type", "entity_id", "label_es", "label_en", "category", "n_mentions",
        counts_to_json(F.col("sections")).alias("sections"), "role", role_label(F.col("role")).alias("role_label"),
        "study_context", "confidence", "confidence_score", "evidence_text",
        F.col("inference_basis").alias("extraction_or_inference"),
    )


def _article_fields(articles: DataFrame, *names: str) -> DataFrame:
    return articles.select("article_id", *names)


def _blank(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit("")).alias(n) for n in names]


def relation_rows(relations: DataFrame, articles: DataFrame) -> DataFrame:
    return relations.join(_article_fields(articles, "title", "year", "doi"), "article_id", "left").select(
        "article_id", *_blank("title", "year", "doi"),
        "entity_a_id", "entity_a_label", "entity_a_category", "entity_b_id", "entity_b_label",
        "entity_b_category", "association", "confidence", "confidence_score", "study_context",
        "section", "evidence_text", "extraction_or_inference",
    )


def review_columns(protocol: Protocol) -> list[str]:
    """Headers of the review table; equal display names get a numeric suffix."""
    a, b = protocol.name_a, protocol.name_b
    named = [f"Variable A: {a}", f"Categoria de {a.lower()}", f"Variable B: {b}",
             f"Asociacion {a.lower()}-{b.lower()}"]
    unique = [n if named[:i].count(n) == 0 else f"{n} ({named[:i].count(n) + 1})" for i, n in enumerate(named)]
    return [
        "ID del articulo", "Titulo", "Año", "DOI", unique[0], unique[1], "Numero de menciones",
        "Rol de la variable A", unique[2], "Rol de la variable B", "Tipo de estudio",
        "Modelo experimental", "Evidencia textual", "Nivel de confianza", unique[3],
        "Seccion de evidencia", "Extraccion o inferencia",
    ]


def review_table(summaries: DataFrame, relations: DataFrame, articles: DataFrame, protocol: Protocol) -> DataFrame:
    """One row per (article, A entity, B entity); A entities without any B keep one row."""
    s = summaries.withColumn("label", first_filled(F.col("label_es"), F.col("label_en")))
    a = s.where("entity_type = 'a'").select(
        "article_id", F.col("entity_id").alias("entity_a_id"), F.col("label").alias("label_a"),
        F.col("category").alias("category_a"), F.col("n_mentions").alias("n_a"), F.col("role").alias("role_a"),
        F.col("study_context").alias("context_a"), F.col("evidence_text").alias("evidence_a"),
        F.col("confidence").alias("confidence_a"), F.col("inference_basis").alias("basis_a"),
    )
    b = s.where("entity_type = 'b'").select(
        "article_id", F.col("entity_id").alias("entity_b_id"), F.col("label").alias("label_b"),
        F.col("role").alias("role_b"),
    )
    r = relations.select(
        "article_id", "entity_a_id", "entity_b_id", "association", F.col("confidence").alias("confidence_r"),
        "section", F.col("evidence_text").alias("evidence_r"), F.col("extraction_or_inference").alias("basis_r"),
    )
    rows = (
        a.join(b, "article_id", "left")
        .join(r, ["article_id", "entity_a_id", "entity_b_id"], "left")
        .join(_article_fields(articles, "title", "year", "doi", "article_kind"), "article_id", "left")
    )
    alone, related = F.col("entity_b_id").isNull(), F.col("association").isNotNull()

    def pick(without_b: Column, with_relation: Column, otherwise: str) -> Column:
        return F.when(alone, without_b).when(related, with_relation).otherwise(otherwise)

    none = F.lit(fixed.NOT_DETECTED)
    values = [
        F.col("article_id"), *[F.coalesce(n, F.lit("")) for n in ("title", "year", "doi")],
        F.col("label_a"), F.col("category_a"), F.col("n_a"), role_label(F.col("role_a")),
        F.when(alone, none).otherwise(F.col("label_b")),
        F.when(alone, none).otherwise(role_label(F.col("role_b"))),
        F.coalesce("article_kind", F.lit("")), F.col("context_a"),
        pick(F.col("evidence_a"), F.col("evidence_r"), ""),
        pick(F.col("confidence_a"), F.col("confidence_r"), ""),
        pick(none, F.col("association"), fixed.NO_EVIDENCE),
        pick(F.lit(""), F.col("section"), ""),
        pick(F.col("basis_a"), F.col("basis_r"), fixed.LITERAL_WITHOUT_RELATION),
    ]
    return rows.select(*[v.alias(n) for v, n in zip(values, review_columns(protocol))])
