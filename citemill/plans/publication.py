"""Publication tables: concordance, term matrices, co-occurrence, sensitivity, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Protocol
from citemill.functions.labels import clip, counts_to_json, first_filled, lookup, relation_weight, section_weight, yes_no
from citemill.operators.groups import first_ids
from citemill.operators.sampling import sample_coverage, stratified_sample

META = ["title", "year", "doi"]
ROLE_STRATA = ["entity_type", "algorithm_role", "algorithm_confidence"]
RELATION_STRATA = ["algorithm_association", "algorithm_confidence"]
HUMAN = ("human_confidence", "correct_evidence", "reviewer_notes")


def kwic(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """Keyword in context. The contexts were cut during the scan; no text is joined."""
    return mentions.join(articles.select("article_id", *META), "article_id", "left").select(
        "article_id", *[F.coalesce(c, F.lit("")).alias(c) for c in META],
        "entity_type", "entity_id", "label_es", "label_en", "category", "matched_text", "section", "page",
        clip(F.col("left_text"), 900).alias("left_context"), F.col("matched_text").alias("keyword"),
        clip(F.col("right_text"), 900).alias("right_context"), clip(F.col("sentence"), 1400).alias("sentence"),
        *[yes_no(F.col(f"cue_{c}")).alias(f"cue_{c}") for c in fixed.MENTION_CUES],
    )


def term_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per (article, entity), sparse."""
    return mentions.groupBy("article_id", "entity_type", "entity_id").agg(
        *[F.first(c).alias(c) for c in ("label_es", "label_en", "category")], F.count("*").alias("n")
    )


def corpus_size(articles: DataFrame) -> tuple[Column, Column]:
    """Number and words of the extractable articles, as scalar subqueries."""
    totals = articles.where("text_extractable").agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), "word_count")).alias("words")
    )
    return totals.select("n").scalar(), totals.select("words").scalar()


def idf(df: Column, n: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def term_column(slot: Column, label_es: Column, label_en: Column, entity_id: Column) -> Column:
    return F.concat_ws("::", slot, first_filled(label_es, label_en, entity_id), entity_id)


def term_values(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """Long form of the three matrices: count, per 10k words, TF-IDF; zeros left out."""
    counts = term_counts(mentions)
    n, _ = corpus_size(articles)
    frequency = counts.groupBy("entity_type", "entity_id").agg(F.count("*").alias("df"))
    words = articles.where("text_extractable").select("article_id", "word_count")
    # one row per dictionary entry at most: adaptive execution broadcasts it when small, and splits a frequent entity otherwise
    return (
        counts.join(frequency, ["entity_type", "entity_id"])
        .join(words, "article_id")
        .select(
            "article_id", "entity_type", "entity_id",
            term_column(F.col("entity_type"), F.col("label_es"), F.col("label_en"), F.col("entity_id")).alias("column"),
            F.col("n"),
            (F.col("n") / F.greatest(F.lit(1), "word_count") * 10000).alias("per_10k"),
            (F.log1p("n") * idf(F.col("df"), n)).alias("tfidf"),
        )
    )


def term_matrix(mentions: DataFrame, articles: DataFrame, slot: str, value: str) -> DataFrame:
    """Dense article x entity matrix of one slot; ``value`` is n, per_10k or tfidf.

    One column per entity seen in the corpus; their names are a bounded list (at most the
    dictionary) and the only thing read by the driver.
    """
    values = term_values(mentions.where(F.col("entity_type") == slot), articles)
    names = [r[0] for r in mentions.where(F.col("entity_type") == slot).select(
        "entity_type", "entity_id", "label_es", "label_en").distinct().orderBy("entity_id").select(
        term_column(F.col("entity_type"), F.col("label_es"), F.col("label_en"), F.col("entity_id"))).collect()]
    zero = F.lit(0).cast("long" if value == "n" else "double")
    meta = articles.where("text_extractable").select("article_id", *META, "article_kind", "word_count")
    if not names:
        return meta
    wide = values.groupBy("article_id").agg(
        *[F.sum(F.when(F.col("column") == c, F.col(value))).alias(c) for c in names]
    )
    return meta.join(wide, "article_id", "left").select(
        *meta.columns, *[F.coalesce(F.col(f"`{c}`"), zero).alias(c) for c in names]
    )


def entity_frequency(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    n, words = corpus_size(articles)
    rows = term_counts(mentions).groupBy("entity_type", "entity_id").agg(
        *[F.first(c).alias(c) for c in ("label_es", "label_en", "category")],
        F.sum("n").alias("raw_mentions"), F.count("*").alias("articles_with_mentions"),
    )
    df, raw = F.col("articles_with_mentions"), F.col("raw_mentions")
    return rows.select(
        "*", (df / n).alias("document_frequency"), idf(df, n).alias("idf"),
        (raw / words * 10000).alias("mentions_per_10k_words_corpus"),
        (raw / n).alias("mean_mentions_per_article"),
    ).orderBy("entity_type", F.col("raw_mentions").desc(), "entity_id")


def article_pairs(mentions: DataFrame) -> DataFrame:
    """A and B entities that occur in one article: at most |A| x |B| rows per article."""
    seen = mentions.select("article_id", "entity_type", "entity_id", "label_es", "label_en", "category").distinct()

    def side(slot: str) -> DataFrame:
        return seen.where(F.col("entity_type") == slot).select(
            "article_id", F.col("entity_id").alias(f"entity_{slot}_id"),
            first_filled(F.col("label_es"), F.col("label_en")).alias(f"entity_{slot}_label"),
            F.col("category").alias(f"entity_{slot}_category"),
        )

    return side("a").join(side("b"), "article_id")


PAIR = ["entity_a_id", "entity_b_id"]
PAIR_LABELS = ["entity_a_label", "entity_a_category", "entity_b_label", "entity_b_category"]


def cooccurrence(mentions: DataFrame, relations: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs seen in one article against pairs backed by a quotation."""
    together = article_pairs(mentions)
    backed = relations.where(F.col("association") != fixed.NO_EVIDENCE)
    labels = [F.first(c).alias(c) for c in PAIR_LABELS]
    by_article = together.groupBy(*PAIR).agg(
        *labels, F.count("*").alias("n_together"), F.min("article_id").alias("first_id")
    ).join(first_ids(together, PAIR, "article_id", 20, "ids_together"), PAIR)
    by_evidence = backed.groupBy(*PAIR).agg(
        *[F.first(c).alias(f"r_{c}") for c in PAIR_LABELS],
        F.count_distinct("article_id").alias("n_backed"), F.count("*").alias("n_relations"),
        F.sum(relation_weight(F.col("association"), F.col("confidence"))).alias("weight"),
    ).join(first_ids(backed, PAIR, "article_id", 20, "ids_backed"), PAIR)
    zero = F.lit(0).cast("long")
    n_together, n_backed = F.coalesce("n_together", zero), F.coalesce("n_backed", zero)
    titles = articles.select(F.col("article_id").alias("first_id"), "title")
    return (
        by_article.join(by_evidence, PAIR, "full")
        .join(titles, "first_id", "left")
        .select(
            *[F.coalesce(c, f"r_{c}").alias(c) for c in PAIR_LABELS],
            n_together.alias("article_level_n_articles"),
            n_backed.alias("evidence_level_n_articles"),
            F.coalesce("n_relations", zero).alias("evidence_level_n_relations"),
            F.coalesce("weight", F.lit(0.0)).alias("weighted_evidence_score"),
            F.greatest(zero, n_together - n_backed).alias("possible_article_level_false_positives"),
            F.coalesce("ids_together", F.lit("")).alias("article_ids_article_level"),
            F.coalesce("ids_backed", F.lit("")).alias("article_ids_evidence_level"),
            F.when(n_backed > 0, "evidence_backed_pair")
            .otherwise("article_level_cooccurrence_only_manual_check_required").alias("interpretation"),
            F.coalesce("title", F.lit("")).alias("example_title"),
        )
        .orderBy(
            F.col("weighted_evidence_score").desc(), F.col("evidence_level_n_articles").desc(),
            F.col("article_level_n_articles").desc(), *PAIR_LABELS,
        )
    )


def weight_sensitivity(summaries: DataFrame, protocol: Protocol) -> DataFrame:
    """Section score of every summary under the live weights and the fixed profiles."""

    def score(weight) -> Column:
        return F.aggregate(
            F.map_entries("sections"), F.lit(0), lambda acc, e: acc + e["value"] * weight(e["key"])
        )

    profiles = [
        score(lambda s, w=w: lookup(s, w, F.lit(w.get("other", 0)))).alias(f"{name}_section_score")
        for name, w in fixed.SECTION_PROFILES.items()
    ]
    return summaries.select(
        "article_id", "entity_type", "entity_id", "label_es", "category", "role", "confidence", "n_mentions",
        counts_to_json(F.col("sections")).alias("sections"),
        score(lambda s: section_weight(s, protocol.weights)).alias("active_configured_section_score"),
        *profiles,
    )


def role_template(summaries: DataFrame, articles: DataFrame, n: int, seed: int = fixed.SEED) -> DataFrame:
    """Sampled summaries with blank reviewer columns."""
    rows = summaries.select(
        "article_id", "entity_type", "entity_id", "label_es", "category", F.col("role").alias("algorithm_role"),
        F.col("confidence").alias("algorithm_confidence"), "n_mentions",
        counts_to_json(F.col("sections")).alias("sections"), "evidence_text",
    )
    drawn = stratified_sample(rows, ROLE_STRATA, ["article_id", "entity_type", "entity_id"], n, seed)
    rank = lookup(F.col("algorithm_confidence"), fixed.CONFIDENCE_WEIGHTS, F.lit(0.0))
    return drawn.join(articles.select("article_id", "title"), "article_id", "left").orderBy(
        rank, F.col("n_mentions").desc(), "article_id", "entity_type", "entity_id"
    ).select(
        "article_id", F.coalesce("title", F.lit("")).alias("title"), "entity_type", "label_es", "category",
        "algorithm_role", "algorithm_confidence", "n_mentions", "sections", "evidence_text",
        *[F.lit("").alias(c) for c in ("human_role", *HUMAN)],
    )


def relation_template(relations: DataFrame, articles: DataFrame, n: int, seed: int = fixed.SEED) -> DataFrame:
    """Sampled relations with blank reviewer columns."""
    rows = relations.select(
        "article_id", "entity_a_id", "entity_b_id", *PAIR_LABELS,
        F.col("association").alias("algorithm_association"), F.col("confidence").alias("algorithm_confidence"),
        "confidence_score", "section", "evidence_text",
    )
    drawn = stratified_sample(rows, RELATION_STRATA, ["article_id", *PAIR], n, seed)
    return drawn.join(articles.select("article_id", "title"), "article_id", "left").orderBy(
        "algorithm_association", F.col("confidence_score").desc(), "article_id", *PAIR
    ).select(
        "article_id", F.coalesce("title", F.lit("")).alias("title"), *PAIR_LABELS, "algorithm_association",
        "algorithm_confidence", "confidence_score", "section", "evidence_text",
        *[F.lit("").alias(c) for c in ("human_association", *HUMAN)],
    )


def corpus_totals(articles: DataFrame, mentions: DataFrame, summaries: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of run counts with a warning when nothing was found."""

    def size(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    counted = articles.agg(
        F.count("*").alias("n_articles"), F.count_if("text_extractable").alias("n_extractable_articles")
    ).select(
        "*", size(mentions).alias("n_mentions"), size(summaries).alias("n_entity_summaries"),
        size(relations).alias("n_relations"),
    )
    warning = (
        F.when(F.col("n_articles") == 0, "")
        .when(F.col("n_mentions") == 0, "no pattern matched the corpus")
        .when(F.col("n_relations") == 0, "mentions but no relation within the configured distance")
        .otherwise("")
    )
    return counted.withColumn("warning", warning)


def run_summary(totals: DataFrame, role_sample: DataFrame, relation_sample: DataFrame, protocol: Protocol) -> DataFrame:
    """Counts, sampling coverage and parameters of a run in one row."""
    roles = sample_coverage(role_sample, ROLE_STRATA, "entity_roles")
    pairs = sample_coverage(relation_sample, RELATION_STRATA, "relations")
    return totals.select(
        "*",
        *[roles.select(c).scalar().alias(c) for c in roles.columns],
        *[pairs.select(c).scalar().alias(c) for c in pairs.columns],
        F.lit(fixed.SEED).alias("seed"),
        F.lit(protocol.context_radius).alias("context_radius"),
        F.lit(protocol.kwic_radius).alias("kwic_radius"),
        F.lit(protocol.relation_distance).alias("relation_distance"),
        F.lit(protocol.kmeans_k).alias("kmeans_k"),
        F.lit(protocol.validation_sample_size).alias("validation_sample_size"),
        F.lit(protocol.active_profile).alias("active_profile"),
        F.lit(protocol.name).alias("protocol"), F.lit(protocol.name_a).alias("variable_a"),
        F.lit(protocol.name_b).alias("variable_b"),
    )
