"""Article kinds and article-entity summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Limits, Protocol
from citemill.functions.regex import contains_any, is_unusual, matches_any
from citemill.operators.groups import top_rows

KEY = ["article_id", "entity_type", "entity_id"]
# Limits of the reference rules, each the default of a parameter; None lifts it.
EVIDENCE_ROWS = 3
CONTEXT_ROWS = 8
OPENING_CHARS = Limits().kind_chars


def article_kind(title: Column, study_type: Column, text: Column, cues: dict[str, list[str]], chars: int | None = OPENING_CHARS,
                 unusual_text: Column | None = None) -> Column:
    """First matching study design, from metadata and the opening of the text. Pass ``unusual_text`` (see ``holds_unusual``) where it is known."""
    metadata = F.concat_ws(" ", title, study_type)
    opening = F.concat_ws(" ", metadata, text if chars is None else F.substring(text, 1, chars))
    lowered = F.lower(metadata)

    # the opening contains the metadata, so one test of its characters serves both
    unusual = is_unusual(opening) if unusual_text is None else is_unusual(metadata) | (unusual_text & is_unusual(opening))

    def fires(family: str, where: Column) -> Column:
        return matches_any(where, cues.get(family, []), unusual)

    return (
        F.when(fires("review", opening), "review_or_synthesis")
        .when(fires("in_vitro", opening), "experimental_in_vitro")
        .when(fires("in_vivo", opening), "experimental_in_vivo")
        .when(contains_any(lowered, fixed.PRECLINICAL_WORDS), "experimental_preclinical")
        .when(
            fires("human", metadata) | contains_any(lowered, fixed.EPIDEMIOLOGY_WORDS),
            "human_epidemiological",
        )
        .otherwise("unclear")
    )


def confidence_tier(score: Column, central: Column, cues: Column) -> Column:
    return (
        F.when((score >= 18) & (central > 0) & (cues > 0), "Alta")
        .when((score >= 8) & (central > 0), "Media")
        .otherwise("Baja")
    )


def study_context(kind: Column, contexts: Column, cues: dict[str, list[str]]) -> Column:
    def is_model(family: str, name: str) -> Column:
        return (kind == name) | matches_any(contexts, cues.get(family, []))

    names = fixed.STUDY_CONTEXT
    return (
        F.when(is_model("human", "human_epidemiological"), names["human"])
        .when(is_model("in_vitro", "experimental_in_vitro"), names["in_vitro"])
        .when(is_model("in_vivo", "experimental_in_vivo"), names["in_vivo"])
        .when(kind == "review_or_synthesis", names["review"])
        .otherwise(names["unclear"])
    )


def assign_role(kind: Column, n: Column, in_references: Column, score: Column, central: Column,
                peripheral: Column, direct: Column, association: Column) -> tuple[Column, Column]:
    """Role id and how it was reached; the first rung that holds wins."""
    role = (
        F.when(kind == "review_or_synthesis", "role_review_mention")
        .when((in_references == n) & (n > 0), "role_bibliographic_only")
        .when((central > 0) & (score >= 16) & (direct > 0), "role_primary_focus")
        .when((central > 0) & ((direct > 0) | (association > 0)), "role_probable_focus")
        .when((central > 0) & (score >= 8), "role_secondary_variable")
        .when(peripheral > 0, "role_intro_discussion_only")
        .otherwise("role_unclear")
    )
    inferred = role.isin("role_primary_focus", "role_probable_focus", "role_secondary_variable")
    return role, F.when(inferred, fixed.INFERRED).otherwise(fixed.LITERAL)


def evidence_rank() -> list[Column]:
    """Order of quotation: central first, bibliography last, then cues and score."""
    place = (
        F.when(F.col("section").isin(*fixed.CENTRAL_SECTIONS), 0)
        .when(F.col("section") == fixed.TERMINAL_SECTION, 2)
        .otherwise(1)
    )
    return [
        place, F.col("cue_dose").desc(), F.col("cue_exposure").desc(), F.col("score").desc(),
        F.col("mention_idx"),
    ]


def summarize(mentions: DataFrame, protocol: Protocol, kinds: DataFrame | None = None, quotes: int | None = EVIDENCE_ROWS,
              contexts: int | None = CONTEXT_ROWS) -> DataFrame:
    """One row per (article, slot, entity).

    Counts and scores are partial aggregates without any text. The best quotations are ranked with a
    limit that Spark applies in each task before the shuffle, and only the first contexts are
    shuffled at all, so an entity with most of the mentions costs a few rows a task.
    ``mentions`` is read three times, so it should be a stage table, not a plan over texts.
    ``kinds`` (article_id, article_kind) replaces the kinds of the mention table. ``quotes`` and ``contexts`` say how
    many of a group are kept; None keeps all, and then gathers them in one row.
    """
    scored = F.col("section") != fixed.TERMINAL_SECTION
    counts = [F.count_if(F.col("section") == s).alias(f"n_{s}") for s in protocol.sections]
    firsts = [
        F.min(F.when(F.col("section") == s, F.col("mention_idx"))).alias(f"first_{s}")
        for s in protocol.sections
    ]
    totals = mentions.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in ("label_es", "label_en", "category", "article_kind")],
        F.count("*").cast("int").alias("n_mentions"),
        *counts, *firsts,
        F.sum(F.when(scored, F.col("score")).otherwise(0)).cast("int").alias("confidence_score"),
        F.count_if(scored & (F.col("cue_exposure") | F.col("cue_dose"))).alias("direct"),
        F.count_if(scored & F.col("cue_association")).alias("associated"),
    )
    quote = F.concat(
        F.lit("p."), F.col("page"), F.lit(" ["), F.col("section"), F.lit("] "), F.col("context")
    )
    best = top_rows(
        mentions.select(*KEY, "section", "cue_dose", "cue_exposure", "score", "mention_idx", quote.alias("quote")),
        KEY, evidence_rank(), (1 << 31) - 1 if quotes is None else quotes, "evidence_no")
    quoted = best.groupBy(*KEY).agg(F.collect_list(F.struct("evidence_no", "quote")).alias("quotes"))
    first = mentions if contexts is None else mentions.where(F.col("nth") < contexts)
    read = first.groupBy(*KEY).agg(F.collect_list(F.struct("nth", "context")).alias("contexts"))
    rows = totals.join(quoted, KEY).join(read, KEY)
    if kinds is not None:
        rows = rows.drop("article_kind").join(kinds.select("article_id", "article_kind"), "article_id")

    def total(names) -> Column:
        return reduce(lambda x, y: x + y, [F.col(f"n_{s}") for s in names if s in protocol.sections], F.lit(0))

    central, peripheral = total(fixed.CENTRAL_SECTIONS), total(fixed.PERIPHERAL_SECTIONS)
    role, basis = assign_role(
        F.col("article_kind"), F.col("n_mentions"), total([fixed.TERMINAL_SECTION]),
        F.col("confidence_score"), central, peripheral, F.col("direct"), F.col("associated"),
    )
    seen = F.array_sort(
        F.array(
            *[
                F.struct(F.col(f"first_{s}").alias("at"), F.lit(s).alias("name"), F.col(f"n_{s}").cast("int").alias("n"))
                for s in protocol.sections
            ]
        )
    )
    context_text = F.array_join(F.transform(F.array_sort("contexts"), lambda c: c["context"]), " ")
    return rows.select(
        *KEY, "label_es", "label_en", "category", "n_mentions",
        F.map_from_entries(
            F.transform(F.filter(seen, lambda s: s["n"] > 0), lambda s: F.struct(s["name"], s["n"]))
        ).alias("sections"),
        role.alias("role"),
        study_context(F.col("article_kind"), context_text, protocol.cues).alias("study_context"),
        confidence_tier(F.col("confidence_score"), central, F.col("direct") + F.col("associated")).alias("confidence"),
        "confidence_score",
        F.array_join(F.transform(F.array_sort("quotes"), lambda q: q["quote"]), " || ").alias("evidence_text"),
        basis.alias("inference_basis"),
    )
