"""Single-variable contextual classifier.

Its sections, cues and scores have their own meaning; nothing here is shared with the
two-variable review beyond the text and span operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Limits, Term
from citemill.functions import text as tx
from citemill.functions.labels import lookup, yes_no
from citemill.functions.regex import matches_any
from citemill.operators.groups import exact_median, top_rows
from citemill.operators.mentions import explode_spans
from citemill.operators.metadata import guess_title_context, opening_of
from citemill.operators.scan import find_headers, find_terms

RADIUS = 220
INFORMATIVE = ("title_abstract", "methods", "results", "discussion", "conclusion")
CENTRAL = ("title_abstract", "methods", "results")
WORKED, POSSIBLE, REVIEW, CONTEXT, REFERENCES_ONLY = fixed.CONTEXT_CLASSES


@dataclass(frozen=True)
class ContextProtocol:
    """Terms (label_es is the name, category the family), headers, cues and weights."""

    terms: tuple[Term, ...]
    headers: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.CONTEXT_SECTION_HEADERS))
    weights: dict[str, int] = field(default_factory=lambda: dict(fixed.CONTEXT_SECTION_WEIGHTS))
    cues: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.CONTEXT_CUES))
    limits: Limits = Limits()


def describe_articles(raw: DataFrame, protocol: ContextProtocol) -> DataFrame:
    """Title and kind of ``raw`` (article_id, source_path, text, pages, embedded_title, metadata), as far into the text as ``protocol.limits`` say."""
    text, limits = F.col("text"), protocol.limits
    titled = raw.withColumn("title", guess_title_context(text, F.col("embedded_title"), F.col("metadata"), limits.context_title_lines))
    study = tx.squash(F.element_at("metadata", F.lit(fixed.STUDY_TYPE_KEY)))
    return titled.withColumn("article_kind", article_kind(F.col("title"), study, text, protocol.cues, limits.context_kind_chars))


def article_kind(title: Column, study_type: Column, text: Column, cues: dict[str, list[str]], chars: int | None = Limits().context_kind_chars) -> Column:
    metadata = F.concat_ws(" ", title, study_type)
    return (
        F.when(matches_any(metadata, cues.get("review", [])), "revision_o_sintesis")
        .when(matches_any(metadata, cues.get("epidemiology", [])), "epidemiologico_observacional")
        .when(
            matches_any(metadata, cues.get("preclinical_metadata", []))
            | matches_any(opening_of(text, chars), cues.get("preclinical_text", [])),
            "preclinico_experimental",
        )
        .otherwise("no_determinado")
    )


def with_markers(articles: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """Add ``markers``: every header match opens a section; on one offset the later wins."""
    order = F.array(*[F.lit(s) for s in headers])
    found = F.transform(
        "headers",
        lambda h: F.struct(
            h["start"].alias("start"), F.array_position(order, h["section"]).cast("int").alias("rank"),
            h["section"].alias("name"),
        ),
    )
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("rank"), F.lit("title_abstract").alias("name")))
    marker = "array<struct<start:int,rank:int,name:string>>"
    return articles.withColumn("headers", find_headers(F.col("text"), headers)).withColumn(
        "markers", F.array_sort(F.concat(first, found).cast(marker))
    ).drop("headers")


def section_of(markers: Column, rank: Column, position: Column, length: Column) -> Column:
    """Section of the marker of that number, counted from 1. The opening of an article always counts as title and abstract."""
    opening = F.least(F.lit(3500), F.greatest(F.lit(1200), F.floor(length * 0.04)))
    return F.when(position < opening, "title_abstract").when(rank > 0, F.get(markers, rank - 1)["name"]).otherwise("other")


def mention_score(weights: dict[str, int]) -> Column:
    score = lookup(F.col("section"), weights, F.lit(1))
    for cue, points in fixed.CONTEXT_CUE_POINTS.items():
        score = score + F.when(F.col(f"{cue}_cue"), points).otherwise(0)
    return (score + F.when(F.col("generic_term"), fixed.GENERIC_POINTS).otherwise(0)).cast("int")


def find_mentions(articles: DataFrame, protocol: ContextProtocol) -> DataFrame:
    """All matches (overlaps count, equal spans once) with section, page and cues.

    ``articles`` has article_id, source_path, title, text, page_starts and article_kind.
    """
    source = articles.select("article_id", "source_path", "title", "article_kind", "page_starts", "text")
    found = source.withColumn("hits", find_terms(F.col("text"), protocol.terms, keep_overlaps=True, page_starts=F.col("page_starts")))
    starts = F.transform("markers", lambda m: m["start"])
    hits = explode_spans(with_markers(found, protocol.headers), starts, RADIUS, RADIUS)
    hits = (
        hits.withColumn("section", section_of(F.col("markers"), F.col("section_no"), F.col("start"), F.col("text_chars")))
        .withColumn("page", F.greatest(F.lit(1), F.col("page_no")))
    )
    names = F.array(*[
        F.struct(F.lit(t.label_es).alias("contaminant"), F.lit(t.category).alias("family"), F.lit(t.generic).alias("generic_term"))
        for t in protocol.terms
    ])
    size = F.col("end") - F.col("start")
    rows = (
        hits.withColumn("entity", F.element_at(names, F.col("term") + 1))
        .withColumn("matched_text", tx.cut(F.col("fragment"), F.col("at"), F.col("at") + size))
        .withColumn("context", tx.squash(F.col("fragment")))
        .select("*", "entity.*")
    )
    for cue in fixed.CONTEXT_CUE_POINTS:
        rows = rows.withColumn(f"{cue}_cue", matches_any(F.col("context"), protocol.cues.get(cue, [])))
    return rows.withColumn("score", mention_score(protocol.weights)).select(
        "article_id", "source_path", "title", "article_kind", "mention_idx", "nth", "contaminant", "family", "generic_term",
        "matched_text", "section", "start", "end", "page", "context",
        *[f"{c}_cue" for c in fixed.CONTEXT_CUE_POINTS], "score",
    )


def classify(kind: Column, n: Column, score: Column, sections: dict[str, Column], exposure: Column, dose: Column) -> Column:
    def total(names) -> Column:
        out = F.lit(0)
        for s in names:
            out = out + sections[s]
        return out

    informative, central = total(INFORMATIVE), total(CENTRAL)
    opening = sections["title_abstract"]
    central_evidence = (
        (sections["methods"] > 0) | (sections["results"] > 0) | (opening >= 2) | ((opening >= 1) & (dose >= 1))
    )
    background_only = (sections["introduction"] + sections["references"] == n) & (informative == 0)
    return (
        F.when(kind == "revision_o_sintesis", REVIEW)
        .when(sections["references"] == n, REFERENCES_ONLY)
        .when(background_only & (exposure == 0) & (dose == 0), CONTEXT)
        .when(
            (score >= 12) & (central > 0) & central_evidence & ((exposure > 0) | (dose > 0) | (sections["methods"] > 0)),
            WORKED,
        )
        .when((score >= 6) & (informative > 0), POSSIBLE)
        .otherwise(CONTEXT)
    )


def summarize(mentions: DataFrame, max_contexts: int = 3) -> DataFrame:
    """One row per (article, contaminant) with class, counts and best contexts."""
    key = ["article_id", "contaminant"]
    place = F.when(F.col("section").isin(*CENTRAL), 0).otherwise(1)
    order = [place, F.col("exposure_cue").desc(), F.col("dose_cue").desc(), "page", "nth"]
    quote = F.concat(F.lit("p."), F.col("page"), F.lit(" ["), F.col("section"), F.lit("] "), F.col("context"))
    names = list(dict.fromkeys([*fixed.CONTEXT_SECTION_WEIGHTS]))
    # counts are partial aggregates without text; contexts are ranked with a limit that holds in each task before the shuffle
    counts = mentions.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("source_path", "title", "article_kind", "family")],
        F.sum("score").alias("score"), F.count("*").alias("n"),
        *[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in names],
        *[F.count_if(f"{c}_cue").alias(f"n_{c}") for c in fixed.CONTEXT_CUE_POINTS],
    )
    best = top_rows(mentions.select(*key, "section", "exposure_cue", "dose_cue", "page", "nth", quote.alias("q")), key, order, max_contexts, "no")
    rows = counts.join(best.groupBy(*key).agg(F.collect_list(F.struct("no", "q")).alias("quotes")), key)
    label = classify(
        F.col("article_kind"), F.col("n"), F.col("score"), {s: F.col(f"n_{s}") for s in names},
        F.col("n_exposure"), F.col("n_dose"),
    )
    order = ("title_abstract", "introduction", "methods", "results", "discussion", "conclusion", "references", "other")
    return rows.select(
        "article_id", F.col("source_path").alias("pdf_path"), "title", "article_kind", F.col("family").alias("familia"),
        F.col("contaminant").alias("contaminante"), label.alias("clasificacion"),
        F.col("score").alias("score_contextual"), F.col("n").alias("menciones_totales"),
        *[F.col(f"n_{s}").alias(f"menciones_{s}") for s in order],
        F.col("n_exposure").alias("menciones_con_cue_exposicion"), F.col("n_dose").alias("menciones_con_cue_dosis"),
        F.col("n_background").alias("menciones_con_cue_fondo"),
        F.array_join(F.transform(F.array_sort("quotes"), lambda q: q["q"]), " || ").alias("ejemplos_contexto"),
    )


def article_table(summaries: DataFrame, top: int = 8) -> DataFrame:
    """Best names per class and counts per class of every article."""
    groups = {
        "contaminantes_trabajados": [WORKED], "contaminantes_posibles_secundarios": [POSSIBLE],
        "contaminantes_en_revision": [REVIEW], "contaminantes_solo_contexto": [CONTEXT, REFERENCES_ONLY],
    }
    group = F.when(F.col("clasificacion") == WORKED, "contaminantes_trabajados").when(
        F.col("clasificacion") == POSSIBLE, "contaminantes_posibles_secundarios"
    ).when(F.col("clasificacion") == REVIEW, "contaminantes_en_revision").otherwise("contaminantes_solo_contexto")
    name = F.concat("contaminante", F.lit(" ("), F.col("familia"), F.lit(")"))
    grouped = summaries.select("article_id", group.alias("group"), "score_contextual", "menciones_totales", "contaminante", name.alias("t"))
    best = top_rows(grouped, ["article_id", "group"], [F.col("score_contextual").desc(), F.col("menciones_totales").desc(), "contaminante"], top, "no")

    def names(label: str) -> Column:
        picked = F.collect_list(F.when(F.col("group") == label, F.struct("no", "t")))
        return F.array_join(F.transform(F.array_sort(picked), lambda s: s["t"]), "; ").alias(label)

    counts = summaries.groupBy("article_id").agg(
        F.first("title").alias("title"), F.first("article_kind").alias("article_kind"),
        F.count_if(F.col("clasificacion") == WORKED).alias("n_contaminantes_trabajados"),
        F.count_if(F.col("clasificacion") == POSSIBLE).alias("n_contaminantes_posibles"),
        F.count_if(F.col("clasificacion").isin(CONTEXT, REFERENCES_ONLY)).alias("n_contaminantes_contexto"),
        F.sum("menciones_totales").alias("menciones_totales"),
    )
    return counts.join(best.groupBy("article_id").agg(*[names(g) for g in groups]), "article_id").select(
        "article_id", "title", "article_kind", *groups, *[c for c in counts.columns if c.startswith("n_")], "menciones_totales")


def category_table(summaries: DataFrame) -> DataFrame:
    """Distinct articles and mentions per family and class, with totals."""
    per_article = summaries.groupBy("familia", "clasificacion", "article_id").agg(F.sum("menciones_totales").alias("m"))
    cells = per_article.groupBy("familia", "clasificacion").agg(F.count("*").alias("articles"), F.sum("m").alias("m"))
    total = summaries.groupBy("familia").agg(
        F.count_distinct("article_id").alias("articulos_total"), F.sum("menciones_totales").alias("menciones_total")
    )
    zero = F.lit(0).cast("long")

    def cell(column: str, label: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("clasificacion") == label, F.col(column))), zero)

    wide = cells.groupBy("familia").agg(*[
        e for c in fixed.CONTEXT_CLASSES
        for e in (cell("articles", c).alias(f"articulos_{c}"), cell("m", c).alias(f"menciones_{c}"))
    ])
    return wide.join(total, "familia")


def diagnostics(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pages, words, mentions and extractability per article."""
    found = mentions.groupBy("article_id").agg(F.count("*").alias("mentions_found"))
    return articles.join(found, "article_id", "left").select(
        "article_id", F.col("source_path").alias("pdf_path"), "title", "article_kind", "pages",
        F.col("word_count").alias("word_count_estimate"),
        F.coalesce("mentions_found", F.lit(0).cast("long")).alias("mentions_found"),
        yes_no(F.col("word_count") >= 50).alias("text_extractable"),
    )


def mention_rows(mentions: DataFrame) -> DataFrame:
    return mentions.select(
        "article_id", F.col("source_path").alias("pdf_path"), "page", "title", "article_kind",
        F.col("family").alias("familia"), F.col("contaminant").alias("contaminante"), "matched_text", "section",
        F.col("score").alias("score_mencion"),
        *[yes_no(F.col(f"{c}_cue")).alias(f"{c}_cue") for c in ("exposure", "dose", "background")],
        yes_no(F.col("generic_term")).alias("generic_term"), "context",
    )


def report_numbers(articles: DataFrame, mentions: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row: corpus size, class counts and median score."""
    median = exact_median(summaries.withColumn("all", F.lit(1)), ["all"], "score_contextual").select("median").scalar()
    n_mentions = mentions.agg(F.count("*").alias("n")).scalar()
    counts = summaries.agg(
        F.count_if(F.col("clasificacion") == WORKED).alias("worked"),
        F.count_if(F.col("clasificacion") == POSSIBLE).alias("possible"),
        F.count_if(F.col("clasificacion").isin(CONTEXT, REFERENCES_ONLY)).alias("context_only"),
    )
    return counts.select(
        articles.agg(F.count("*").alias("n")).scalar().alias("articles"),
        articles.agg(F.count_if(F.col("word_count") < 50).alias("n")).scalar().alias("without_text"),
        n_mentions.alias("mentions"), "worked", "possible", "context_only",
        F.coalesce(median, F.lit(0.0)).alias("median_score"),
    )


def top_families(categories: DataFrame, limit: int = 12) -> DataFrame:
    return categories.orderBy(F.col(f"articulos_{WORKED}").desc(), "familia").limit(limit).select(
        "familia", *[f"articulos_{c}" for c in (WORKED, POSSIBLE, CONTEXT)]
    )


def worked_names(summaries: DataFrame, limit: int = 25) -> DataFrame:
    return summaries.where(F.col("clasificacion") == WORKED).groupBy("contaminante").agg(
        F.count("*").alias("articles")
    ).orderBy(F.col("articles").desc(), "contaminante").limit(limit)


def mentions_by_section(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("section").agg(F.count("*").alias("mentions")).orderBy(F.col("mentions").desc(), "section")
