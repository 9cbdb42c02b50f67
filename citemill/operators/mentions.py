"""Dictionary mentions with section, page, context, sentence and cue flags.

Shape of the job: one narrow stage. Matches are found per article, exploded, and
each mention is cut from a few neighbouring text blocks instead of the whole text,
so the cost per mention does not grow with the length of its article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Protocol, Term
from citemill.functions import text as tx
from citemill.functions.labels import section_weight
from citemill.functions.regex import is_unusual, matches_any
from citemill.functions.text import BLOCK, EMPTY_SENTENCE_RADIUS
from citemill.operators.scan import find_terms, ranks_among
from citemill.operators.relations import evidence_points
from citemill.operators.sections import section_of, with_sections

def _blocks(text: Column) -> Column:
    """Text as consecutive blocks of ``BLOCK`` characters."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    )


def explode_spans(found: DataFrame, section_starts: Column, left: int, right: int, keep_empty: Column | None = None, distance: int | None = None) -> DataFrame:
    """One row per match: article columns but ``text``, plus mention_idx, the fields of ``find_terms``, section_no, fragment and at.

    ``found`` holds ``find_terms`` as ``hits``; put it beside ``find_headers``, so that a text crosses to Python once.
    ``section_no`` is the number of section starts up to the match. ``fragment`` is the text ``left`` / ``right`` characters around the
    match, which begins at ``at`` in it. Fragments are cut before the matches are exploded, so no row carries the blocks of its article.
    With ``keep_empty`` an article without a match, or where that column is false, has one row with a null match. With ``distance`` the first
    match of each article holds ``quotable``: the text blocks in which a quotation of two matches can begin, each with what follows in reach.

    The outer explode plus filter is deliberate: a plain explode makes the optimizer
    repeat the scan function inside an inferred ``size(hits) > 0`` filter.
    """
    rest = [c for c in found.columns if c not in ("text", "hits", "span_starts")]
    ranked = found.select(*rest, "text", "hits", ranks_among(section_starts, F.transform("hits", lambda h: h["start"])).alias("section_nos"))

    def around(h: Column, blocks: Column) -> Column:
        first = F.greatest(h["start"] - left, F.lit(0))
        low, high = F.floor(first / BLOCK).cast("int"), F.floor((h["end"] + right - 1) / BLOCK).cast("int")
        return tx.cut(F.array_join(F.slice(blocks, low + 1, high - low + 1), ""), first - low * BLOCK, h["end"] + right - low * BLOCK)

    def quotable(blocks: Column) -> Column:
        paired = F.filter("hits", lambda h: h["partners"].isNotNull())
        begins = F.flatten(F.transform(paired, lambda h: F.array(h["start"], h["sentence_from"])))
        numbers = F.array_distinct(F.transform(begins, lambda b: F.floor(b / BLOCK).cast("int")))
        after = 1 + -(-max(distance, 3 * tx.SENTENCE_REACH) // BLOCK)
        return F.transform(numbers, lambda n: F.struct(n.alias("no"), F.array_join(F.slice(blocks, n + 1, F.lit(after)), "").alias("text")))

    # nothing but the generator may read the text, which would travel to every match otherwise
    def placed(text: Column) -> Column:
        blocks = text["blocks"]
        return F.transform("hits", lambda h, i: F.struct(
            h.alias("hit"), F.get("section_nos", i).alias("section_no"), text["chars"].alias("text_chars"), around(h, blocks).alias("fragment"),
            *([F.when(i == 0, quotable(blocks)).alias("quotable")] if distance is not None else [])))

    items = F.when(F.size("hits") > 0, tx.bound(F.struct(F.length("text").alias("chars"), _blocks(F.col("text")).alias("blocks")), placed))
    if keep_empty is not None:
        items = F.when(keep_empty, items)
    rows = ranked.select(*rest, F.posexplode_outer(items).alias("mention_idx", "h")).select("*", "h.*").drop("h")
    rows = (rows if keep_empty is not None else rows.where(F.col("hit").isNotNull())).select("*", "hit.*").drop("hit")
    return rows.withColumn("at", F.least(F.col("start"), F.lit(left)))


def term_fields(terms: tuple[Term, ...]) -> Column:
    """Dictionary columns as one literal array, indexed by term position."""
    return F.array(
        *[
            F.struct(
                F.lit(t.slot).alias("entity_type"), F.lit(t.entity_id).alias("entity_id"),
                F.lit(t.label_es).alias("label_es"), F.lit(t.label_en).alias("label_en"),
                F.lit(t.category).alias("category"), F.lit(t.generic).alias("is_generic"),
            )
            for t in terms
        ]
    )


def mention_score(weights: dict[str, int]) -> Column:
    """Section weight plus the points of every cue that fired."""
    score = section_weight(F.col("section"), weights)
    for cue, points in fixed.CUE_POINTS.items():
        score = score + F.when(F.col(f"cue_{cue}"), points).otherwise(0)
    return (score + F.when(F.col("is_generic"), fixed.GENERIC_POINTS).otherwise(0)).cast("int")


def find_mentions(articles: DataFrame, protocol: Protocol, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of all protocol terms in the extractable articles.

    ``articles`` needs article_id, source_path, text, pages, text_extractable and
    article_kind. Besides the exported columns the result carries ``nth`` (order of a
    mention among those of its term), ``left_text`` / ``right_text`` for concordances, and what relations need without any text:
    ``sentence_key`` (hash of a sentence that quotes the mention), its bounds and points, and ``partners`` (idx, span, points), the later
    mentions of the other slot in reach. The first mention of an article holds its ``quotable`` text blocks.

    ``carry`` names article columns that the first row of each article returns as the struct
    ``article``, so one pass over the texts gives both tables. Every article has a row then; it has a
    null ``start`` where there is no mention.
    """
    if not protocol.terms:
        raise ValueError("the protocol has no terms")
    reach = max(tx.SENTENCE_REACH, protocol.context_radius, protocol.kwic_radius)
    ahead = max(reach, protocol.relation_distance)
    columns = ["article_id", "source_path", "article_kind", "pages"]
    if carry:
        source = articles.select(*columns, "text", "text_extractable", F.struct(*carry).alias("article"))
    else:
        source = articles.where("text_extractable").select(*columns, "text")
    found = source.withColumns({
        "hits": find_terms(F.col("text"), protocol.terms, distance=protocol.relation_distance), "unusual_text": tx.holds_unusual(F.col("text"))})
    hits = explode_spans(
        with_sections(found, protocol.headers), F.col("span_starts"), reach, ahead, F.col("text_extractable") if carry else None, protocol.relation_distance)
    hits = (
        hits.withColumn("section", section_of(F.col("spans"), F.col("section_no")))
        .withColumn("page", tx.page_of(F.col("page_no"), F.col("page_breaks"), F.col("start"), F.col("pages"), F.col("text_chars")))
        .drop("spans")
    )
    size = F.col("end") - F.col("start")
    fragment, at = F.col("fragment"), F.col("at")
    whole = tx.squash(tx.cut(fragment, at - F.col("start") + F.col("sentence_from"), at - F.col("start") + F.col("sentence_to")))
    quoted = (F.col("sentence") != "") & F.col("sentence").contains(tx.squash(F.col("matched_text")))
    # nothing is shared inside a lambda, so the text of a pair, its lower case and the test of its characters become fields before the families meet them
    unusual = lambda part: F.col("unusual_text") & is_unusual(part)
    texts = F.transform("partners", lambda p: F.struct(
        p["idx"].alias("idx"), p["span"].alias("span"), tx.squash(tx.cut(fragment, at, at + p["span"])).alias("text")))
    tested = F.transform(texts, lambda p: F.struct(
        p["idx"].alias("idx"), p["span"].alias("span"), p["text"].alias("text"), F.lower(p["text"]).alias("lowered"), unusual(p["text"]).alias("unusual")))
    joint = lambda p: F.struct(
        p["idx"].alias("idx"), p["span"].alias("span"), evidence_points(p["text"], protocol.cues, p["unusual"], p["lowered"]).cast("int").alias("points"))
    rows = (
        hits.withColumn("matched_text", tx.cut(fragment, at, at + size))
        .withColumn("context", tx.context_window(fragment, at, at + size, protocol.context_radius))
        .withColumn("sentence", F.when(whole != "", whole).otherwise(tx.context_window(fragment, at, at + size, EMPTY_SENTENCE_RADIUS)))
        .withColumn("sentence_from", F.when(whole != "", F.col("sentence_from")).otherwise(F.greatest(F.col("start") - EMPTY_SENTENCE_RADIUS, F.lit(0))))
        .withColumn("sentence_to", F.when(whole != "", F.col("sentence_to")).otherwise(F.col("end") + EMPTY_SENTENCE_RADIUS))
        .withColumn("sentence_key", F.when(quoted, F.unhex(F.md5("sentence"))))
        .withColumn("sentence_points", F.when(F.col("sentence_key").isNotNull() & F.col("partners").isNotNull(), evidence_points(F.col("sentence"), protocol.cues, unusual(F.col("sentence"))).cast("int")))
        .withColumn("partners", F.transform(tested, joint))
        .withColumn("left_text", tx.cut(fragment, at - protocol.kwic_radius, at))
        .withColumn("right_text", tx.cut(fragment, at + size, at + size + protocol.kwic_radius))
        .withColumn("entity", F.element_at(term_fields(protocol.terms), F.col("term") + 1))
        .select("*", "entity.*")
    )
    rows = rows.withColumn("unusual", unusual(F.col("context"))).withColumn("lowered", F.lower("context"))
    for cue in fixed.MENTION_CUES:
        flag = matches_any(F.col("context"), protocol.cues.get(cue, []), F.col("unusual"), F.col("lowered"))
        rows = rows.withColumn(f"cue_{cue}", flag)
    return rows.withColumn("score", mention_score(protocol.weights)).select(
        "article_id", "source_path", "article_kind", "mention_idx", "nth",
        "entity_type", "entity_id", "label_es", "label_en", "category", "is_generic",
        "matched_text", "section", "start", "end", "page", "context", "sentence",
        *[f"cue_{c}" for c in fixed.MENTION_CUES], "score", "left_text", "right_text", "sentence_key", "sentence_points", "sentence_from", "sentence_to", "partners",
        "quotable",
        *([F.when(F.coalesce("mention_idx", F.lit(0)) == 0, F.col("article")).alias("article")] if carry else []),
    )
