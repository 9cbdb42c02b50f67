"""Evidence-backed pairs of an A and a B mention.

Two mentions can be quoted together in two ways, and each way has its own join:

* they resolve to the same sentence. The quotation and its cues are then the same for
  all pairs of that sentence, so the best pair is the best A mention with the best B
  mention; one representative per (sentence, entity) is enough and repeated
  boilerplate never multiplies out. Sentences meet by a 128-bit hash.
* they lie within ``relation_distance`` characters. The scan has swept over the sorted matches of each text and listed these pairs
  with their joint length and points, so one join by (article, mention) adds the other side, and even one huge article spreads over many tasks.

Candidates are integers and short names. They meet in one partial aggregate per (article, A, B) that keeps the best; only then is its
quotation cut, from the text blocks the scan kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Protocol
from citemill.functions.labels import first_filled
from citemill.functions.regex import matches_any
from citemill.functions.text import BLOCK, cut, squash

PAIR = ["article_id", "entity_a_id", "entity_b_id"]


def evidence_section() -> Column:
    """Section of the earlier mention; ties by name, so slots can be swapped."""
    return F.least(*[F.struct(F.col(f"{m}.start").alias("p"), F.col(f"{m}.section").alias("s")) for m in "ab"])["s"]


def evidence_points(evidence: Column, cues: dict[str, list[str]], unusual: Column | None = None, lowered: Column | None = None) -> Column:
    points = F.lit(0)
    for family, value in fixed.EVIDENCE_POINTS.items():
        points = points + F.when(matches_any(evidence, cues.get(family, []), unusual, lowered), value).otherwise(0)
    return points


def association_label(evidence: Column, section: Column, cues: dict[str, list[str]]) -> Column:
    """Negation decides first, then strong, plain and speculative wording."""

    def fires(family: str) -> Column:
        return matches_any(evidence, cues.get(family, []))

    strong = fires("strong_association") & ~fires("speculative")
    central = section.isin(*fixed.CENTRAL_SECTIONS)
    return (
        F.when((evidence == "") | fires("negation"), fixed.NO_EVIDENCE)
        .when(strong & central, "asociacion_fuerte")
        .when(strong | fires("association"), "asociacion_debil")
        .when(fires("speculative"), "mencion_especulativa")
        .otherwise(fixed.NO_EVIDENCE)
    )


def relation_confidence(score: Column, section: Column, association: Column) -> Column:
    central = section.isin(*fixed.CENTRAL_SECTIONS)
    return (
        F.when((association == "asociacion_fuerte") & central & (score >= 12), "Alta")
        .when(association.isin("asociacion_fuerte", "asociacion_debil") & (score >= 6), "Media")
        .otherwise("Baja")
    )


def _candidates(rows: DataFrame, points: Column, begin: Column, end: Column) -> DataFrame:
    """Rows of two mentions ``a`` and ``b`` as candidate pairs; the quotation is text[begin, end)."""
    return rows.select(
        "article_id", F.col("a.entity_id").alias("entity_a_id"), F.col("b.entity_id").alias("entity_b_id"),
        F.col("a.mention_idx").alias("mention_idx_a"), F.col("b.mention_idx").alias("mention_idx_b"),
        (F.col("a.score") + F.col("b.score") + points).cast("int").alias("confidence_score"),
        evidence_section().alias("section"), begin.alias("begin"), end.alias("end"), F.col("a.article_kind").alias("article_kind"),
    )


def sentence_pairs(mentions: DataFrame) -> DataFrame:
    """Best A and best B mention of every sentence that quotes both."""
    m = F.struct("entity_id", "mention_idx", "start", "section", "score", "article_kind", "sentence_points", "sentence_from", "sentence_to")
    best = mentions.where("sentence_key IS NOT NULL AND partners IS NOT NULL").groupBy("article_id", "sentence_key", "entity_type", "entity_id").agg(
        F.max_by(m, F.struct(F.col("score"), -F.col("mention_idx"))).alias("m"))
    side = lambda slot: best.where(F.col("entity_type") == slot).select("article_id", "sentence_key", F.col("m").alias(slot))
    pairs = side("a").join(side("b"), ["article_id", "sentence_key"])
    return _candidates(pairs, F.col("a.sentence_points"), F.col("a.sentence_from"), F.col("a.sentence_to"))


def near_pairs(mentions: DataFrame) -> DataFrame:
    """Pairs in reach of each other that no sentence quotes."""
    m = F.struct("entity_type", "entity_id", "mention_idx", "start", "section", "score", "article_kind", "sentence_key").alias("m")
    first = mentions.where(F.size("partners") > 0).select("article_id", m, F.explode("partners").alias("p")).select(
        "article_id", F.col("m").alias("first"), F.col("p.idx").alias("idx"), F.col("p.span").alias("span"), F.col("p.points").alias("points"))
    other = mentions.where("partners IS NOT NULL").select("article_id", F.col("mention_idx").alias("idx"), m.alias("other"))
    quoted = F.coalesce(F.col("first.sentence_key") == F.col("other.sentence_key"), F.lit(False))
    ahead = F.col("first.entity_type") == "a"
    pairs = first.join(other, ["article_id", "idx"]).where(~quoted).select(
        "article_id", F.when(ahead, F.col("first")).otherwise(F.col("other")).alias("a"), F.when(ahead, F.col("other")).otherwise(F.col("first")).alias("b"),
        F.col("first.start").alias("begin"), "span", "points")
    return _candidates(pairs, F.col("points"), F.col("begin"), F.col("begin") + F.col("span"))


def best_pairs(mentions: DataFrame) -> DataFrame:
    """Highest-scoring quotation per (article, A, B); the earliest pair wins ties."""
    pairs = sentence_pairs(mentions).unionByName(near_pairs(mentions))
    best = pairs.groupBy(*PAIR).agg(
        F.max_by(
            F.struct("confidence_score", "section", "begin", "end", "article_kind"),
            F.struct(F.col("confidence_score"), -F.col("mention_idx_a"), -F.col("mention_idx_b")),
        ).alias("best")
    ).select(*PAIR, "best.*").withColumn("no", F.floor(F.col("begin") / BLOCK).cast("int"))
    blocks = mentions.where("quotable IS NOT NULL").select("article_id", F.explode("quotable").alias("b")).select("article_id", "b.no", F.col("b.text").alias("block"))
    quotation = squash(cut(F.col("block"), F.col("begin") - F.col("no") * BLOCK, F.col("end") - F.col("no") * BLOCK))
    return best.join(blocks, ["article_id", "no"]).select(*PAIR, "confidence_score", "section", quotation.alias("evidence"), "article_kind")


def term_lookup(protocol: Protocol, slot: str, key: Column) -> Column:
    """Label and category of an entity from the dictionary (driver-side constants)."""
    known = {t.entity_id: t for t in protocol.terms if t.slot == slot}
    pairs = []
    for name, t in known.items():
        pairs += [
            F.lit(name),
            F.struct(
                first_filled(F.lit(t.label_es), F.lit(t.label_en)).alias("label"),
                F.lit(t.category).alias("category"),
            ),
        ]
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast(
        "struct<label:string,category:string>"
    )


def build_relations(mentions: DataFrame, summaries: DataFrame, protocol: Protocol) -> DataFrame:
    """One row per (article, A entity, B entity) backed by a quotation."""
    best = best_pairs(mentions)
    context = summaries.where("entity_type = 'a'").select(
        "article_id", F.col("entity_id").alias("entity_a_id"), "study_context"
    )
    label = association_label(F.col("evidence"), F.col("section"), protocol.cues)
    a = term_lookup(protocol, "a", F.col("entity_a_id"))
    b = term_lookup(protocol, "b", F.col("entity_b_id"))
    return (
        best.withColumn("association", label)
        .join(context, ["article_id", "entity_a_id"], "left")
        .select(
            "article_id", "entity_a_id", a["label"].alias("entity_a_label"), a["category"].alias("entity_a_category"),
            "entity_b_id", b["label"].alias("entity_b_label"), b["category"].alias("entity_b_category"),
            "association",
            relation_confidence(F.col("confidence_score"), F.col("section"), F.col("association")).alias("confidence"),
            "confidence_score", "section", F.col("evidence").alias("evidence_text"),
            F.lit(fixed.INFERRED).alias("extraction_or_inference"),
            F.coalesce("study_context", "article_kind").alias("study_context"),
        )
    )
