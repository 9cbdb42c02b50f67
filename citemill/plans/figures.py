"""The tables behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill import fixed
from citemill.functions.labels import (
    category_or_label, first_filled, in_vocabulary, lookup, relation_weight, section_or_blank,
)
from citemill.operators.groups import first_ids, top_rows

PAIR = ["entity_a_label", "entity_b_label"]


def _grand_total(column: str) -> Column:
    """Sum over a table of one row per dictionary label or section.

    A window over that small table, not a second aggregate: a scalar subquery would run the
    scan behind the table twice.
    """
    return F.sum(column).over(W.partitionBy(F.lit(0)))


def detection_frequency(summaries: DataFrame, slot: str, limit: int = 35) -> DataFrame:
    """Articles per label where the entity has a clear, non-bibliographic role."""
    label = first_filled(F.col("label_es"), F.col("label_en"))
    counts = (
        summaries.where((F.col("entity_type") == slot) & in_vocabulary(F.col("role"), fixed.FREQUENCY_ROLES))
        .groupBy(label.alias("label")).agg(F.count("*").alias("articles"))
    )
    labels = counts.withColumn("one", F.lit(1)).withColumn("labels", _grand_total("one"))
    return labels.orderBy(F.col("articles").desc(), "label").limit(limit).select(
        "label", "articles", F.greatest(F.lit(0), F.col("labels") - limit).alias("labels_not_shown")
    )


def _count_by(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), column)


def articles_by_kind(articles: DataFrame) -> DataFrame:
    return _count_by(articles, "article_kind", "articles")


def relations_by_association(relations: DataFrame) -> DataFrame:
    return _count_by(relations, "association", "relations")


def category_counts(relations: DataFrame) -> DataFrame:
    """Evidence-backed relations per category pair."""
    backed = relations.where(F.col("association").isin("asociacion_fuerte", "asociacion_debil", "mencion_especulativa"))
    return backed.groupBy("entity_a_category", "entity_b_category").agg(F.count("*").alias("relations"))


def weighted_relations(relations: DataFrame) -> DataFrame:
    """Relations with filled category and section axes and their evidence weight."""
    return (
        relations.withColumn("entity_a_category", category_or_label(F.col("entity_a_category"), F.col("entity_a_label")))
        .withColumn("entity_b_category", category_or_label(F.col("entity_b_category"), F.col("entity_b_label")))
        .withColumn("section", section_or_blank(F.col("section")))
        .withColumn("weighted_score", relation_weight(F.col("association"), F.col("confidence")))
    )


def pair_table(relations: DataFrame, by_association: bool) -> DataFrame:
    """Weight, number, mean weight and first twelve articles per pair."""
    keys = [*PAIR, "association"] if by_association else PAIR
    backed = weighted_relations(relations).where(F.col("association") != fixed.NO_EVIDENCE)
    sums = backed.groupBy(*keys).agg(
        F.sum("weighted_score").alias("weighted_score"), F.count("*").alias("n_relations"),
        F.avg("weighted_score").alias("avg_strength"),
    )
    return sums.join(first_ids(backed, keys, "article_id", 12, "articles"), keys)


def weight_matrix(relations: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Zero-filled sums of weight, one column per given value."""
    backed = weighted_relations(relations).where(F.col("association") != fixed.NO_EVIDENCE)
    return backed.groupBy(row).pivot(column, columns).agg(F.sum("weighted_score")).fillna(0.0, columns)


def top_pairs(pairs: DataFrame, limit: int = 30) -> DataFrame:
    return pairs.orderBy(F.col("weighted_score").desc(), *PAIR).limit(limit)


def strength_class(mean_weight: Column) -> Column:
    strong, medium = fixed.STRENGTH_CUTS
    return F.when(mean_weight >= strong, "strong").when(mean_weight >= medium, "medium").otherwise("weak")


def bubble_cells(pairs: DataFrame, limit: int = 18) -> DataFrame:
    """Pairs of the heaviest A labels, with row and column order of the matrix."""
    rows = pairs.groupBy("entity_a_label").agg(F.sum("weighted_score").alias("total_a"))
    rows = rows.orderBy(F.col("total_a").desc(), "entity_a_label").limit(limit)
    rows = rows.withColumn("row_no", F.row_number().over(W.orderBy(F.col("total_a").desc(), "entity_a_label")))
    cells = pairs.join(rows, "entity_a_label")
    columns = cells.groupBy("entity_b_label").agg(F.sum("weighted_score").alias("total_b"))
    # one row per B label of the dictionary, so an unpartitioned window is small here
    columns = columns.withColumn("col_no", F.row_number().over(W.orderBy(F.col("total_b").desc(), "entity_b_label")))
    return cells.join(columns, "entity_b_label").select(
        "row_no", "col_no", *PAIR, "weighted_score", "n_relations", "avg_strength",
        strength_class(F.col("avg_strength")).alias("strength"),
    )


def network_edges(pairs_by_association: DataFrame, limit: int = 55) -> DataFrame:
    """Heaviest edges with the total weight of both end points among the kept edges."""
    edges = pairs_by_association.orderBy(F.col("weighted_score").desc(), *PAIR, "association").limit(limit)

    def node_total(label: str) -> Column:
        return F.sum("weighted_score").over(W.partitionBy(label))

    return edges.select(
        *PAIR, "association", "weighted_score", node_total("entity_a_label").alias("weight_a"),
        node_total("entity_b_label").alias("weight_b"),
    )


def cluster_map_labels(clusters: DataFrame, heaviest: int = 12, farthest: int = 8) -> DataFrame:
    """Articles that get a label: heaviest, farthest, and the best of each cluster."""
    weight = [F.col("n_relations_weighted").desc(), "article_id"]
    distance = [F.col("distance_to_centroid").desc(), "article_id"]
    picks = [
        clusters.orderBy(*weight).limit(heaviest), clusters.orderBy(*distance).limit(farthest),
        top_rows(clusters, ["cluster"], weight, 1).drop("rank"),
        top_rows(clusters, ["cluster"], distance, 1).drop("rank"),
    ]
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.select("article_id", "cluster").distinct()


def mention_totals(mentions: DataFrame, slot: str | None = None) -> DataFrame:
    """Mentions, distinct articles and share of all mentions per label and category."""
    rows = mentions if slot is None else mentions.where(F.col("entity_type") == slot)
    counts = (
        rows.groupBy("label_es", "category", "article_id").agg(F.count("*").alias("n"))
        .groupBy("label_es", "category")
        .agg(F.sum("n").alias("menciones_totales"), F.count("*").alias("articulos_unicos"))
    )
    return counts.select(
        F.col("label_es").alias("contaminante"), F.col("category").alias("categoria"),
        "menciones_totales", "articulos_unicos",
        (F.col("menciones_totales") / _grand_total("menciones_totales") * 100).alias("porcentaje_menciones"),
    ).orderBy(F.col("menciones_totales").desc(), F.col("articulos_unicos").desc(), "contaminante")


def section_totals(mentions: DataFrame, slot: str | None = None) -> DataFrame:
    """Mentions per section over the full section list; unknown sections are appended."""
    rows = mentions if slot is None else mentions.where(F.col("entity_type") == slot)
    counts = rows.groupBy(F.coalesce("section", F.lit("unknown")).alias("section")).agg(F.count("*").alias("n"))
    known = F.array(*[F.lit(s) for s in fixed.SECTION_REPORT_LABELS])
    listed = mentions.sparkSession.range(1).select(F.posexplode(known).alias("place", "section"))
    joined = listed.join(counts, "section", "full")
    number = F.coalesce("n", F.lit(0).cast("long"))
    return joined.withColumn("total", _grand_total("n")).orderBy(F.col("place").asc_nulls_last(), F.col("n").desc(), "section").select(
        "section", number.alias("menciones_totales"), (number / F.col("total") * 100).alias("porcentaje_menciones"),
        lookup(F.col("section"), fixed.SECTION_REPORT_LABELS, F.col("section")).alias("seccion"),
    )


def label_by_section(mentions: DataFrame, sections: list[str], limit: int = 25) -> DataFrame:
    """Mentions of the most frequent labels per section."""
    top = mentions.groupBy("label_es").agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), "label_es").limit(limit)
    cells = mentions.groupBy("label_es").pivot("section", sections).agg(F.count(F.lit(1))).fillna(0, sections)
    return cells.join(top, "label_es").select("label_es", *[f"`{s}`" for s in sections], "total").orderBy(
        F.col("total").desc(), "label_es"
    )
