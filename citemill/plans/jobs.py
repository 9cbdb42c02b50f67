"""Whole jobs: all tables of a kind from one call, written to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import fixed
from citemill.config import Protocol
from citemill.functions.labels import category_or_label, section_or_blank
from citemill.plans import clusters as cl
from citemill.plans import figures as fg
from citemill.plans import publication as pb
from citemill.plans import review as rv
from citemill.session import store
from citemill.sinks.tables import write_tables
from citemill.sources.runs import read_run_table


def review_tables(r: rv.Review) -> dict[str, DataFrame]:
    """The core tables of a review run."""
    return {
        "articles": rv.article_rows(r.articles), "mentions": rv.mention_rows(r.mentions), "entity_summaries": rv.summary_rows(r.summaries),
        "relations": rv.relation_rows(r.relations, r.articles),
        "systematic_review_table": rv.review_table(r.summaries, r.relations, r.articles, r.protocol),
    }


def publication_tables(r: rv.Review) -> dict[str, DataFrame]:
    """Concordances, term matrices, frequencies, samples and the run summary."""
    p = r.protocol
    roles = store(pb.role_template(r.summaries, r.articles, p.validation_sample_size), "role-sample")
    pairs = store(pb.relation_template(r.relations, r.articles, p.validation_sample_size), "relation-sample")
    totals = pb.corpus_totals(r.articles, r.mentions, r.summaries, r.relations)
    matrices = {
        f"term_{name}_{slot}": pb.term_matrix(r.mentions, r.articles, slot, value)
        for slot in "ab" for name, value in (("counts", "n"), ("per_10k", "per_10k"), ("tfidf", "tfidf"))
    }
    return {
        "kwic": pb.kwic(r.mentions, r.articles), **matrices, "entity_frequency": pb.entity_frequency(r.mentions, r.articles),
        "cooccurrence": pb.cooccurrence(r.mentions, r.relations, r.articles), "weight_sensitivity": pb.weight_sensitivity(r.summaries, p),
        "validation_roles": roles, "validation_relations": pairs, "run_summary": pb.run_summary(totals, roles, pairs, p),
    }


def analytics_summary(found: cl.Clusters, features: DataFrame, k: int, seed: int = fixed.SEED) -> DataFrame:
    """One row: k asked and used, inertia, features in all and used, whether the rounds ended by themselves."""
    return features.agg(F.count_distinct("feature").cast("int").alias("features_available")).select(
        F.lit(k).alias("k_requested"), F.lit(len(found.centers)).alias("k_effective"), F.lit(found.inertia).alias("inertia"),
        "features_available", F.lit(len(found.features)).alias("features_used"), F.lit(found.converged).alias("converged"), F.lit(seed).alias("seed"),
    )


def analytics_tables(articles: DataFrame, summaries: DataFrame, relations: DataFrame, k: int) -> dict[str, DataFrame]:
    """Clusters, profiles, centroids, weight matrices, pair tables and the summary.

    Works on the stage tables of a review and on the tables of a finished run alike.
    """
    every = store(cl.log_features(cl.article_features(articles, summaries, relations)), "all-features")
    features = store(cl.select_features(every), "features")
    found = cl.kmeans(*cl.dense_vectors(features, articles), k)
    axes = relations.select(
        category_or_label(F.col("entity_b_category"), F.col("entity_b_label")).alias("category"), section_or_blank(F.col("section")).alias("section"))
    # labels of the dictionary and section names: bounded by the protocol, and the columns of a matrix
    names = axes.agg(F.sort_array(F.collect_set("category")).alias("c"), F.sort_array(F.collect_set("section")).alias("s")).head()
    return {
        "kmeans_articles": cl.cluster_articles(found.assigned, articles, relations), "cluster_profiles": cl.cluster_profiles(features, found.assigned),
        "kmeans_centroids": cl.centroid_table(found), "matrix_association_section": fg.weight_matrix(relations, "association", "section", names["s"]),
        "matrix_category_weight": fg.weight_matrix(relations, "entity_a_category", "entity_b_category", names["c"]),
        "matrix_category_counts": fg.category_counts(relations), "pairs_by_association": fg.pair_table(relations, True),
        "pairs_collapsed": fg.pair_table(relations, False), "analytics_summary": analytics_summary(found, every, k),
    }


def publish(r: rv.Review, folder: str, kind: str = "csv") -> dict[str, str]:
    """Write the core and the publication tables; returns their paths."""
    return write_tables(review_tables(r) | publication_tables(r), folder, kind)


def analyse_run(spark: SparkSession, run_folder: str, folder: str, protocol: Protocol, kind: str = "csv") -> dict[str, str]:
    """Analytics over the CSV tables of a finished run; returns the paths of what it writes."""
    tables = [read_run_table(spark, run_folder, name) for name in ("articles", "entity_summaries", "relations")]
    return write_tables(analytics_tables(*[store(t, "run-table") for t in tables], protocol.kmeans_k), folder, kind)
