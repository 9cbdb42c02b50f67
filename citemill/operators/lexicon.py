"""Dictionary tables: flattening a taxonomy and checking a dictionary.

A taxonomy is a node table: node_id, parent_id (null at the root), position, kind
(``category`` or ``term``), entity_id, label_es, label_en, generic, patterns.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions.labels import first_filled
from citemill.functions.regex import is_unusual, matches_any
from citemill.session import discard, store

# ship these helpers with the job: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATOR = " > "
NODE = (
    "node_id string, parent_id string, position string, kind string, entity_id string, label_es string, "
    "label_en string, generic boolean, patterns array<string>"
)


def category_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path): the labels from the root to each category that hangs on a root, by pointer doubling.

    Every category starts with a pointer to its parent and its own label. In a round it takes over the pointer of the category it points to and
    puts that one's labels in front of its own, so reach doubles: a tree of depth d takes log2(d) + 1 rounds, each one join of two written
    tables. Unlabelled categories add no label; categories below a missing parent drop out. The ids passed are kept: one that comes back on its own path is a
    cycle, which raises ``ValueError`` if a root leads to it.
    """
    label = first_filled(F.col("label_es"), F.col("label_en"))
    none = F.array().cast("array<string>")
    categories = nodes.where("kind = 'category'").select(
        "node_id", F.col("parent_id").alias("up"), F.when(label != "", F.array(label)).otherwise(none).alias("path"), none.alias("above"))
    state = store(categories, "paths")
    while True:
        ahead = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"), F.col("above").alias("passed"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select(
            "node_id", F.col("next").alias("up"), F.concat("front", "path").alias("path"), F.concat("passed", F.array("up"), "above").alias("above"))
        grown = store(state.where("up IS NULL").unionByName(moved), "paths")
        again = F.array_contains("above", F.col("node_id")) | (F.size(F.array_distinct("above")) < F.size("above"))
        done, state = grown.where("up IS NULL"), store(grown.where(~again), "paths")
        looped = grown.where(F.array_contains("above", F.col("node_id"))).select("node_id").distinct()
        back = looped.join(done.select("node_id").distinct(), "node_id").agg(F.max("node_id")).first()[0]
        if back is not None:
            raise ValueError(f"taxonomy node {back} is its own ancestor")
        discard(grown)
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("node_id", "path")


def flatten_taxonomy(nodes: DataFrame, root_label: str, slot: str, full_path: bool = True) -> DataFrame:
    """Terms with their category path, to any depth (see ``category_paths``).

    With ``full_path=False`` only the nearest labelled ancestor is kept. Terms without a label or pattern are dropped.
    """
    label = first_filled(F.col("label_es"), F.col("label_en"))
    usable = nodes.where(F.col("kind") == "term").where(
        (label != "") & (F.size(F.coalesce("patterns", F.array().cast("array<string>"))) > 0))
    paths = category_paths(nodes).withColumnRenamed("node_id", "parent_id")
    no_names = F.array().cast("array<string>")
    terms = usable.where("parent_id IS NULL").withColumn("path", no_names).unionByName(usable.join(paths, "parent_id").select(*usable.columns, "path"))
    named = F.col("path") if full_path else F.slice("path", F.greatest(F.size("path"), F.lit(1)), F.lit(1))
    category = F.when(F.size("path") > 0, F.array_join(named, SEPARATOR)).otherwise(root_label)
    return terms.select(
        F.lit(slot).alias("entity_type"),
        first_filled(F.col("entity_id"), F.lower("label_es"), F.lower("label_en")).alias("entity_id"),
        "label_es", "label_en", category.alias("category"), F.coalesce("generic", F.lit(False)).alias("generic"),
        "patterns", "position",
    )


def incomplete_terms(nodes: DataFrame) -> DataFrame:
    """Terms without a label or without a pattern."""
    blank = (F.trim(F.coalesce("label_es", F.lit(""))) == "") & (F.trim(F.coalesce("label_en", F.lit(""))) == "")
    bare = F.size(F.coalesce("patterns", F.array().cast("array<string>"))) == 0
    return nodes.where((F.col("kind") == "term") & (blank | bare)).select(
        "node_id", blank.alias("no_label"), bare.alias("no_pattern")
    )


def double_escaped(nodes: DataFrame) -> DataFrame:
    """Patterns that look for a literal backslash."""
    return nodes.where("kind = 'term'").select("node_id", F.explode("patterns").alias("pattern")).where(
        F.col("pattern").contains("\\\\")
    )


def unlabelled_categories(nodes: DataFrame) -> DataFrame:
    """Categories without a label that have children."""
    children = nodes.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("children")
    )
    blank = (F.trim(F.coalesce("label_es", F.lit(""))) == "") & (F.trim(F.coalesce("label_en", F.lit(""))) == "")
    return nodes.where((F.col("kind") == "category") & blank).join(children, "node_id").select("node_id", "children")


def node_counts(nodes: DataFrame) -> DataFrame:
    """Terms and categories, and whether a variable has any term."""
    return nodes.agg(
        F.count_if(F.col("kind") == "term").alias("terms"), F.count_if(F.col("kind") == "category").alias("categories")
    ).withColumn("has_terms", F.col("terms") > 0)


def _reached(labels: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether a pattern of the row is found in its label; a pattern that does not compile finds nothing."""

    def finds(pattern: str | None, label: str) -> bool:
        try:
            return pattern is not None and re.search(pattern, label, re.IGNORECASE) is not None
        except re.error:
            return False

    return pd.Series([any(finds(p, label) for p in ([] if ps is None else ps)) for label, ps in zip(labels, patterns, strict=True)], dtype=bool)


def unreachable_labels(terms: DataFrame) -> DataFrame:
    """Labels that no pattern of their own term matches, by the regex dialect of the scan.

    Patterns are data here, one list for each row, so they run over (label, patterns) batches. A
    pattern that does not compile leaves its label unreached.
    """
    labels = F.explode(F.array(
        F.struct(F.lit("es").alias("lang"), F.col("label_es").alias("label")),
        F.struct(F.lit("en").alias("lang"), F.col("label_en").alias("label")),
    ))
    rows = terms.select("entity_id", "patterns", labels.alias("l")).where(F.coalesce("l.label", F.lit("")) != "")
    reached = F.pandas_udf(_reached, "boolean")
    return rows.where(~reached(F.col("l.label"), F.col("patterns"))).select(
        "entity_id", F.col("l.lang").alias("lang"), F.col("l.label").alias("label")
    )


def check_samples(samples: DataFrame, terms) -> DataFrame:
    """Expected and rejected term ids of sample texts against what the terms match.

    ``samples`` has sample_id, text, expect and reject (arrays of ids). Terms are literal
    expressions on the sample row, so samples are never multiplied by the dictionary.
    """
    found = F.filter(
        F.array(*[F.when(matches_any(F.col("text"), list(t.patterns), F.col("unusual")), t.entity_id) for t in terms]),
        lambda i: i.isNotNull(),
    )
    known = F.array(*[F.lit(t.entity_id) for t in terms])
    rows = samples.withColumn("unusual", is_unusual(F.col("text"))).withColumn("matched", found)
    return rows.select(
        "sample_id",
        F.array_except(F.array_intersect("expect", known), "matched").alias("missing"),
        F.array_intersect("reject", "matched").alias("false_positives"),
        F.array_except(F.array_distinct(F.concat("expect", "reject")), known).alias("unknown"),
    ).where((F.size("missing") > 0) | (F.size("false_positives") > 0) | (F.size("unknown") > 0))
