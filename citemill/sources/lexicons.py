"""Dictionary files as node or term tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill.config import Term
from citemill.functions.labels import first_filled
from citemill.operators.lexicon import flatten_taxonomy
from citemill.session import store

_NODE = (
    "id string, kind string, labelEs string, labelEn string, label_es string, label_en string, "
    "generic boolean, patterns array<string>, children array<string>"
)
_ENTITY = (
    "id string, label_es string, label_en string, labelEs string, labelEn string, category string, "
    "generic boolean, patterns array<string>"
)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")


def read_taxonomy_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nested taxonomy JSON to the node table, one level per pass."""
    level = _document(spark, path, "taxonomy array<string>").select(
        F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("at"), F.posexplode("taxonomy").alias("i", "raw")
    )
    out = None
    while True:
        parsed = level.select(
            "parent_id", F.concat("at", F.format_string("/%06d", "i")).alias("node_id"), F.from_json("raw", _NODE).alias("n")
        ).where("n.kind is not null")
        if parsed.isEmpty():
            break
        nodes = parsed.select(
            "node_id", "parent_id", F.col("node_id").alias("position"), F.col("n.kind").alias("kind"),
            F.col("n.id").alias("entity_id"),
            first_filled(F.col("n.labelEs"), F.col("n.label_es")).alias("label_es"),
            first_filled(F.col("n.labelEn"), F.col("n.label_en")).alias("label_en"),
            F.coalesce("n.generic", F.lit(False)).alias("generic"),
            F.coalesce("n.patterns", F.array().cast("array<string>")).alias("patterns"),
        )
        out = nodes if out is None else out.unionByName(nodes)
        level = parsed.where("n.kind = 'category'").select(
            F.col("node_id").alias("parent_id"), F.col("node_id").alias("at"), F.posexplode("n.children").alias("i", "raw")
        )
    if out is None:
        from citemill.operators.lexicon import NODE

        return spark.createDataFrame([], NODE)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of many files with ``place``, their number over all files in path order.

    Inside a split of a file rows are numbered as they are read; splits are counted, and one row a split gets the prefix sum of
    those before it. No row meets another, and the largest table that is sorted has one row a split.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    at = store(at, "dictionary-lines")
    splits = at.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    bases = store(splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "dictionary-splits")
    return at.join(bases, ["_file", "_block"]).withColumn("place", F.col("_base") + F.col("_id") - F.col("_first")).drop("_file", "_block", "_id", "_first", "_base")


def _entity_rows(rows: DataFrame, slot: str, root_label: str, position: Column) -> DataFrame:
    label_es, label_en = first_filled(F.col("label_es"), F.col("labelEs")), first_filled(F.col("label_en"), F.col("labelEn"))
    return rows.select(
        F.lit(slot).alias("entity_type"),
        first_filled(F.col("id"), F.lower(label_es), F.lower(label_en)).alias("entity_id"),
        label_es.alias("label_es"), label_en.alias("label_en"),
        first_filled(F.col("category"), F.lit(root_label)).alias("category"),
        F.coalesce("generic", F.lit(False)).alias("generic"), "patterns", position.alias("position"),
    ).where((F.coalesce(F.size("patterns"), F.lit(0)) > 0) & (first_filled(F.col("label_es"), F.col("label_en")) != ""))


def read_entity_lines(spark: SparkSession, path: str, slot: str, root_label: str = "") -> DataFrame:
    """A flat dictionary of one entity a JSON line, in any number of files of any size; see ``sinks.lexicons``."""
    rows = _numbered(spark.read.schema(_ENTITY).json(path).select("*", "_metadata"))
    return _entity_rows(rows, slot, root_label, F.format_string("/%012d", "place"))


def read_context_lines(spark: SparkSession, path: str) -> DataFrame:
    """The single-variable dictionary of one entry a JSON line."""
    rows = _numbered(spark.read.schema("canonico string, familia string, patrones array<string>, generico boolean").json(path).select("*", "_metadata"))
    return _context_rows(rows, F.format_string("/%012d", "place"))


def read_entities(spark: SparkSession, path: str, slot: str, root_label: str = "") -> DataFrame:
    """Flat ``entities`` list."""
    e = _document(spark, path, f"entities array<struct<{_ENTITY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array<string>', ':array<string>')}>>")
    rows = e.select(F.posexplode("entities").alias("i", "e")).select("i", "e.*")
    return _entity_rows(rows, slot, root_label, F.format_string("/%06d", "i"))


def read_lexicon(spark: SparkSession, path: str, slot: str, root_label: str = "", full_path: bool = True) -> DataFrame:
    """A taxonomy file, or a flat entity list when the file has no taxonomy."""
    has_taxonomy = _document(spark, path, "taxonomy array<string>").where("taxonomy is not null").limit(1).count() > 0
    if has_taxonomy:
        return flatten_taxonomy(read_taxonomy_nodes(spark, path), root_label, slot, full_path)
    return read_entities(spark, path, slot, root_label)


def _context_rows(rows: DataFrame, position: Column) -> DataFrame:
    return rows.select(
        F.lit("a").alias("entity_type"), F.col("canonico").alias("entity_id"), F.col("canonico").alias("label_es"),
        F.lit("").alias("label_en"), F.col("familia").alias("category"),
        F.coalesce("generico", F.lit(False)).alias("generic"), F.col("patrones").alias("patterns"), position.alias("position"),
    )


def read_context_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Single-variable file: canonical name, family, patterns, generic flag."""
    schema = "contaminantes array<struct<canonico:string,familia:string,patrones:array<string>,generico:boolean>>"
    rows = _document(spark, path, schema).select(F.posexplode("contaminantes").alias("i", "c")).select("i", "c.*")
    return _context_rows(rows, F.format_string("/%06d", "i"))


def to_terms(lexicon: DataFrame) -> tuple[Term, ...]:
    """Dictionary rows as run configuration; a dictionary is small by nature."""
    return tuple(
        Term(r["entity_type"], r["entity_id"], tuple(r["patterns"]), r["label_es"] or "", r["label_en"] or "",
             r["category"] or "", bool(r["generic"]))
        for r in lexicon.orderBy("entity_type", "position").collect()
    )
