"""Dictionaries as folders of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(rows: DataFrame, folder: str) -> str:
    """Range-partitioned by ``position``, so that file order is dictionary order; no task holds more than its range."""
    rows.repartitionByRange("position").sortWithinPartitions("position").drop("position").write.mode("overwrite").json(folder)
    return folder


def write_entity_lines(lexicon: DataFrame, folder: str) -> str:
    """A flat dictionary, one entity a line, to be read by ``sources.lexicons.read_entity_lines``."""
    return _write(lexicon.select("position", F.col("entity_id").alias("id"), "label_es", "label_en", "category", "generic", "patterns"), folder)


def write_context_lines(lexicon: DataFrame, folder: str) -> str:
    """The single-variable dictionary, one entry a line, for ``read_context_lines``."""
    return _write(lexicon.select(
        "position", F.col("entity_id").alias("canonico"), F.col("category").alias("familia"), F.col("patterns").alias("patrones"),
        F.col("generic").alias("generico")), folder)
