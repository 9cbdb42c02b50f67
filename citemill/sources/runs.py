"""Read the tables of a finished run back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citemill.sources.files import exists

RUN_TABLES = {
    "articles": "article_id string, title string, year string, doi string, article_kind string, text_extractable string",
    "entity_summaries": (
        "article_id string, entity_type string, entity_id string, label_es string, label_en string, category string, "
        "n_mentions int, role string, confidence string"
    ),
    "relations": (
        "article_id string, entity_a_label string, entity_a_category string, entity_b_label string, "
        "entity_b_category string, association string, confidence string, section string"
    ),
}


def read_run_table(spark: SparkSession, folder: str, name: str, columns: str | None = None) -> DataFrame:
    """One CSV table with a checked header.

    A missing table or column is an error; a table without even a header is empty.
    Missing text is empty text, and ids stay text.
    """
    wanted = StructType.fromDDL(columns or RUN_TABLES[name])
    path = f"{folder}/{name}.csv"
    if not exists(spark, path):
        raise FileNotFoundError(f"{name}.csv is not in {folder}; point to the output of a run")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if not raw.columns:
        return spark.createDataFrame([], wanted)
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise KeyError(f"{name}.csv lacks the columns {missing}; it has {raw.columns}")
    return raw.select(*[
        (F.coalesce(f.name, F.lit("")) if f.dataType.simpleString() == "string" else F.col(f.name).try_cast(f.dataType)).alias(f.name)
        for f in wanted
    ])
