"""Run report: metrics and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions.labels import clip_marked


def run_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the named tables, plus extractable articles when ``articles`` is given."""
    out = None
    for name, df in tables.items():
        rows = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        if name == "articles":
            usable = df.agg(F.count_if("text_extractable").alias("value"))
            rows = rows.unionByName(usable.select(F.lit("extractable_articles").alias("metric"), "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def relation_preview(relations: DataFrame, limit: int = 12) -> DataFrame:
    """First relations in article order, cells clipped with a mark."""
    columns = ["entity_a_label", "entity_b_label", "association", "confidence", "section", "evidence_text"]
    rows = relations.orderBy("article_id", "entity_a_id", "entity_b_id").limit(limit)
    return rows.select(*[clip_marked(F.col(c)).alias(c) for c in columns])


def table_preview(df: DataFrame, order: list[str], limit: int = 25, chars: int = 500) -> DataFrame:
    """First rows with every cell as text of at most ``chars`` characters."""
    rows = df.orderBy(*order).limit(limit)
    return rows.select(*[F.substring(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), 1, chars).alias(c) for c in df.columns])
