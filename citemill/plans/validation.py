"""Metrics from filled validation templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_by(template: DataFrame, column: str, verdict: str = "correct_evidence", right: str = "yes") -> DataFrame:
    """Share of judged rows a reviewer confirmed, per value of ``column``."""
    judged = template.where(F.coalesce(verdict, F.lit("")) != "")
    return judged.groupBy(column).agg(
        F.count("*").alias("judged"), F.count_if(F.col(verdict) == right).alias("confirmed"),
        F.avg((F.col(verdict) == right).cast("double")).alias("precision"),
    )


def false_positives_by(template: DataFrame, column: str, verdict: str = "correct_evidence", wrong: str = "no") -> DataFrame:
    """Rows a reviewer rejected, per value of ``column``."""
    judged = template.where(F.coalesce(verdict, F.lit("")) != "")
    return judged.groupBy(column).agg(
        F.count("*").alias("judged"), F.count_if(F.col(verdict) == wrong).alias("false_positives")
    )


def agreement(judgements: DataFrame, item: str, reviewer: str, label: str, first: str, second: str) -> DataFrame:
    """Observed agreement and Cohen's kappa of two reviewers over common items.

    Items are paired by one aggregate instead of a self-join; the label table that
    gives the expected agreement has one row per label pair.
    """
    def verdict(name: str):
        return F.max(F.when(F.col(reviewer) == name, F.col(label))).alias(f"label_{name}")

    pairs = judgements.groupBy(item).agg(verdict(first), verdict(second)).dropna().groupBy(
        F.col(f"label_{first}").alias("x"), F.col(f"label_{second}").alias("y")
    ).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("equal"))
    by_x = pairs.groupBy(F.col("x").alias("label")).agg(F.sum("n").alias("nx"))
    by_y = pairs.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("ny"))
    chance = by_x.join(by_y, "label").agg(F.sum(F.col("nx") * F.col("ny")).alias("v")).scalar()
    rows = total.withColumn("observed", F.col("equal") / F.col("items")).withColumn(
        "expected", F.coalesce(chance, F.lit(0)) / (F.col("items") * F.col("items"))
    )
    return rows.select(
        "items", "equal", "observed", "expected",
        F.when(F.col("expected") == 1, F.lit(1.0))
        .otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"),
    )
