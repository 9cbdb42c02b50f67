"""Bounded per-group helpers that hold up when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


FINE = 1024


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark prunes to ``k`` per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_ids(df: DataFrame, keys: list[str], id_column: str, k: int, name: str) -> DataFrame:
    """First ``k`` distinct ids of a group in ascending order, joined by ``"; "``."""
    distinct = df.select(*keys, F.col(id_column).alias("_id")).distinct()
    return (
        top_rows(distinct, keys, ["_id"], k)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list("_id")), "; ").alias(name))
    )


def _bin(value: Column) -> Column:
    """Order-preserving coarse bin of a number: sign and eighth-octave of its size."""
    size = F.floor(F.log2(F.abs(value) + 1e-300) * 8).cast("int") + 8200
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0)


def _middle(cells: DataFrame, keys: list[str], within: list[str], order: str) -> DataFrame:
    """Of the cells of a group in order, those that hold a middle rank; ``before`` becomes the rows before each."""
    earlier = W.partitionBy(*keys, *within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("cell_n").over(earlier), F.lit(0))
    holds = (F.col("start") <= F.col("high")) & (F.col("start") + F.col("cell_n") > F.col("low"))
    return cells.withColumn("start", start).where(holds).drop("before", "cell_n").withColumnRenamed("start", "before")


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group without gathering a group, or one popular range of values, in one place.

    Rows are counted per distinct value, values per coarse bin, and those of the bins that hold the middle ranks
    per ``FINE`` equal parts of the bin. Only values inside the middle parts are ranked.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin", _bin(F.col("v")))
    )
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("cell_n"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    total = F.sum("cell_n").over(W.partitionBy(*keys))
    ranks = bins.withColumn("low", F.floor((total - 1) / 2)).withColumn("high", F.floor(total / 2)).withColumn("before", F.lit(0))
    coarse = _middle(ranks, keys, [], "bin")
    width = F.col("highest") - F.col("lowest")
    part = F.when(width > 0, F.floor((F.col("v") - F.col("lowest")) / width * FINE)).otherwise(0).cast("int")
    placed = counts.join(coarse, [*keys, "bin"]).withColumn("part", part)
    parts = placed.groupBy(*keys, "bin", "part", "low", "high", "before").agg(F.sum("n").alias("cell_n"))
    fine = _middle(parts, keys, ["bin"], "part")
    values = placed.select(*keys, "bin", "part", "v", "n").join(fine, [*keys, "bin", "part"])
    earlier = W.partitionBy(*keys, "bin", "part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranked = values.withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def holds(rank: str) -> Column:
        return (F.col("from") <= F.col(rank)) & (F.col("from") + F.col("n") > F.col(rank))

    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds("low"), F.col("v"))) + F.max(F.when(holds("high"), F.col("v")))) / 2).alias(name)
    )
