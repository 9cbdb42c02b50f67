"""Seeded stratified samples for manual validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill import fixed
from citemill.operators.groups import top_rows


def draw_key(seed: int, keys: list[str]) -> Column:
    """Pseudo-random but reproducible order: a hash of seed and row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in keys]))


def stratified_sample(df: DataFrame, strata: list[str], keys: list[str], n: int,
                      seed: int = fixed.SEED) -> DataFrame:
    """At most ``n`` rows without replacement, the same quota for every stratum.

    Rows are numbered in random order inside their stratum and taken level by level,
    larger strata first. That fills all strata evenly, passes the rest of exhausted
    strata on, and gives the last incomplete level to the largest strata. No stratum
    can give more than ``n`` rows, so only ``n`` per stratum are kept by each task.
    """
    numbered = top_rows(df.withColumn("_draw", draw_key(seed, keys)), strata, ["_draw", *keys], n, "_level")
    # one row per stratum: the strata are combinations of a few fixed labels
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_place", F.row_number().over(W.orderBy(*strata)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in strata]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = numbered.alias("l").join(sizes.alias("r"), condition).select("l.*", "r._size", "r._place")
    taken = joined.orderBy("_level", F.col("_size").desc(), "_place").limit(n)
    return taken.drop("_draw", "_level", "_size", "_place")


def sample_coverage(sample: DataFrame, strata: list[str], prefix: str) -> DataFrame:
    """Realised size and number of strata of a sample."""
    return sample.agg(
        F.count("*").alias(f"{prefix}_rows"), F.count_distinct(F.struct(*strata)).alias(f"{prefix}_strata")
    )
