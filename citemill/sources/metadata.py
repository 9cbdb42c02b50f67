"""Metadata tables: CSV files and sheet rows as (source_ord, article_id, row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import fixed
from citemill.functions.labels import first_filled
from citemill.sources.files import exists


def _as_map(names: list[str]) -> Column:
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(F.col(f"`{n}`"), F.lit("")))]
    return F.create_map(*pairs)


def read_csv_metadata(spark: SparkSession, path: str, source_ord: int = 0) -> DataFrame:
    """Rows keyed by the first filled id column; the last row of an id wins."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    names = [n.lstrip("﻿") for n in raw.columns]
    rows = raw.toDF(*names).withColumn("_row_no", F.monotonically_increasing_id())
    ids = [F.col(f"`{k}`") for k in fixed.ID_KEYS if k in names]
    article_id = F.trim(first_filled(*ids)) if ids else F.lit("")
    return (
        rows.select(article_id.alias("article_id"), "_row_no", _as_map(names).alias("row"))
        .where("article_id <> ''").groupBy("article_id").agg(F.max_by("row", "_row_no").alias("row"))
        .select(F.lit(source_ord).alias("source_ord"), "article_id", "row")
    )


def normal_headers(cells: Column) -> Column:
    """Trimmed header names; blanks become colN, repeats get a numeric suffix."""
    named = F.transform(
        cells,
        lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", F.trim(c)).otherwise(
            F.concat(F.lit("col"), (i + 1).cast("string"))
        ),
    )

    def numbered(name: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda o: o == name))
        return F.when(seen > 1, F.concat(name, F.lit("_"), seen.cast("string"))).otherwise(name)

    return F.transform(named, numbered)


def normalise_sheet(rows: DataFrame, source_ord: int = 0) -> DataFrame:
    """Headerless sheet rows (row_no from 0, cells array<string>) to metadata rows.

    The header is the first of ten rows that names a DOI or a title, else row 0. A row's
    id is the first of its first four cells made of letters then digits.
    """
    lowered = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    titled = F.arrays_overlap(lowered, F.array(*[F.lit(x) for x in ("doi", "paper name", "title")]))
    # at most ten rows reach this aggregate
    header = rows.where("row_no < 10").agg(
        F.coalesce(F.min(F.when(titled, F.col("row_no"))), F.lit(0)).alias("header_no"),
        F.min_by("cells", F.struct((~titled).alias("other"), "row_no")).alias("header_cells"),
        F.min_by("cells", "row_no").alias("first_cells"),
        F.bool_or(titled).alias("found"),
    )
    names = header.select(
        "header_no",
        normal_headers(F.when(F.col("found"), F.col("header_cells")).otherwise(F.col("first_cells"))).alias("names"),
    )
    ids = F.filter(
        F.transform(F.slice("cells", 1, 4), lambda c: F.trim(F.coalesce(c, F.lit("")))),
        lambda c: c.rlike(r"^[A-Za-z]+[0-9]+\z"),
    )
    body = rows.withColumn("names", names.select("names").scalar()).where(
        (F.col("row_no") > names.select("header_no").scalar()) & F.exists("cells", lambda c: c.isNotNull())
    )
    row = F.map_from_entries(
        F.transform("names", lambda n, i: F.struct(n, F.coalesce(F.get("cells", i), F.lit(""))))
    )
    return (
        body.select(F.get(ids, F.lit(0)).alias("article_id"), "row_no", row.alias("row"))
        .where("article_id is not null").groupBy("article_id").agg(F.max_by("row", "row_no").alias("row"))
        .select(F.lit(source_ord).alias("source_ord"), "article_id", "row")
    )


def read_sources(spark: SparkSession, paths: str | None) -> DataFrame | None:
    """Comma list of CSV files in order; missing ones are skipped."""
    listed = [p.strip() for p in (paths or "").split(",") if p.strip()]
    found = [p for p in listed if exists(spark, p) and p.lower().endswith(".csv")]
    tables = [read_csv_metadata(spark, p, i) for i, p in enumerate(found)]
    return reduce(lambda x, y: x.unionByName(y), tables) if tables else None
