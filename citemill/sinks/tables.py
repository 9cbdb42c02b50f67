"""Write result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from citemill.functions.labels import clean_cell
from citemill.sources.files import has_content


def _cell(name: str, kind) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, StringType):
        return clean_cell(column).alias(name)
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return clean_cell(F.to_json(column)).alias(name)
    return column.alias(name)


def export_cells(df: DataFrame) -> DataFrame:
    """Control characters out, text clipped, nested values as JSON."""
    return df.select(*[_cell(f.name, f.dataType) for f in df.schema])


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    """A CSV folder with header; an empty table still gets its header line. The plan runs once."""
    cells, spark, path = export_cells(df), df.sparkSession, f"{folder}/{name}.csv"
    options = {"header": True, "escape": '"', "emptyValue": "", "lineSep": "\n"}
    cells.write.mode("overwrite").csv(path, **options)
    if not has_content(spark, path):  # no task had a row
        spark.createDataFrame([], cells.schema).coalesce(1).write.mode("overwrite").csv(path, **options)
    return path


def write_json(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{name}.json"
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Write named tables as parquet (default), csv or json; returns their paths."""
    paths = {}
    for name, df in tables.items():
        if kind == "csv":
            paths[name] = write_csv(df, folder, name)
        elif kind == "json":
            paths[name] = write_json(df, folder, name)
        else:
            paths[name] = f"{folder}/{name}.parquet"
            df.write.mode("overwrite").parquet(paths[name])
    return paths
