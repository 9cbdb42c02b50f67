"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import citemill
from citemill.session import configure

#: ASCII white space, as the contracts name it.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the package's settings, and send its modules to the executors once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(citemill.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "citemill.zip"  # on the driver, which serves it
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, Path("citemill") / path.relative_to(root))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def local_table(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A table of driver configuration, name -> (DDL type, values).

    It is a local relation of known size, so Spark itself decides by
    ``spark.sql.autoBroadcastJoinThreshold`` whether a join may broadcast it.
    """
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    arrays = [pa.array(values, type=arrow.field(name).type) for name, (_, values) in columns.items()]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=schema)


def binary_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with its binary column as a list; null is empty."""
    for batch in batches:
        yield batch, [x or b"" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
