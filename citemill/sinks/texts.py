"""Texts as folders of text files."""

from __future__ import annotations

import hashlib
import os
import sys
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.sources.files import local_path, mark_done

# executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def write_texts(lines: DataFrame, folder: str, *order: str) -> str:
    """``lines`` (name, value and the columns of ``order``, nulls last) as text files, one a name, to be read as ``folder/*``; a null value is no line.

    A name's lines go to one task, which sorts them and writes them one after another, so no file is held in memory. On a local
    file system Hadoop starts a process for the mode of each folder, file and checksum file; there the tasks write ``<name>.txt`` in
    256 subfolders themselves, under a hidden name until it is whole, so an attempt that is lost or repeated leaves no part of a text.
    Other stores get Spark's own sink, with a folder ``name=<name>`` for each file.
    """
    spark = lines.sparkSession
    dealt = lines.where("value IS NOT NULL").repartition("name").sortWithinPartitions("name", *[F.asc_nulls_last(c) for c in order])
    at = local_path(spark, folder)
    if at is None:
        dealt.select("name", "value").write.partitionBy("name").text(folder, lineSep="\n")
        return folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for name, of_name in groupby(_lines(batches), key=lambda x: x[0]):
            if not name or name[0] in "._" or "/" in name:
                raise ValueError(f"{name!r} is no name of a file that Spark lists")
            into = f"{at}/{hashlib.md5(name.encode()).hexdigest()[:2]}"
            os.makedirs(into, exist_ok=True)
            with open(hidden := f"{into}/.{uuid.uuid4().hex}", "wb") as out:
                out.writelines(value + b"\n" for _, value in of_name)
            os.replace(hidden, f"{into}/{name}.txt")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    dealt.select("name", F.col("value").cast("binary")).mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()
    mark_done(spark, folder)
    return folder
