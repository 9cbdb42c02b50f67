"""Session settings and stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # long texts: bound an Arrow batch by bytes, not only by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package relies on, keeping explicit choices."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


#: Compressed input of one task of the text scan.
TASK_BYTES = 1 << 22

_own_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a private one only when none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folders.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Cuts the lineage, so a lost executor never repeats the text scan, and later steps
    read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/citemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stage_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete stage tables once everything read from them has been written itself.

    A collection of the driver's heap follows: Spark deletes shuffle files only when the plans that wrote them are
    collected, which on a large driver may be long after a job.
    """
    from citemill.sources.files import collect_garbage, delete

    for df in stored:
        delete(df.sparkSession, df.stage_path)
    if stored:
        collect_garbage(stored[0].sparkSession)


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows to the number of tasks that ``spark.citemill.partitions`` names; where it is not set, to one for each ``TASK_BYTES`` of the input files.

    A task reads whole row groups, and a file may hold all its rows in one; the scan of the texts would be one task then. It shuffles
    whole rows once, so an input of that many files already stays as it is.
    """
    from citemill.sources.files import length

    named = df.sparkSession.conf.get("spark.citemill.partitions", None)
    if named:
        return df.repartition(int(named))
    files = df.inputFiles()
    n = -(-sum(length(df.sparkSession, f) for f in files) // TASK_BYTES)
    return df.repartition(n) if n > len(files) else df
