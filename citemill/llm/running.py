"""Running values along a total order, over as many tasks as the data needs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from citemill.llm.common import local_table
from citemill.session import store


def running(
    df: DataFrame, order: Sequence[str], name: str, group: str | None = None, sums: Sequence[str] = (), xors: Sequence[str] = (), lags: Sequence[str] = (),
) -> DataFrame:
    """The rows with ``row`` (their number in the order) and running values inside their group.

    ``x_sum`` and ``x_xor`` include the row itself; ``x_lag`` is the value of the row before, null for the first of a group.
    ``group`` must be the first column of the order; it and all columns with running values are bigint without null.

    Rows are range-partitioned by the whole order, so a group of any size spreads over tasks. Each task streams its range and writes
    the values from its own start on. One summary row a task goes to the driver, which folds what each task takes over from those
    before it; that table has one row a task, whatever the size of the data. Equal rows are interchangeable.
    """
    spark, values = df.sparkSession, [*sums, *xors, *lags]
    kinds = ["sum"] * len(sums) + ["xor"] * len(xors) + ["lag"] * len(lags)
    named = [f"{c}_{k}" for c, k in zip(values, kinds, strict=True)]
    schema = StructType(df.schema.fields[:]).add("task", IntegerType()).add("at", LongType())
    for c in named:
        schema.add(c, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, last, held = TaskContext.get().partitionId(), 0, None, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            g = of(group) if group else np.zeros(n, np.int64)
            new = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group began in an earlier batch
            made = []
            for i, (c, kind) in enumerate(zip(values, kinds, strict=True)):
                x = of(c)
                if kind == "lag":
                    made.append(pa.array(np.concatenate([[held[i]], x[:-1]]), pa.int64(), mask=new))
                    held[i] = x[-1]
                    continue
                total = np.cumsum(x) if kind == "sum" else np.bitwise_xor.accumulate(x)
                before = np.where(start > 0, total[start - 1], 0)
                own = total - before if kind == "sum" else total ^ before
                early = np.where(start < 0, held[i], 0)
                own = own + early if kind == "sum" else own ^ early
                held[i] = own[-1]
                made.append(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n)), *made], [*batch.schema.names, "task", "at", *named])
            at, last = at + n, g[-1]

    order_by = [F.col(c) for c in order]
    rows = store(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).mapInArrow(run, schema), name)
    key = F.col(group) if group else F.lit(0).cast("bigint")
    ends = F.struct(key.alias("key"), *[F.col(c) for c in named], *[F.col(c).alias(f"{c}_own") for c in lags])
    tasks = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min_by(key, "at").alias("first"), F.max_by(ends, "at").alias("end")).orderBy("task").collect()

    carried: dict[str, list] = {c: [] for c in ("task", "first", "before", *named)}
    before, last, held = 0, None, [0] * len(values)
    for t in tasks:
        goes_on = last is not None and t["first"] == last
        carried["task"].append(t["task"])
        carried["first"].append(t["first"])
        carried["before"].append(before)
        for i, (c, kind) in enumerate(zip(named, kinds, strict=True)):
            carried[c].append(held[i] if goes_on else None if kind == "lag" else 0)
        one = goes_on and t["end"]["key"] == t["first"]
        for i, (c, kind) in enumerate(zip(named, kinds, strict=True)):
            own = t["end"][f"{values[i]}_own"] if kind == "lag" else t["end"][c]
            held[i] = own if kind == "lag" or not one else held[i] + own if kind == "sum" else held[i] ^ own
        before, last = before + t["n"], t["end"]["key"]
    taken = local_table(spark, {
        "_task": ("int", carried["task"]), "_first": ("bigint", carried["first"]), "_before": ("bigint", carried["before"]),
        **{f"_{c}": ("bigint", carried[c]) for c in named}})
    joined = rows.join(taken, F.col("task") == F.col("_task"))
    out = []
    for c, kind in zip(named, kinds, strict=True):
        mine, early = F.col(c), F.when(key == F.col("_first"), F.col(f"_{c}"))
        if kind == "lag":
            out.append(F.coalesce(mine, F.when(F.col("at") == 0, early)).alias(c))
        else:
            early = F.coalesce(early, F.lit(0))
            out.append((mine + early if kind == "sum" else mine.bitwiseXOR(early)).alias(c))
    return joined.select(*df.columns, (F.col("_before") + F.col("at")).alias("row"), *out)
