"""Token ids as flat binary files with 64-bit document offsets, read by memory map.

Layout of a folder: ``kind=ids/part-N-*`` holds the ids of one range of doc_ids as flat
little-endian unsigned integers of 2 or 4 bytes, whichever the vocabulary needs, and each
document ends with the end id. ``kind=index/part-N-*`` holds one ``INDEX`` record for each
document in the same order: doc_id and end of the document in the file (64-bit). Where
a file starts among all ids is the sum of the lengths of the files before it.

Method: documents are range-partitioned and sorted by (doc_id, text hash); each task
tokenizes its range as a stream and emits bytes. Spark's text sink writes raw bytes, with
the end id as its line separator, so the files appear by Spark's own task and job
commit, on whatever store the path names, and a task lost half-way leaves nothing behind. Bases are
prefix sums over file lengths. The reader maps files on shared disks with ``numpy.memmap`` and gets
files on other stores from Spark's binary source; neither copies a file through the driver.

Defined cases: a null or empty text is the end id alone. Rows that share a doc_id each
get their own record, ordered by text hash, so a doc_id on a third of all rows splits. A null doc_id sorts first and is stored as
-2^63. An empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill.llm.common import text_of

NO_ID = -(1 << 63)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def index_type(ids: np.dtype) -> np.dtype:
    """One document: its id, where its ids end, and the end id, which is the sink's separator."""
    return np.dtype([("doc_id", "<i8"), ("end", "<i8"), ("mark", ids)])


class Encoder:
    """Token ids of a text as bytes, by the tokenizers library.

    Byte-level pieces never reach over a single space between two other characters, so
    texts are cut there and each distinct unit is tokenized once. Texts with other white
    space next to such a cut, or with the special token, are given to the library as a whole.
    ``cache_size`` bounds the units remembered by a Python worker; it does not change results.
    When half of it is full, units not met since the half before are forgotten.
    """

    def __init__(self, path: str, dtype: np.dtype, cache_size: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.cache_size = Tokenizer.from_file(path), dtype, cache_size
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of pieces that begin with the space
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *units = text.split(" ")  # units after the first stand without their space
        if first[:1].isspace() or first[-1:].isspace() or not first:
            return self.whole(text)
        ids = list(map(self.cache.get, units))
        if None in ids:
            new = {u for u, i in zip(units, ids, strict=True) if i is None}
            if len(self.cache) + len(new) > self.cache_size // 2:
                self.cache, self.older, new = {}, self.cache, set(units)
            if not self.learn(new):
                return self.whole(text)
            ids = map(self.cache.__getitem__, units)
        return self.whole(first) + b"".join(ids)

    def learn(self, new: set[str]) -> bool:
        """Remember the ids of units, from the half before or in one call to the library; False if one can't stand alone."""
        if self.older:
            known = self.older.keys() & new
            self.cache.update({u: self.older[u] for u in known})
            new = new - known
        if any(not u or u[0].isspace() or u[-1].isspace() for u in new):
            return False
        names = list(new)
        ids = np.array(self.tokenizer.encode("".join([" " + u for u in names]), add_special_tokens=False).ids, self.dtype)
        cuts = (np.flatnonzero(self.opens[ids]) * self.dtype.itemsize).tolist() + [len(ids) * self.dtype.itemsize]
        if len(cuts) != len(names) + 1:
            return False
        raw = ids.tobytes()
        self.cache.update({u: raw[a:b] for u, a, b in zip(names, cuts, cuts[1:])})
        return True


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, np.dtype(dtype))


def write_ids(documents: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int, shards: int | None = None) -> None:
    """Write the ids of all documents. ``shards``: number of files, Spark's shuffle partitions if None."""
    dtype = id_type(vocabulary)
    end = end_id.to_bytes(dtype.itemsize, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seq, reach = encoder(tokenizer, dtype.str), 0, 0
        for batch in batches:
            kinds, order, values = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = of(text.decode("utf-8", "replace"))
                reach += len(ids) // dtype.itemsize + 1
                index = (NO_ID if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + reach.to_bytes(8, "little")
                kinds += ["ids", "index"]
                order += [seq, seq]
                values += [ids, index]
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(order, pa.int64()), pa.array(values, pa.binary())], ["kind", "seq", "value"])

    order = ["doc_id", "hash"]
    docs = documents.select("doc_id", text_of().cast("binary").alias("text"), F.xxhash64(text_of()).alias("hash"))
    dealt = docs.repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order)
    rows = dealt.select("doc_id", "text").mapInArrow(encode, "kind string, seq bigint, value binary").sortWithinPartitions("kind", "seq")
    rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option(
        "encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(folder)  # the separator's bytes as they are


def files_of(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """(shard, ids_path, index_path, base): base is the number of ids in the files before."""
    width = id_type(vocabulary).itemsize
    # path and length alone: the binary source does not open the files for these
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0").select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "path", (F.col("length") / width).cast("long").alias("n"),
        F.regexp_extract("path", "kind=([a-z]+)/", 1).alias("kind"))
    pick = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    files = every.where("kind <> ''").groupBy("shard").agg(pick("ids", "path").alias("ids_path"), pick("index", "path").alias("index_path"), pick("ids", "n").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_documents(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    dtype = id_type(vocabulary)
    columns = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def documents_in(ids: np.ndarray, index: np.ndarray, base: int) -> Iterator[pd.DataFrame]:
        for at in range(0, len(index), 4096):
            part = index[at : at + 4096]
            ends = part["end"].astype(np.int64)
            starts = np.concatenate([[index["end"][at - 1] if at else 0], ends[:-1]]).astype(np.int64)
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            doc_id = pd.array(part["doc_id"].astype(np.int64), dtype="Int64")
            doc_id[part["doc_id"] == NO_ID] = pd.NA
            yield pd.DataFrame({"doc_id": doc_id, "start": starts + base, "n_tokens": ends - starts, "ids_crc32": crc})

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote, urlparse

        for frame in frames:
            for ids_path, index_path, base in zip(frame["ids_path"], frame["index_path"], frame["base"], strict=True):
                local = lambda p: unquote(urlparse(p).path)
                yield from documents_in(np.memmap(local(ids_path), dtype, "r"), np.memmap(local(index_path), index_type(dtype), "r"), base)

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, index, base in zip(frame["ids"], frame["index"], frame["base"], strict=True):
                yield from documents_in(np.frombuffer(ids, dtype), np.frombuffer(index, index_type(dtype)), base)

    from citemill.sources.files import exists

    if not exists(spark, f"{folder}/kind=ids"):
        return spark.createDataFrame([], columns)
    files = files_of(spark, folder, vocabulary)
    if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getScheme() in (None, "file"):
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a count, so that small files don't end in one task
        return files.repartition(tasks, "shard").select("ids_path", "index_path", "base").mapInPandas(mapped, columns)
    content = lambda kind: spark.read.format("binaryFile").load(f"{folder}/kind={kind}").select(F.col("path").alias(f"{kind}_path"), F.col("content").alias(kind))
    both = files.join(content("ids"), "ids_path").join(content("index"), "index_path")
    return both.select("ids", "index", "base").mapInPandas(fetched, columns)
