"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified.

A document is the sequence of its words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Each
run of ``size`` words, repeats included, is hashed with XXH64 (seed 42); a text with fewer words is one
run, and a text without words has fingerprint zero. A bit of the fingerprint is set if it
is set in over half of the hashes. Fingerprints link at ``radius`` (2) or fewer differing bits.

Method. Copies collapse to distinct fingerprints first. Each distinct fingerprint gets a table of its
Hamming distances to 16 reference fingerprints. The distance of two
fingerprints is at least the largest difference of their tables, so a pair is discarded where
that exceeds 2, and verified by its differing bits otherwise. Pairs are only looked at inside groups that agree on
two of four 16-bit blocks: two changed bits leave two blocks untouched, so no link is missed.
A group of more than ``GROUP`` fingerprints does not pair up. There each member meets the others
at *midpoints*, the fingerprints one changed bit away: two fingerprints link exactly
if they share a midpoint or one is a midpoint of the other, all members of a midpoint link, and at
most 33 can meet in one. So work per fingerprint is bounded in groups of any size, and nothing is dropped.

Defined cases: null and empty texts have fingerprint zero and are linked like others. Equal rows
are one class. A component's id is its smallest doc_id; a null doc_id
is in its component but never names it unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm import near_copies
from citemill.llm.common import binary_rows, text_of
from citemill.llm.components import connected_components
from citemill.session import store

SIZE, SEED, RADIUS, GROUP = 3, 42, 2, 64
#: Reference fingerprints: hashes of the first numbers.
PIVOTS = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(16)]
BLOCKS = [0xFFFF << (16 * i) for i in range(4)]
PAIRS = [BLOCKS[i] | BLOCKS[j] for i in range(4) for j in range(i + 1, 4)]
_CHUNK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = SIZE) -> int:
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[: max(1, len(words) - size + 1)] - [len(w) + 1 for w in words[: max(1, len(words) - size + 1)]]).tolist()
    ends = (ends[size - 1 :] - 1).tolist() or [len(joined)]
    return print_of(np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's run hashes, repeats included."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of each row; the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "text"):
            found = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fingerprint"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint bigint")


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``nodes(fingerprint)`` that span each component."""
    fp = F.col("fingerprint")
    pivot_table = F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in PIVOTS])
    keys = F.array(*[F.struct(F.lit(i).alias("pair"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(PAIRS)])
    rows = nodes.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.pair", "k.key")
    sizes = rows.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = rows.join(store(sizes, "block-groups"), ["pair", "key"])  # written, so the join can split a hot group

    small = grouped.where(F.col("n") <= group).withColumn("table", pivot_table).groupBy("pair", "key").agg(
        F.collect_list(F.struct("fingerprint", "table")).alias("members"))

    def near(x):
        def survives(y):
            apart = F.array_max(F.zip_with(x["table"], y["table"], lambda a, b: F.abs(a - b)))
            return (y["fingerprint"] > x["fingerprint"]) & (apart <= RADIUS) & (
                F.bit_count(x["fingerprint"].bitwiseXOR(y["fingerprint"])) <= RADIUS)

        return F.transform(F.filter("members", survives), lambda y: F.struct(x["fingerprint"].alias("a"), y["fingerprint"].alias("b")))

    verified = small.select(F.explode(F.flatten(F.transform("members", near))).alias("l")).select("l.a", "l.b")

    free = [F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in PAIRS]
    large = grouped.where(F.col("n") > group).select(
        "pair", "fingerprint", F.explode(F.element_at(F.array(*free), F.col("pair") + 1)).alias("bit"))
    midpoints = large.groupBy("pair", F.col("fingerprint").bitwiseXOR(F.col("bit")).alias("midpoint")).agg(F.collect_list("fingerprint").alias("members"))
    met = midpoints.where(F.size("members") > 1).select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return verified.unionByName(met)


def near_duplicates(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_hash, fingerprint, root, component_id) of each row; ``root`` is one fingerprint of the component."""
    prints = store(fingerprints(documents, size), "fingerprints")
    nodes = store(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(nodes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    linked = nodes.join(roots, "fingerprint")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fingerprint", "root", "component_id")
    classes = nodes.join(named, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    # a written table, so the join can split the rows of one fingerprint
    return prints.join(store(classes, "fingerprint-classes"), "fingerprint", "left").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def drop_near_duplicates(documents: DataFrame, size: int = near_copies.SIZE, similarity: Fraction = near_copies.SIMILARITY) -> DataFrame:
    """One document of each component of near copies, with all its columns: that of the smallest doc_id, then text hash; null ids come last.

    The components are those of ``near_copies``, which takes fingerprint links first and then finds what two bits miss.
    Rows meet the kept (doc_id, text hash) in one shuffle, which also leaves one of several equal rows.
    """
    found = near_copies.classes(documents, size, similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("first"))
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(1 << 63)))
    kept = store(first.select(key("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "kept-documents")
    rows = documents.select(key("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    one = rows.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return one.select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])
