"""Line deduplication by range-partitioned hashes; the result is bitmaps, not text.

A line's *key* is the line without ASCII white space at its ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines, except in the largest doc_id that holds them.

Method: only 128-bit hashes of the long keys leave the text. They are range-partitioned by
(hash, document, position) and sorted, so the lines of one key lie next to each other and a
key that a third of all documents hold is split over many ranges by document. A stream over
that order keeps the first occurrence in each document; these are counted per key with a
map-side partial count. Lines to drop become one keep bitmap per document: 64-bit words by
position, of which those with no dropped line are left out.

Defined cases: a null or empty text is one empty line. Rows that share a doc_id are one
document for the count; equal rows get equal bitmaps. A null doc_id is an id below all
others. Only the named columns are read; others do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill.llm.common import BLANKS, lower_ascii, text_of
from citemill.session import store

MIN_CHARS, MIN_DOCS = 40, 5


def line_hashes(documents: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of each line with a long key."""
    lines = documents.select(
        "doc_id", F.xxhash64(text_of()).alias("text_hash"), F.posexplode(F.split(lower_ascii(text_of()), "\n", -1)).alias("pos", "line"),
    ).select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, keep) of the documents that lose a line.

    ``keep`` is an ordered array of (word, mask): bit ``pos % 64`` of word ``pos / 64`` tells
    whether the line stays. A word that is not there keeps all its lines.
    """
    order = ["h1", "h2", "doc_id"]
    hashes = store(line_hashes(documents, min_chars), "line-hashes")
    occurrences = hashes.repartitionByRange(*order).sortWithinPartitions(*order, "text_hash", "pos")
    in_document = W.partitionBy(*order).orderBy("text_hash", "pos")  # the sort above serves it, without a shuffle
    first = occurrences.withColumn("nth", F.row_number().over(in_document)).where("nth = 1")
    common = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs)
    # a written table: of known size, and the join below can then split a hot key
    dropped = hashes.join(store(common, "common-lines"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return words_of(dropped)


def words_of(dropped: DataFrame) -> DataFrame:
    """Dropped lines (doc_id, text_hash, pos) as keep bitmaps."""
    words = dropped.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("out"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("out").alias("mask")))).alias("keep"))


def dense_words(keep: Column) -> Column:
    """The bitmap with all words up to the last one that is there."""
    def with_gap(entry: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), entry["word"] - before - 1), F.array(entry["mask"]))

    return F.flatten(F.transform(keep, with_gap))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with ``lines`` (all), ``kept`` (text of the lines that stay) and ``n_dropped``."""
    docs = documents.select(F.col("doc_id").alias("id"), text_of().alias("whole"), F.xxhash64(text_of()).alias("hash"))
    joined = docs.join(bitmaps, docs["id"].eqNullSafe(bitmaps["doc_id"]) & (docs["hash"] == bitmaps["text_hash"]), "left").select(
        F.col("id").alias("doc_id"), "whole", "keep", dense_words(F.col("keep")).alias("bits"))
    lines = F.split("whole", "\n", -1)

    def stays(_: Column, i: Column) -> Column:
        return F.coalesce(F.getbit(F.get(F.col("bits"), F.shiftright(i, 6)), i % 64) == 1, F.lit(True))

    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("keep", F.lit(0), lambda n, w: n + 64 - F.bit_count(w["mask"])), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("whole")).otherwise(F.array_join(F.filter(lines, stays), "\n")).alias("kept"))
