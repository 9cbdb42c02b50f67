"""Quality rules: base counts of a text, and lines that repeat across the documents of a host.

*Base* (words are ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars, n_symbols (``[#*$%&|<>]``),
n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words (words in 8-word
windows that stand twice or more in the text, the first included). A text fails with fewer than 20 words or
with over 30 % repeated words.

*Method*: lines are normalised (A-Z in lower case, runs of blanks as one space, trimmed) and hashed with their
host; distinct documents are counted for each; lines in more than ``max_docs`` documents of a host are removed
(all of them); a document that keeps less than ``min_left`` of its word characters is depleted and
rejected. Only hashes are shuffled; the counts are partial aggregates, so a line on a third of
all documents is one group of small partial rows.

Defined cases: a null text is empty; it fails the base. A null host is a host of its own. Rows that share
doc_id and text count once, rows with a null doc_id once for each text. Documents without word characters are not depleted (the base rejects them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import binary_rows, lower_ascii, text_of
from citemill.llm.line_dedup import words_of
from citemill.session import store

MAX_DOCS, MIN_LEFT = 50, 0.2
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that stand twice or more. Exact: pairs of numbered runs double to the window."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - window:  # a repeated window repeats as many words
        return 0
    width = 1
    while width < window:
        ids = np.unique(ids[:-width] * (len(words) + 1) + ids[width:], return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The base counts in the order of the columns."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined) - int(((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def base_table(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base counts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "text"):
            counts = list(zip(*map(base_counts, texts), strict=True)) or [()] * len(_BASE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "text_hash", *_BASE])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, " + ", ".join(f"{c} bigint" for c in _BASE))


def common_lines(documents: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text_hash, pos, chars) of the lines above the limit."""
    split = documents.select(
        "doc_id", F.xxhash64(text_of()).alias("text_hash"), F.col(host).alias("host"), F.posexplode(F.split(lower_ascii(text_of()), "\n", -1)).alias("pos", "line"))
    line = F.btrim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))
    hashed = split.select("doc_id", "text_hash", "host", "pos", line.alias("line")).where("line <> ''").select(
        "doc_id", "text_hash", "pos", F.length(F.replace("line", F.lit(" "))).alias("chars"),
        F.xxhash64(F.col("host").isNull(), "host", "line").alias("line_hash"))
    hashed = store(hashed, "host-lines")
    once = hashed.groupBy("line_hash", "doc_id", "text_hash").agg(F.lit(1).alias("one"))
    common = once.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)
    # a written table: of known size, and the join can then split a hot line
    return hashed.join(store(common, "host-common-lines"), "line_hash").select("doc_id", "text_hash", "pos", "chars").distinct()


def removed_bitmaps(lines: DataFrame) -> DataFrame:
    """The lines to remove as keep bitmaps, for ``line_dedup.apply_bitmaps``."""
    return words_of(lines)


def judge(documents: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """(doc_id, base counts, removed_chars, base_failed, kept) of each row."""
    removed = common_lines(documents, host, max_docs).groupBy(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.sum("chars").alias("removed_chars"))
    base = base_table(documents)
    joined = base.join(removed, base["doc_id"].eqNullSafe(removed["id"]) & (base["text_hash"] == removed["hash"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_chars", F.lit(0))
    depleted = (gone > 0) & (F.col("word_chars") - gone < min_left * F.col("word_chars"))
    return joined.select("doc_id", *_BASE, gone.alias("removed_chars"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
