"""Benchmark decontamination: a BM25 index of test items, block-max WAND, then overlap of question and answer.

*Words* are runs of word characters in lower case. Each document is read as passages of ``PASSAGE``
words, half overlapping, which cover the whole text. Test items are cut into segments of at most ``SEGMENT`` words;
these are the indexed units, so that a passage can hold a whole one.

*Method*. Each passage is a query. A unit is retrieved if its BM25 score reaches ``MIN_SCORE`` of its score
against itself; all such units are, there is no top-k. Postings are kept in blocks of units with their largest impacts.
Block by block a bound is compared with the threshold first: the largest impacts of the passage's
rare terms, plus all that common terms can give to a unit of that block. This is done
for all passages of a document at once. In the blocks that remain, WAND moves its pivot by the block's maxima.
A retrieved item is verified on the words around the passage: of the item's five-word
shingles at least 0.8 must stand there, and half of those that reach into its answer (the last quarter).

The index is built on the driver from one slice of the test items at a time, of at most ``slice_bytes`` of
text, and sent to the tasks; larger test sets take more passes. Nothing of the documents is collected.

Defined cases: null and empty texts hold nothing; items without words match nothing; an item with fewer than five words is one
shingle. Items of equal id and text are one item; repeated rows are reported each. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import binary_rows, text_of

PASSAGE, SEGMENT, SHINGLE, BLOCK = 64, 32, 5, 16
MIN_SCORE, MIN_OVERLAP, MIN_ANSWER = 0.7, 0.8, 0.5
K1, LENGTH = 1.2, 0.75
SLICE_BYTES = 8 << 20
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


class Index:
    """BM25 index of items (id, text). A query term counts once; impacts are shares of a unit's own score.

    Units are ordered by the share of their rare terms, and a block is ``BLOCK`` units in that order.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.shingles = [shingles_of(w) for _, w in self.items]
        units = [(n, Counter(w[a : a + SEGMENT])) for n, (_, w) in enumerate(self.items) for a in range(0, max(1, len(w) - SEGMENT // 2), SEGMENT)]
        held = Counter(t for _, c in units for t in c)
        self.terms = {t: k for k, t in enumerate(sorted(held))}
        mean = sum(c.total() for _, c in units) / max(1, len(units))
        rare = {t for t, n in held.items() if n <= max(2, len(units) // 64)}
        weighed = []
        for item, words in units:
            norm = K1 * (1 - LENGTH + LENGTH * words.total() / mean)
            raw = {t: math.log(1 + (len(units) - held[t] + 0.5) / (held[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in words.items()}
            own = sum(raw.values())
            share = {t: x / own for t, x in raw.items()}
            weighed.append((sum(x for t, x in share.items() if t in rare), item, share))
        weighed.sort(key=lambda u: u[:2])
        self.units = [item for _, item, _ in weighed]
        self.n_blocks = -(-len(weighed) // BLOCK)
        #: term -> block -> (units in order, impacts, largest impact)
        self.postings: list[dict[int, tuple[list[int], list[float], float]]] = [{} for _ in self.terms]
        for u, (_, _, share) in enumerate(weighed):
            for t, x in share.items():
                at, impacts, top = self.postings[self.terms[t]].get(u // BLOCK, ([], [], 0.0))
                self.postings[self.terms[t]][u // BLOCK] = ([*at, u], [*impacts, x], max(top, x))
        #: what the rare terms of a passage must give at least, by block: the others can't give more than the rest of a unit
        self.need = np.array([MIN_SCORE - 1 + weighed[k * BLOCK][0] for k in range(self.n_blocks)]) - 1e-9
        lists = [sorted(p.items()) if t in rare else [] for t, p in zip(sorted(held), self.postings, strict=True)] + [[]]
        self.at = np.cumsum([0, *map(len, lists)])
        self.block = np.array([k for x in lists for k, _ in x], np.int64)
        self.top = np.array([p[2] for x in lists for _, p in x])

    def hopeful(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Passage number -> blocks whose bound reaches the threshold, from the rare terms of all passages at once."""
        half, halves = PASSAGE // 2, max(1, -(-len(ids) // (PASSAGE // 2)))
        n = self.at[ids + 1] - self.at[ids]
        where = np.flatnonzero(n)
        n = n[where]
        entry = np.repeat(self.at[ids[where]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(where) else np.zeros(0, np.int64)
        found: dict[int, list[int]] = {}
        own = np.repeat(where // half, n)
        for a in range(0, halves, 1024):  # bounds the table of sums for very long texts
            b = min(halves, a + 1024)
            lo, hi = np.searchsorted(own, [a, b + 1])
            sums = np.bincount((own[lo:hi] - a) * self.n_blocks + self.block[entry[lo:hi]], self.top[entry[lo:hi]], (b - a + 1) * self.n_blocks)
            sums = sums.reshape(-1, self.n_blocks)
            for k, block in np.argwhere(sums[:-1] + sums[1:] >= self.need).tolist():
                found.setdefault(a + k, []).append(block)
        return found

    def search(self, terms: list[int], blocks: list[int]) -> list[int]:
        """All units of the blocks with a score of at least ``MIN_SCORE``, by WAND under the maxima of each block."""
        found, least = [], MIN_SCORE - 1e-9
        for block in blocks:
            cursors = [[p[0][0], 0, *p] for t in terms if (p := self.postings[t].get(block))]  # unit, place, units, impacts, top
            if sum(c[4] for c in cursors) < least:
                continue
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[4]
                    if bound >= least:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:
                    if sum(c[3][c[1]] for c in cursors if c[0] == pivot) >= least:
                        found.append(pivot)
                    pivot += 1
                for c in cursors:
                    if c[0] < pivot:
                        c[1] = bisect_left(c[2], pivot, c[1])
                        c[0] = c[2][c[1]] if c[1] < len(c[2]) else math.inf
                cursors = [c for c in cursors if c[0] < math.inf]
        return found

    def overlap(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the item's shingles, and of those that reach into its answer, found in the words."""
        mine, n = self.shingles[item], len(self.items[item][1])
        if n < SHINGLE:
            there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        else:
            there = set(shingles_of(words))
        hit = [s in there for s in mine]
        answer = hit[max(0, min(len(hit) - 1, n - max(1, n // 4) - SHINGLE + 1)) :]
        return sum(hit) / len(hit), sum(answer) / len(answer)

    def matches(self, text: str) -> list[tuple[int, float, float, int]]:
        """(item number, overlap, answer overlap, first word of the passage) of all verified items."""
        words = words_of(text)
        if not self.terms or not words:
            return []
        none = len(self.terms)
        ids = np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))
        best: dict[int, tuple[float, float, int]] = {}
        for passage, blocks in self.hopeful(ids).items():
            a = passage * (PASSAGE // 2)
            terms = [t for t in dict.fromkeys(ids[a : a + PASSAGE].tolist()) if t != none]
            for unit in self.search(terms, blocks):
                item = self.units[unit]
                if item in best and best[item][0] == 1.0:
                    continue
                n = len(self.items[item][1])
                share, answer = self.overlap(item, words[max(0, a - n) : a + PASSAGE + n])
                if share >= MIN_OVERLAP and answer >= MIN_ANSWER and (item not in best or share > best[item][0]):
                    best[item] = (share, answer, a)
        return [(i, *v) for i, v in sorted(best.items())]


def slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in slices of bounded size, in hash order of their ids."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()  # so that no slice grows with repeats
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // slice_bytes)) if total > slice_bytes else 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(documents: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap, word): one row for each document and item it holds."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    columns = "doc_id bigint, item_id bigint, overlap double, answer_overlap double, word bigint"
    found = None
    for part in slices(benchmark, slice_bytes):
        shared = spark.sparkContext.broadcast(Index(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, texts in binary_rows(batches, "text"):
                rows = [
                    (d, index.items[i][0], share, answer, at)
                    for d, t in zip(batch.column(0).to_pylist(), texts, strict=True) for i, share, answer, at in index.matches(t.decode("utf-8", "replace"))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "overlap", "answer_overlap", "word"])

        hits = docs.mapInArrow(run, columns)
        found = hits if found is None else found.unionByName(hits)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Documents that hold no test item, with all their columns; a filter on each row, without a join."""

    def holds(shared: Broadcast) -> Column:
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(shared.value.matches((t or b"").decode("utf-8", "replace"))) for t in texts], dtype=bool)

        return run(text_of().cast("binary"))

    for part in slices(benchmark, slice_bytes):
        documents = documents.where(~holds(documents.sparkSession.sparkContext.broadcast(Index(part))))
    return documents
