"""Periodic runs of words: stretches that repeat a period four times or more, found by multi-scale minimizers.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least ``max(MIN_LENGTH, MIN_REPEATS * q)`` that no neighbouring word extends keeping period q.

Method, on the whole text of one document at a time:

* *Short periods*: lags up to ``SHORT`` are compared directly.
* *Scales*: scale k, a power of two, covers the periods in (k/2, k]. The k-word grams get exact numbers by doubling
  (a 2k-gram is a pair of k-grams), so no hash can hide or fake a repetition. In each window of k/2 grams the leftmost least one
  is selected, in a scrambled order of the numbers. Inside a run of period q the windows repeat q apart and so do their
  selected grams. A gram is as long as the period or longer, so within the run equal grams stand at multiples of q only
  (two periods of so long a stretch have a common divisor that is one as well): the next equal selected gram is exactly q away.
  So each pair of neighbouring equal grams is a seed with the distance as period, and no run is missed.
* *Extension*: a seed grows to both sides while words q apart agree. Stretches with a smaller period are left to that one.

Scales end where all grams differ, as longer ones do too. Rows are read alone in bounded batches: no shuffle, and work and memory of
a row grow with its own length (times its logarithm).

Defined cases: null, empty and blank texts have no words and no runs. Repeated rows get equal results. With ``reword`` a null doc_id
leaves the text as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import binary_rows, text_of

MIN_LENGTH, MIN_REPEATS, SHORT = 6, 4, 4
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)  # odd, so the product is another order of all numbers
RUN = "struct<start:bigint,length:bigint,period:bigint>"

Run = tuple[int, int, int]


def _agree(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first position from ``at`` on (step 1, or -1 for downwards) whose word differs from the one ``lag`` later."""
    size, last = 64, len(ids) - lag
    while 0 <= at < last:
        if step > 0:
            differ = ids[at : min(at + size, last)] != ids[at + lag : min(at + size, last) + lag]
        else:
            low = max(0, at + 1 - size)
            differ = (ids[low : at + 1] != ids[low + lag : at + 1 + lag])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at + step * first
        at += step * len(differ)
        size *= 2
    return at


def _is_smallest(ids: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no proper divisor of the period is a period as well; a smaller one that is no divisor can't be, at this length."""
    piece, rest, factor = ids[start : start + length], period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        lag = period // factor
        if (piece[lag:] == piece[:-lag]).all():
            return False
        while not rest % factor:
            rest //= factor
    return True


def _short_runs(ids: np.ndarray) -> Iterator[Run]:
    for q in range(1, min(SHORT, len(ids) - 1) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[q:] == ids[:-q], [False]]).astype(np.int8)))
        lengths = edges[1::2] - edges[::2] + q
        for i in np.flatnonzero(lengths >= max(MIN_LENGTH, MIN_REPEATS * q)).tolist():
            yield int(edges[2 * i]), int(lengths[i]), q


def minimizers(names: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost least gram of each window, ascending; ``window`` is a power of two."""
    value, at, width = names.astype(np.uint64) * _SCRAMBLE, np.arange(len(names)), 1
    while width < window:
        left = value[:-width] <= value[width:]
        at = np.where(left, at[:-width], at[width:])
        value = np.where(left, value[:-width], value[width:])
        width *= 2
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def _long_runs(ids: np.ndarray) -> Iterator[Run]:
    n, names, k = len(ids), ids, 1
    while MIN_REPEATS * (k + 1) <= n:  # the least period of the next scale still has room
        names = np.unique(names[:-k] * n + names[k:], return_inverse=True)[1]
        k *= 2
        if int(names.max()) + 1 == len(names):
            return
        if k <= SHORT:
            continue
        chosen = minimizers(names, k // 2)
        order = np.lexsort((chosen, names[chosen]))
        at = chosen[order]
        lag = np.diff(at)
        seeds = np.flatnonzero((np.diff(names[at]) == 0) & (lag > k // 2) & (lag <= k))
        reached: dict[int, int] = {}
        for x, q in sorted(zip(at[seeds].tolist(), lag[seeds].tolist(), strict=True)):
            if reached.get(q, 0) >= x + q:  # inside the stretch of an earlier seed
                continue
            start, end = _agree(ids, x, q, -1) + 1, _agree(ids, x, q, 1) + q
            reached[q] = end
            if end - start >= max(MIN_LENGTH, MIN_REPEATS * q):
                yield start, end - start, q


def runs_of(ids: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of the word numbers, by start and then period."""
    if len(ids) < MIN_LENGTH:
        return []
    found = {r for part in (_short_runs(ids), _long_runs(ids)) for r in part}
    return sorted((r for r in found if _is_smallest(ids, *r)), key=lambda r: (r[0], r[2]))


def best_run(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of these the first, then that of the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_tail(doc_id: int, n: int) -> np.ndarray | None:
    """Contract of the registered query: the original word that stands at each place of a document, None for all as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def find_runs(documents: DataFrame, reword: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of each row: all runs, the greatest one, and the text without repetitions.

    ``reword(doc_id, n)`` may first deal the n words anew, as positions of the original ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        as_row = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
        for batch, texts in binary_rows(batches, "text"):
            counts, every, best, collapsed = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = text.split()
                at = reword(doc_id, len(words)) if reword and doc_id is not None else None
                words = words if at is None else [words[i] for i in at.tolist()]
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                runs = runs_of(ids)
                keep = kept_words(len(words), runs) if runs else None
                top = best_run(runs)
                counts.append(len(words))
                every.append([as_row(r) for r in runs])
                best.append(as_row(top) if top else None)
                collapsed.append(b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep).tolist()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(every, pa.list_(kind)), pa.array(best, kind), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "best", "collapsed"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    return docs.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string")
