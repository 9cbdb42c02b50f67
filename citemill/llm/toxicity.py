"""Toxicity: a noisy channel restores disguised words, then the restored text is scored.

*Character model*: counts of character triples over every document (28 symbols: boundary, a-z, other letters), summed
by Spark; the table has at most 28^3 rows whatever the input.

*Channel*: a written word may hide letters behind look-alike digits and marks, spaces or dots between letters, and
repeated letters. Each such word is a lattice with the possible letters (and their channel cost) at each
character; Viterbi over pairs of symbols finds the likeliest word under the character model. A run of three or more
one-character words is one lattice. A word of letters alone, none twice in a row, has one path and stays as it is; other words are
restored once for each worker and then remembered.

*Score*: words, their openings and inner five-letter pieces have smoothed log-odds of toxic documents, from a bounded sample
of labelled rows: ``max_positive`` toxic and ``max_negative`` other documents, first in hash order.
A word scores as its best piece. A logistic regression on the highest word scores of a document, fitted on a third
of the sample that the log-odds have not seen, gives the score from 0 to 1. Labels whose crc32(doc_id as text) mod 5
is 0 are never read. Labels, lang, source and doc_id are no inputs of the score.

Defined cases: null and empty texts get the score of a text without known words. Rows are scored alone. A null label is
no label; of several labels the highest counts. Without a toxic label, or without labels, each score is 0.
A null doc_id is not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import binary_rows, text_of

FOLDS, MAX_POSITIVE, MAX_NEGATIVE = 5, 4000, 8000
SYMBOLS, OTHER = 28, 27
_CODES = bytes(i - 96 if 97 <= i <= 122 else i - 64 if 65 <= i <= 90 else OTHER if i >= 0xC0 else 0 for i in range(256))
_TAILS = bytes(range(0x80, 0xC0))
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
_ENDS = re.compile(r"[^\w@$|+(<€£]+$|^[^\w@$!|+(<€£]+")
_MARKS = re.compile(r"[%&*#$!?.,;:)\]}>\"']+$")
_TWICE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
#: Channel costs: a look-alike, a mark that hides nothing (at an end, inside), a mark that parts words, collapsed and doubled letters.
SWAP, DROP, INSIDE, KEEP, SINGLE, DOUBLE = 1.0, 4.0, 9.0, 9.0, 0.5, 1.0


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else 0


def character_counts(documents: DataFrame) -> np.ndarray:
    """Counts of symbol triples over all documents, 28 x 28 x 28."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for _, texts in binary_rows(batches, "text"):
            s = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_CODES, _TAILS), np.uint8)
            for at in range(0, len(s) - 2, 1 << 22):
                part = s[at : at + (1 << 22) + 2].astype(np.int32)
                total += np.bincount((part[:-2] * SYMBOLS + part[1:-1]) * SYMBOLS + part[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["triple", "n"])

    counted = documents.select(text_of().cast("binary").alias("text")).mapInArrow(run, "triple int, n bigint")
    out = np.zeros(SYMBOLS**3)
    for r in counted.groupBy("triple").agg(F.sum("n").alias("n")).collect():
        out[r["triple"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


@dataclass
class Channel:
    """Restores a written word under the character model."""

    model: list = field(repr=False)  # log P(third | first, second)
    cache_size: int = 200_000
    cache: dict[str, str] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: np.ndarray) -> Channel:
        c = counts + 0.1
        return cls(np.log(c / c.sum(axis=2, keepdims=True)).tolist())

    def slots(self, word: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of a character: the letters it may stand for, and their cost."""
        for m in re.finditer(r"(.)\1*", word, re.DOTALL):
            c, n = m[1], m.end() - m.start()
            if symbol(c):
                yield [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, 5 * DOUBLE)] if n == 2 else [(c, SINGLE), (c * 2, DOUBLE)]
            elif c in LOOKALIKES:
                yield [(x * k, SWAP * min(n, 2)) for x in LOOKALIKES[c] for k in range(1, min(n, 2) + 1)] + [
                    ("", INSIDE if 0 < m.start() and m.end() < len(word) else DROP), (" ", KEEP)]
            else:
                yield [("", SINGLE), (" ", DROP)]

    def restore(self, word: str) -> str:
        paths = {(0, 0): (0.0, None)}
        for choices in self.slots(word):
            new: dict = {}
            for (a, b), (score, chain) in paths.items():
                row = self.model[a]
                for letters, cost in choices:
                    x, y, s, tail = a, b, score - cost, chain
                    for c in letters:
                        z = symbol(c)
                        s += (row if x == a else self.model[x])[y][z]
                        x, y, tail = y, z, (tail, c)
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, tail)
            paths = new
        _, chain = max(((s + self.model[a][b][0], n, chain) for n, ((a, b), (s, chain)) in enumerate(paths.items())), key=lambda p: (p[0], -p[1]))[1:]
        out = []
        while chain:
            chain, c = chain
            out.append(c)
        return "".join(reversed(out))

    def word(self, written: str) -> str:
        """The word behind one written word, in lower case."""
        core = _MARKS.sub("", written)
        if not core.isalpha() or _TRIPLE.search(core):
            core = _ENDS.sub("", written)
        if not any(map(str.isalpha, core)) or core.isalpha() and not _TWICE.search(core):
            return core
        found = self.cache.get(core)
        if found is None:
            if len(self.cache) >= self.cache_size:
                self.cache = {}
            found = self.cache[core] = self.restore(core)
        return found


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more one-character words, joined."""
    ones = [i for i, w in enumerate(words) if len(w) == 1]
    if len(ones) < 3:
        return []
    found, run = [], [ones[0]]
    for i in [*ones[1:], -2]:
        if i == run[-1] + 1:
            run.append(i)
            continue
        if len(run) >= 3:
            found.append("".join(words[k] for k in run))
        run = [i]
    return found


def pieces(word: str) -> list[str]:
    """The word, its openings of four and five characters, and its inner runs of five."""
    marked = f"^{word}$"
    return [marked, marked[:5], marked[:6], *(marked[i : i + 5] for i in range(1, len(marked) - 5))]


@dataclass
class Scorer:
    channel: Channel
    odds: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] | None = None
    cache_size: int = 400_000
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def words(self, text: str) -> set[str]:
        """Distinct written words, with letters spelled apart joined."""
        words = text.lower().split()
        return set(words) | {f"\0{x}" for x in spelled(words)}

    def restored(self, written: str) -> str:
        return self.channel.restore(written[1:]) if written[0] == "\0" else self.channel.word(written)

    def word_score(self, written: str) -> float:
        odds = self.odds
        return max([0.0, *(odds[p] for w in self.restored(written).split() for p in pieces(w) if p in odds)])

    def features(self, text: str) -> list[float]:
        words = self.words(text)
        if new := words.difference(self.cache):
            if len(self.cache) + len(new) > self.cache_size:
                self.cache, new = {}, words
            self.cache.update({w: self.word_score(w) for w in new})
        top = sorted(filter(None, map(self.cache.__getitem__, words)), reverse=True)
        return [*(top + [0.0] * 3)[:3], math.log1p(sum(x > 3 for x in top)), 1.0]

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(labels: DataFrame, max_positive: int, max_negative: int) -> dict[int, int]:
    """doc_id -> label of the bounded training sample."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = {}
    for label, most in ((1, max_positive), (0, max_negative)):
        rows = each.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        found |= {r["doc_id"]: label for r in rows}
    return found


def log_odds(documents: DataFrame, channel: Channel, labels: dict[int, int], least: int = 5) -> dict[str, float]:
    """Pieces that speak for toxic documents, by a cautious log-odds. Only pieces in ``least`` toxic documents are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(channel)
        for batch, texts in binary_rows(batches, "text"):
            counts = (Counter(), Counter())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = {w for x in scorer.words(text.decode("utf-8", "replace")) for w in scorer.restored(x).split()}
                counts[labels[doc_id]].update({p for w in words for p in pieces(w)})
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["piece", "clean", "toxic"])

    docs = documents.where(F.col("doc_id").isin(list(labels))).select("doc_id", text_of().cast("binary").alias("text"))
    rows = docs.mapInArrow(run, "piece string, clean bigint, toxic bigint").groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = Counter(labels.values())
    logs = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1)) - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = rows.where(F.col("toxic") >= least).select("piece", logs.alias("odds")).where("odds > 0.5")
    return {r["piece"]: round(r["odds"], 6) for r in kept.collect()}


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(documents: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Scorer:
    channel = Channel.of(character_counts(documents))
    known = sample(labels, max_positive, max_negative)
    second = {d: y for i, (d, y) in enumerate(sorted(known.items())) if i % 3 == 0}
    first = {d: y for d, y in known.items() if d not in second}
    if len(set(known.values())) < 2 or len(set(first.values())) < 2 or len(set(second.values())) < 2:
        return Scorer(channel)
    scorer = Scorer(channel, log_odds(documents, channel, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "text"):
            rows = [scorer.features(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    docs = documents.where(F.col("doc_id").isin(list(second))).select("doc_id", text_of().cast("binary").alias("text"))
    rows = docs.mapInArrow(run, "doc_id bigint, x array<double>").orderBy("doc_id").collect()
    if not rows:
        return Scorer(channel)
    x, y = np.array([r["x"] for r in rows]), np.array([second[r["doc_id"]] for r in rows], float)
    return Scorer(channel, scorer.odds, fit_weights(x, y))


def score_of(scorer: Scorer, text: str = "text") -> Column:
    """The score as a column: rows keep all their columns, and nothing is shuffled."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer.score((t or b"").decode("utf-8", "replace")) for t in texts], dtype="float64")

    return run(text_of(text).cast("binary"))


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    scored = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), score_of(scorer).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a score below one half, with all their columns."""
    return documents.where(score_of(learn(documents, labels)) < 0.5)
