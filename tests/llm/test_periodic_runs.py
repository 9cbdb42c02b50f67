"""Periodic runs against a search over all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citemill.llm import periodic_runs, queries


def brute_runs(words):
    """Every start and period by comparing words one at a time."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(6, 4 * q) and (start == 0 or words[start - 1] != words[start - 1 + q]):
                piece = words[start:end]
                if not any(all(piece[i] == piece[i + r] for i in range(len(piece) - r)) for r in range(1, q)):
                    found.append((start, end - start, q))
            start = max(start + 1, end - q + 1) if end - start > q else start + 1
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def ids_of(words):
    number = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_few_words(words):
    assert periodic_runs.runs_of(ids_of(words)) == brute_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 7), st.integers(0, 12), st.integers(2, 30)), min_size=1, max_size=3), st.randoms(use_true_random=False))
def test_planted_repetitions(parts, r):
    """Repeated blocks of any period, with remainders, inside other text, some words changed."""
    words = []
    for period, times, extra, letters in parts:
        block = [r.randrange(letters) for _ in range(period)]
        words += [r.randrange(letters) for _ in range(extra)] + (block * (times + 1))[: period * times + extra % (period + 1)]
    if r.random() < 0.3:
        words[r.randrange(len(words))] = -1
    assert periodic_runs.runs_of(ids_of(words)) == brute_runs(words)


def test_periodic_words_of_many_scales():
    fibonacci, thue = ["a", "ab"], [0]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 256:
        thue += [1 - x for x in thue]
    for words in (list(fibonacci[-1] * 4), thue * 5, [0] * 300, list(range(100)) * 4, list(range(101)) * 4 + [3]):
        assert periodic_runs.runs_of(ids_of(words)) == brute_runs(words)


def test_seeds_alone_find_long_periods():
    """The scales, without the direct lags, find every run with a period above the short ones."""
    r = random.Random(3)
    for _ in range(60):
        period = r.randrange(5, 60)
        block = [r.randrange(4) for _ in range(period)]
        words = [r.randrange(4) for _ in range(r.randrange(30))] + block * 4 + [r.randrange(4) for _ in range(r.randrange(30))]
        ids = ids_of(words)
        found = {x for x in periodic_runs._long_runs(ids) if periodic_runs._is_smallest(ids, *x)}
        assert {x for x in brute_runs(words) if x[2] > periodic_runs.SHORT} <= found


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_equals_brute_force(spark, tmp_path, partitions):
    r = random.Random(5)
    texts = [None, "", " \t\n", "one", "a a a a a a", "a b a b a b a b", "  x  x x x x x x", "é é é é é é é"]
    texts += [" ".join(f"w{r.randrange(r.choice([3, 400]))}" for _ in range(r.randrange(220))) for _ in range(110)]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "one"), (None, "q q q q q q q"), (None, None), (10**15, "z " * 500)]
    df = spark.createDataFrame([(*x, "en", "s", 1, "x") for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, best string")
    df.repartition(partitions).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=lambda x: key(x[:2]) + key(x[6:])) == sorted((brute_row(*x) for x in rows), key=lambda x: key(x[:2]) + key(x[6:]))
    assert any(x["period"] and x["period"] > 8 for x in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, runs string")
    assert periodic_runs.find_runs(empty).collect() == []
