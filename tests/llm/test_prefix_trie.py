"""Prefix trie, running values and list ranking against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.llm import list_ranking, prefix_trie, running

CONVS = "conv_id bigint, turn bigint, role string, text string, key string, row string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    ends = lambda k: ",".join(str(c) for c in members[k] if len(whole[c]) == len(k))
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(ends(k).encode()).hexdigest()) for k in members)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVS)
    got = prefix_trie.prefix_trie(df, **options).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)
    return got


def test_hot_first_turn_copies_and_odd_rows(spark):
    """A first turn of most conversations, groups of equal ones, a family without head, nulls, ties, a very long conversation."""
    r = random.Random(2)
    rows = []
    for c in list(range(-12, 120)) + [10**12 + 3]:
        if c in (25, 40):
            continue
        rows.append((c, 0, "system", "same for all" if c % 3 else f"s{c % 4}"))
        for t in range(1, r.randrange(12)):
            rows.append((c, t, r.choice(["user", None]), r.choice(["a", "", None, "é" * 3])))
    rows += [(60, t, "user", f"long {t % 3}") for t in range(400)]
    rows += [(7, None, "user", "null turn"), (7, None, "user", "null turn"), (8, 1, "user", "tie"), (8, 1, "bot", "tie"), (None, 0, "user", "no conversation")]
    got = check(spark, rows, block=64, piece=7)
    assert max(x["depth"] for x in got) > 300 and max(x["n_convs"] for x in got) > 100


def test_one_conversation_and_none(spark):
    check(spark, [(3, 0, "user", "a")])
    check(spark, [(5, t, "user", "a") for t in range(3)] + [(c, t, "user", "a") for c in range(6, 10) for t in range(3)])
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).collect() == []


@pytest.mark.parametrize("shape", ["random", "sorted", "backwards"])
def test_list_ranks(spark, shape):
    """Lists without any locality need the rounds of mates; orderly ones don't."""
    n, r = 600, random.Random(4)
    order = list(range(n))
    if shape == "random":
        r.shuffle(order)
    elif shape == "backwards":
        order.reverse()
    links = spark.createDataFrame([(3 * a, 3 * b) for a, b in zip(order, order[1:])] + [(3 * order[-1], -1)], "elem bigint, next bigint")
    assert {x["elem"]: x["rank"] for x in list_ranking.list_ranks(links, 16).collect()} == {3 * a: i for i, a in enumerate(order)}


def test_running_values(spark):
    """Sums, exclusive-ors and lags of groups that span tasks, with equal rows."""
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 2, 3, 4]), r.randrange(50), r.randrange(1 << 40)) for _ in range(700)] + [(1, 7, 7)] * 90
    df = spark.createDataFrame(rows, "g bigint, k bigint, v bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running.running(df, ["g", "k", "v"], "test-running", "g", sums=["v"], xors=["k"], lags=["v"]).orderBy("row").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total, mixed, last = [], 0, 0, None
    for i, (g, k, v) in enumerate(sorted(rows)):
        new = last is None or last[0] != g
        total, mixed = (v, k) if new else (total + v, mixed ^ k)
        want.append((g, k, v, i, total, mixed, None if new else last[2]))
        last = (g, k, v)
    assert [tuple(x) for x in out] == want


def test_plan_moves_no_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "t", "x", "y")], CONVS)
    turns = prefix_trie.turns_of(df)
    assert "text" not in turns.columns and turns.where(F.col("bytes") == 1).count() == 1
