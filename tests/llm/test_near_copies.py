"""Near copies of the pipeline against brute-force Jaccard."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citemill.llm import near_copies, simhash

DOCS = "doc_id bigint, text string, lang string, source string, mix_epoch string"


def brute_runs(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [brute_runs(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)


@pytest.mark.parametrize("sample", [1, 4000])
def test_stage_equals_brute_force(spark, sample):
    """Edited copies around the limit, chains, a hot group, a common line, short and empty texts."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(5000)}"
    texts = [None, "", "one", "One", "a b c d e", "A b c  d E", "a b c d f"]
    for k in range(25):
        base = [word() for _ in range(r.choice([60, 200, 300]))]
        for _ in range(40 if k == 0 else 6):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if k % 3 == 1 else base
    line = " ".join(word() for _ in range(20))
    texts += [f"{line} " + " ".join(word() for _ in range(r.choice([3, 15, 40]))) for _ in range(120)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*x, "en", "s", "x") for x in rows], DOCS)
    want = brute_kept(rows)
    assert len({brute_runs(t) == set() or frozenset(brute_runs(t)) for t in texts}) > len(want) + 50
    if sample == 4000:
        out = corpus_pipeline.drop_near_duplicates(spark, df, "")
        assert out.columns == df.columns and sorted(x["doc_id"] for x in out.collect()) == want
    found = near_copies.classes(df, sample=sample).groupBy("root").agg(F.min("doc_id").alias("d")).collect()
    assert sorted(x["d"] for x in found) == want


def test_odd_rows(spark):
    """Null ids, repeated rows, one doc_id with two texts, an empty table."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (6, text + " x"), (5, "another one"), (None, None), (7, None)]
    found = near_copies.classes(spark.createDataFrame([(*x, "en", "s", "x") for x in rows], DOCS)).collect()
    assert len(found) == len(rows) and len({x["root"] for x in found}) == 3
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(*x, "en", "s", "x") for x in rows], DOCS), "")
    assert sorted((x["doc_id"], x["text"]) for x in out.collect()) == [(5, "another one"), (5, text), (7, None)]
    assert near_copies.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_fingerprints_come_first_and_a_hot_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with few edits each: the operator's links are taken, and pairs stay in proportion to the group."""
    r = random.Random(4)
    base = [f"w{r.randrange(9000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(r.randrange(6) if i else 0):
            copy[r.randrange(len(copy))] = f"x{r.randrange(9000)}"
        rows.append((i, " ".join(copy)))
    linked, judged, links, verified = [], [], simhash.links, near_copies.verified
    monkeypatch.setattr(simhash, "links", lambda nodes: linked.append(nodes.count()) or links(nodes))
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a, **k: judged.append(pairs.count()) or verified(pairs, *a, **k))
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(*x, "en", "s", "x") for x in rows], DOCS), "")
    assert sorted(x["doc_id"] for x in out.collect()) == brute_kept(rows)
    assert linked and linked[0] > 100 and sum(judged) < 10 * len(rows)


def test_runs_are_counted_in_packed_parts(spark, monkeypatch):
    """Counts are those of a plain counter, and what is shuffled for them is a few arrays and not a row for each run."""
    monkeypatch.setattr(near_copies, "PACK", 4000)
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(4)}" for _ in range(r.choice([3, 40, 400]))) for _ in range(200)] + [None, "", "one"]
    df = spark.createDataFrame([(None if t is None else t.encode(),) for t in texts], "text binary").repartition(3)
    want = Counter(k for t in texts for k in set(near_copies.count_key(near_copies.all_runs((t or "").encode())).tolist()))
    for hot in (1, 30):
        keys, n = near_copies.frequent_runs(df, 5, hot)
        assert dict(zip(keys.tolist(), n.tolist())) == {k: c for k, c in want.items() if c >= hot}
        assert keys.tolist() == sorted(keys.tolist())
    assert sorted(near_copies.frequent_runs(df, 5, 1, 7)[1].tolist(), reverse=True) == sorted(want.values(), reverse=True)[:7]
    monkeypatch.setattr(near_copies, "PARTS", 16)
    assert near_copies.packed_runs(df).count() * 50 < sum(want.values())
