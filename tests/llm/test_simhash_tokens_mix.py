"""SimHash, components, token files and mixing against plain Python."""

import random
import uuid
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citemill.llm import components, mixing, simhash, token_files
from citemill.session import checkpoint_dir

DOCS = "doc_id bigint, text string, lang string, source string, mix_epoch string"


def brute_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split()]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one Two", "a b c", "É é x  y\tz", "a " * 50, "the quick brown fox jumps over"])
def test_fingerprints(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert simhash.fingerprints(df).first()["fingerprint"] % (1 << 64) == brute_print(text)


def classes_of(nodes, near):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("group", [64, 1])
def test_links_span_the_components(spark, group):
    """Dense clusters, chains and strangers; with group 1 everything meets at midpoints."""
    r = random.Random(5)
    prints = set()
    for _ in range(6):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(60):
            y = x
            for _ in range(r.choice([1, 1, 2, 3])):
                y ^= 1 << r.randrange(64)
            prints.add(y)
            x = r.choice([x, x, y])
    prints |= {r.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    nodes = sorted(simhash._signed(p) for p in prints)
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2
    links = simhash.links(spark.createDataFrame([(n,) for n in nodes], "fingerprint bigint"), group)
    found = {(r["a"], r["b"]) for r in links.collect()}
    assert all(near(a, b) for a, b in found)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = classes_of(nodes, near)
    by_want, by_got = {}, {}
    for n in nodes:
        by_want.setdefault(want[n], set()).add(n)
        by_got.setdefault(roots.get(n, n), set()).add(n)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(edges).select("root").distinct().count() == 1
    assert components.connected_components(edges.where("a < 0")).count() == 0


def test_near_duplicates_cases(spark):
    rows = [(5, "a b c d e"), (3, "A  b c d E"), (9, None), (8, ""), (7, "other words stand here today"), (7, "other words stand here today"), (None, "a b c d e"), (None, "alone in null")]
    df = spark.createDataFrame([(*r, "en", "s", "x") for r in rows], DOCS)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (7, 7), (7, 7), (None, 3), (None, None)], key=repr)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 3, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


TEXTS = [
    "", "plain words here", " leading", "trailing ", "two  spaces", "tab\there\nand lines\n\nmore", "don't we'll 's", "É über naïve 12 345", "<|endoftext|> inside <|endoftext|>",
    "end.\nNext  line", "\u00a0nbsp \u00a0 x", "emoji 😀 👍🏽 x", "# 2 # #", "a" * 500 + " b", "\x1c odd \x85 marks", "   ", "x y" * 100,
]


def test_encoder_equals_the_library(tokenizer):
    path, library = tokenizer
    for size in (100_000, 20):
        encode = token_files.Encoder(path, np.dtype("<u2"), size)
        for text in TEXTS * 2:
            assert np.frombuffer(encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, tokenizer):
    path, library = tokenizer
    rows = [*((3 * i % 17, t) for i, t in enumerate(TEXTS)), (40, None), (None, "null id"), (41, "same"), (41, "same"), (-5, "minus")]
    folder = f"{checkpoint_dir(spark)}/token-test-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*r, "en", "s", "x") for r in rows], DOCS)
    token_files.write_ids(df, folder, path, 50_257, 2, shards=5)
    got = [tuple(r) for r in token_files.read_documents(spark, folder, 50_257).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: -(1 << 63) if i is None else i)
    assert [g[1] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    want = sorted(((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in rows for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 2]]), key=repr)
    assert sorted(((d, n, c) for d, _, n, c in got), key=repr) == want


def test_token_files_of_nothing(spark, tokenizer):
    folder = f"{checkpoint_dir(spark)}/token-test-{uuid.uuid4().hex}"
    df = spark.createDataFrame([], DOCS)
    token_files.write_ids(df, folder, tokenizer[0], 50_257, 2)
    assert token_files.read_documents(spark, folder, 50_257).collect() == []


@pytest.mark.parametrize("end_id, vocabulary", [(0, 50_257), (10, 50_257), (127, 50_257), (128, 50_257), (255, 50_257), (50_256, 50_257), (199, 100_000), (99_999, 100_000)])
def test_end_ids_of_any_value(spark, tokenizer, end_id, vocabulary):
    """Files of 2 and 4 bytes an id come back whole, whatever bytes the end id has."""
    path, library = tokenizer
    folder = f"{checkpoint_dir(spark)}/token-test-{uuid.uuid4().hex}"
    rows = [(1, "one two three"), (2, ""), (3, "four\nfive")]
    token_files.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), folder, path, vocabulary, end_id)
    ids = [[*library.encode(t, add_special_tokens=False).ids, end_id] for _, t in rows]
    got = [tuple(r)[2:] for r in token_files.read_documents(spark, folder, vocabulary).orderBy("start").collect()]
    assert got == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def brute_share(budget, children):
    """children: label -> (weight, capacity); exact shares by repeated filling."""
    given, left = {}, dict(children)
    budget = min(budget, sum(c for _, c in children.values()))
    while left:
        total = sum(w for w, _ in left.values())
        full = [k for k, (w, c) in left.items() if budget * w >= c * total]
        if not full:
            break
        for k in full:
            given[k] = left.pop(k)[1]
            budget -= given[k]
    total = sum(w for w, _ in left.values())
    parts = {k: budget * w // total for k, (w, _) in left.items()}
    for k in sorted(parts)[: budget - sum(parts.values())]:
        parts[k] += 1
    return given | parts


def test_budgets_equal_repeated_filling(spark):
    r = random.Random(3)
    rows = [(d, lang, s, r.choice([0, 1, 7, 50, 900])) for d in "xyz" for lang in ("en", "de", "") for s in ("s1", "s2", "s3", "s4") if r.random() < 0.8]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, available bigint")
    for percent, epochs in ((10, 1), (60, 2), (150, 2), (1000, 3)):
        mix = mixing.Mix(domains={"x": 5, "y": 1}, languages={"en": 3}, sources={"s1": 2, "s4": 9}, percent=percent, max_epochs=epochs)
        got = {tuple(x[c] for c in mixing.LEAF): x["budget"] for x in mixing.budgets(leaves, mix).collect()}
        cap = lambda *key: sum(n * epochs for *k, n in rows if tuple(k[: len(key)]) == key)  # noqa: B023, E731
        labels = lambda *key: sorted({k[len(key)] for k in rows if k[: len(key)] == key})
        want = {}
        top = brute_share(sum(x[3] for x in rows) * percent // 100, {d: (mix.domains.get(d, 1), cap(d)) for d in labels()})
        for d, b in top.items():
            for lang, c in brute_share(b, {k: (mix.languages.get(k, 1), cap(d, k)) for k in labels(d)}).items():
                want |= {(d, lang, s): n for s, n in brute_share(c, {k: (mix.sources.get(k, 1), cap(d, lang, k)) for k in labels(d, lang)}).items()}
        assert got == want


def test_mix_takes_exact_prefixes(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"src{i % 4}", "old") for i in range(120)] + [(None, "a b", "en", "src0", "old"), (5, "same row", "de", None, "old"), (5, "same row", "de", None, "old")]
    df = spark.createDataFrame(rows, DOCS)
    mix = mixing.Mix(sources={"src1": 40}, percent=70, max_epochs=3)
    plan = {(r["lang"], r["source"]): r["budget"] for r in mixing.plan(df, mix).collect()}
    taken = mixing.mix(df, mix)
    assert [c for c in taken.columns if not c.startswith("mix_")] == ["doc_id", "text", "lang", "source"]
    got = {}
    for r in taken.collect():
        assert 0 <= r["mix_take"] <= r["mix_tokens"]
        key = (r["lang"] or "", r["source"] or "")
        got[key] = got.get(key, 0) + r["mix_take"]
    assert {k: v for k, v in plan.items() if v and k != ("de", "")} == {k: v for k, v in got.items() if v and k != ("de", "")}
    assert mixing.mix(df.limit(0), mix).count() == 0
