"""Near vectors against all pairs in double precision."""

import math

import numpy as np
import pytest

from citemill.llm import near_vectors

SCHEMA = "vec_id bigint, embedding array<double>, label int, n int, node string"


def brute(rows, similarity=0.95):
    fit = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    scaled = [np.array(v) / max(map(abs, v)) if f else None for (_, v), f in zip(rows, fit)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    up, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fit[i] and fit[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[top(i)] = top(j)
    least = {}
    for i, (vec, _) in enumerate(rows):
        ids = [x for x in (least.get(top(i)), vec) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return sorted(((vec, n[i], least[top(i)], vec == least[top(i)]) for i, (vec, _) in enumerate(rows)), key=repr)


def made(dims, r):
    """Groups of several widths around the limit, a chain, copies, multiples."""
    out = []
    for noise in (0.0, 0.02, 0.1, 0.16, 0.23, 0.3):
        base = r.standard_normal(dims)
        base /= np.linalg.norm(base)
        for _ in range(25):
            step = r.standard_normal(dims)
            out.append(base + noise * step / np.linalg.norm(step) * r.choice([0.5, 1, 1.4]))
    a, b = (x / np.linalg.norm(x) for x in r.standard_normal((2, dims)))
    b = b - (a @ b) * a
    b /= np.linalg.norm(b)
    out += [math.cos(0.3 * k) * a + math.sin(0.3 * k) * b for k in range(8)] + [5 * a, 1e-200 * a, -a, 1e200 * a]
    return out


@pytest.mark.parametrize("tile, margin", [(16, 1e-6), (1 << 14, 1e-6), (64, 0.02)])
def test_all_pairs(spark, monkeypatch, tile, margin):
    """Small tiles, one tile a strip, and a margin that sends many pairs to the exact verification."""
    r = np.random.default_rng(3)
    monkeypatch.setattr(near_vectors, "MARGIN", margin)
    vectors = [v.tolist() for v in made(64, r)] + [v.tolist() for v in made(20, r)] + [v.tolist() for v in r.standard_normal((60, 64))]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    bad = vectors[0]
    rows += [(1, None), (2, []), (3, [0.0] * 64), (4, [None, *bad[1:]]), (5, [math.nan, *bad[1:]]), (6, [math.inf, *bad[1:]]), (7, [1.0]), (8, [2.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0])]
    rows += [(None, bad), (None, [9.0, 1.0]), (1000, bad), (1000, bad)]
    df = spark.createDataFrame([(*x, 1, 1, "x") for x in rows], SCHEMA).repartition(6)
    got = [tuple(x) for x in near_vectors.near_vectors(df, tile=tile).collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == want
    assert sum(1 for x in want if x[1]) > 100


def test_single_precision_column_and_empty_table(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.2, -0.1])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, near_vectors.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tiles_return_no_pairs(spark):
    """A group of near vectors gives one count and less than one link a vector and block."""
    r = np.random.default_rng(1)
    base = r.standard_normal(64)
    rows = [(i, (base + 0.01 * r.standard_normal(64)).tolist(), 1, 1, "x") for i in range(300)]
    nodes = near_vectors.prepared(spark.createDataFrame(rows, SCHEMA), exact=False).selectExpr("node", "dims", "1L AS n", "value")
    found = near_vectors.links(near_vectors.tiled(near_vectors.placed(nodes, 16, 0.95), 1 << 14), 16, 0.95)
    assert found.count() < 4 * 2 * 2 * 300
