"""Near vectors by cosine: a subspace pigeonhole join.

Two unit vectors with cosine s or more differ by a squared distance of at most ``2 - 2 s``. After a fixed rotation, which spreads
what they differ in over all coordinates, the vectors are split into blocks of ``WIDTH`` coordinates. In at least one block the squared
distance is within the block's share of that budget, in proportion to its coordinates (pigeonhole). So:

1. Equal vectors collapse to one with a count.
2. *Range join* in each block: by the block's first coordinate vectors fall into strips twice the block's radius wide. A vector is at home in
   its strip, and a guest in the strip below if it lies within the radius of it; every pair within the radius meets in one strip once.
3. A strip with more than ``TILE`` vectors is cut to tiles of ``TILE`` by ``TILE``, so no task holds more than two sides of a tile.
   In a tile, pairs within the radius on the first coordinate (sorted, by windows) are compared on the block, and only those within
   its budget on the rest.
4. The union of the blocks' candidates is verified without writing it: a pair is judged in the first block whose budget it meets, and nowhere
   else. Rotated coordinates are kept in single precision, whose error is below ``MARGIN``: pairs farther than that from the limit are decided on
   the spot, the few others are written and decided in double precision from the original vectors.
5. A tile returns one count a vector and a spanning forest of its links, never its pairs. Counts are added up, forests give the components.

Counting every link of a group of n different near vectors needs its n^2 / 2 comparisons; they spread over tiles, and nothing of that size is
written. Exact copies cost nothing.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do vectors of different length. Repeated rows
are vectors of their own and link with each other. Rows with a null vec_id are linked like others but never name a component unless all are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm.components import connected_components
from citemill.session import store

SIMILARITY, WIDTH, TILE, SEED, MARGIN = 0.95, 16, 1 << 14, 42, 1e-6
_FOUND = "a binary, b binary, links bigint, sure boolean"
_KEYS = ["dims", "block", "strip", "part", "left", "right"]


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def starts_of(dims: int, width: int) -> np.ndarray:
    return np.arange(0, dims, width)


def budgets(dims: int, width: int, similarity: float) -> np.ndarray:
    """Squared distance allowed in each block, and a little for single precision."""
    sizes = np.diff(np.append(starts_of(dims, width), dims))
    return (2 - 2 * similarity) * sizes / dims + MARGIN


def units_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (row numbers, vectors, unit vectors) of the rows that can link."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begins = np.cumsum(lengths) - lengths
    for dims in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        vectors = flat[begins[rows][:, None] + np.arange(dims)] + 0.0
        fit = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        rows, vectors = rows[fit], vectors[fit]
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True) if len(rows) else vectors
        yield rows, vectors, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def prepared(vectors: DataFrame, exact: bool) -> DataFrame:
    """(vec_id, node, dims, value) of each row: ``node`` names equal vectors, ``value`` is rotated (single) or the unit vector (double) if ``exact``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, value, dims = [None] * batch.num_rows, [None] * batch.num_rows, [0] * batch.num_rows
            for rows, raw, unit in units_of(batch.column(1)):
                kept = unit if exact else (unit @ rotation(unit.shape[1])).astype("<f4")
                for i, r, k in zip(rows.tolist(), raw, kept, strict=True):
                    node[i], value[i], dims[i] = hashlib.blake2b(r.astype("<f8").tobytes(), digest_size=16).digest(), k.tobytes(), len(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.binary()), pa.array(dims, pa.int32()), pa.array(value, pa.binary())], ["vec_id", "node", "dims", "value"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id bigint, node binary, dims int, value binary")


def placed(nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """(dims, block, strip, guest, node, n, value): each vector in its strip of each block, and as a guest in the one below."""
    schema = "dims int, block int, strip int, guest boolean, node binary, n bigint, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for dims in np.unique(every).tolist():
                rows = np.flatnonzero(every == dims)
                part = batch.take(pa.array(rows))
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), "<f4").reshape(-1, dims)
                for block, (at, budget) in enumerate(zip(starts_of(dims, width), budgets(dims, width, similarity), strict=True)):
                    radius = np.sqrt(budget)
                    strip = np.floor(x[:, at] / (2 * radius))
                    near = np.flatnonzero(x[:, at] - strip * 2 * radius <= radius * (1 + MARGIN))
                    for guest, who in ((False, np.arange(len(rows))), (True, near)):
                        k = len(who)
                        if k:
                            own = part.take(pa.array(who))
                            yield pa.RecordBatch.from_arrays(
                                [own.column(0), pa.array(np.full(k, block, np.int32)), pa.array((strip[who] - guest).astype(np.int32)),
                                 pa.array(np.full(k, guest)), own.column(1), own.column(2), own.column(3)],
                                ["dims", "block", "strip", "guest", "node", "n", "value"])

    return nodes.select("dims", "node", "n", "value").mapInArrow(run, schema)


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """The rows of ``placed`` once for each tile they belong to; ``second`` marks the other side of a tile."""
    where = ["dims", "block", "strip"]
    sizes = rows.groupBy(*where).agg(*[F.ceil(F.sum(F.when(F.col("guest") == g, 1).otherwise(0)) / tile).cast("int").alias(c) for g, c in ((False, "homes"), (True, "guests"))])
    cut = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    at = rows.join(store(sizes, "vector-strips"), where).withColumn("mine", F.when(F.col("guest"), cut("guests")).otherwise(cut("homes")))
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spot = lambda part, left, right, second: F.struct(
        F.lit(part).alias("part"), left.cast("int").alias("left"), right.cast("int").alias("right"), second.alias("second"))
    own = F.transform(count("homes"), lambda j: spot("home", F.least("mine", j), F.greatest("mine", j), F.col("mine") > j))
    visited = F.when(F.col("guests") > 0, F.transform(count("guests"), lambda j: spot("guest", F.col("mine"), j, F.lit(False)))).otherwise(F.array())
    visits = F.when(F.col("homes") > 0, F.transform(count("homes"), lambda j: spot("guest", j, F.col("mine"), F.lit(True)))).otherwise(F.array())
    spots = F.when(F.col("guest"), visits).otherwise(F.concat(own, visited))
    return at.select(*where, "node", "n", "value", F.explode(spots).alias("t")).select(*where, "t.part", "t.left", "t.right", "t.second", "node", "n", "value")


class Forest:
    """Spanning links among numbered vectors, by hooking labels to smaller ones."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            high, at = np.unique(np.maximum(a, b), return_index=True)
            to = np.arange(len(self.label))
            to[high] = np.minimum(a, b)[at]
            self.links.append((i[at], j[at]))
            while (to != to[to]).any():
                to = to[to]
            self.label = to[self.label]


def judge_tile(left: np.ndarray, right: np.ndarray | None, block: int, width: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distance) of the candidates that this block is the first to find; ``right`` is None for pairs i < j of one side."""
    dims, allowed, starts = left.shape[1], budgets(left.shape[1], width, similarity), starts_of(left.shape[1], width)
    budget, at = allowed[block], starts[block]
    end = min(dims, at + width)
    one = right is None
    right = left if one else right
    li, ri = np.argsort(left[:, at], kind="stable"), np.argsort(right[:, at], kind="stable")
    a, b = left[li, at:end], right[ri, at:end]
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    radius = np.sqrt(budget) + MARGIN
    for top in range(0, len(a), 256):
        part = slice(top, min(len(a), top + 256))
        lo = np.searchsorted(b[:, 0], a[top, 0] - radius)
        hi = np.searchsorted(b[:, 0], a[part.stop - 1, 0] + radius, "right")
        near = aa[part, None] + bb[None, lo:hi] - 2 * (a[part] @ b[lo:hi].T) <= budget + 1e-5  # error of the product included
        i, j = np.nonzero(near)
        i, j = i + top, j + lo
        if one:
            i, j = i[i < j], j[i < j]
        i, j = li[i], ri[j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            apart = left[x].astype(float) - right[y]
            parts = np.add.reduceat(apart * apart, starts, axis=1)
            within = parts <= allowed
            mine = within[:, block] & ~within[:, :block].any(axis=1)
            yield x[mine], y[mine], parts[mine].sum(axis=1)


def links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b, links, sure): counts of a vector (b is null), spanning links, and pairs to decide exactly (not sure)."""
    limit = 2 - 2 * similarity

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dims, block, part = key[0].as_py(), key[1].as_py(), key[3].as_py()
        one = part == "home" and key[4].as_py() == key[5].as_py()
        second = table.column("second").to_numpy()
        sides = [table.filter(pa.array(~second if k == 0 else second)) for k in (0, 1)]
        value = lambda t: np.frombuffer(b"".join(t.column("value").to_pylist()), "<f4").reshape(-1, dims)
        nodes = sides[0].column("node").to_pylist() + sides[1].column("node").to_pylist()
        n = np.concatenate([s.column("n").to_numpy() for s in sides])
        shift = 0 if one else sides[0].num_rows
        total, forest, open_ = np.zeros(len(nodes), np.int64), Forest(len(nodes)), []
        for i, j, apart in judge_tile(value(sides[0]), None if one else value(sides[1]), block, width, similarity):
            j = j + shift
            doubt = np.abs(apart - limit) <= MARGIN
            open_ += zip(i[doubt].tolist(), j[doubt].tolist(), strict=True)
            sure = (apart < limit) & ~doubt
            i, j = i[sure], j[sure]
            total += np.bincount(i, n[j], len(nodes)).astype(np.int64) + np.bincount(j, n[i], len(nodes)).astype(np.int64)
            forest.add(i, j)
        out = [(nodes[i], None, int(total[i]), True) for i in np.flatnonzero(total).tolist()]
        out += [(nodes[a], nodes[b], 0, True) for i, j in forest.links for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        out += [(nodes[a], nodes[b], 0, False) for a, b in open_]
        kinds = {"a": pa.binary(), "b": pa.binary(), "links": pa.int64(), "sure": pa.bool_()}
        return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(kinds.items())})

    return rows.groupBy(*_KEYS).applyInArrow(run, _FOUND)


def decided(pairs: DataFrame, vectors: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs near the limit in double precision: counts and links of those that reach it."""
    wanted = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "vector-doubts")
    units = prepared(vectors, exact=True).select("node", "value").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("value").alias("value"))
    units = store(units.join(nodes.select("node", "n"), "node"), "vector-units")
    of = lambda c: units.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("value").alias(f"value_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in batch.to_pylist() if float(np.frombuffer(r["value_a"]) @ np.frombuffer(r["value_b"])) >= similarity]
            out = [(r["a"], None, r["n_b"], True) for r in rows] + [(r["b"], None, r["n_a"], True) for r in rows] + [(r["a"], r["b"], 0, True) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], ["a", "b", "links", "sure"])

    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(run, _FOUND)


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors(vec_id, embedding)``; ``similarity`` is above 0."""
    rows = store(prepared(vectors, exact=False), "vectors")
    nodes = store(rows.where("node IS NOT NULL").groupBy("node", "dims").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("value").alias("value")), "vector-nodes")
    found = store(links(tiled(placed(nodes, width, similarity), tile), width, similarity), "vector-links")
    found = found.where("sure").unionByName(store(decided(found.where("NOT sure"), vectors, nodes, similarity), "vector-decided"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("root", "top")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.drop("value", "dims").join(roots, "node", "left").withColumn("top", F.coalesce("top", "node"))
    component = named.groupBy("top").agg(F.min("first_id").alias("component"))
    classes = named.join(component, "top").join(counts, "node", "left").select(
        "node", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    # a written table, so the join can split the rows of one vector
    judged = rows.select("vec_id", "node").join(store(classes, "vector-classes"), "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return judged.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))
