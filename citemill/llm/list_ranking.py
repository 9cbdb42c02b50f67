"""Distributed list ranking: places of the elements of one linked list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.session import store

BLOCK = 1 << 14
_STEP = "elem bigint, next bigint, size bigint, head bigint, offset bigint"


def contract_block(elem: np.ndarray, nxt: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next, size, head, offset) of each element of a block: links inside the block are followed by doubling.

    ``elem`` ascends; ``nxt`` is -1 at the end of the list. A head is an element without a predecessor in the block; it stands for the
    chain behind it, whose members know their offset from it.
    """
    n = len(elem)
    place = np.minimum(np.searchsorted(elem, nxt), n - 1)
    inside = elem[place] == nxt
    jump, far = np.where(inside, place, np.arange(n)), np.where(inside, size, 0)
    for _ in range(max(1, (n - 1).bit_length())):  # far: what lies between an element and the last of its chain
        far, jump = far + far[jump], jump[jump]
    first = np.ones(n, bool)
    first[place[inside]] = False
    head_of = np.zeros(n, np.int64)
    heads = np.flatnonzero(first)
    head_of[jump[heads]] = heads
    head = head_of[jump]
    return nxt[jump], far + size[jump], elem[head], far[head] - far


def _contract(live: DataFrame, block: int, name: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            elem, nxt, size = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
            after, total, head, offset = contract_block(elem, nxt, size)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (elem, after, total, head, offset)], ["elem", "next", "size", "head", "offset"])

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if held and held + part.num_rows > block:
                    yield done(parts)
                    parts, held = [], 0
                parts.append(part)
                held += part.num_rows
        if parts:
            yield done(parts)

    dealt = live.coalesce(1) if whole else live.repartitionByRange("elem")  # whole: at most one block of rows
    return store(dealt.sortWithinPartitions("elem").mapInArrow(run, _STEP), name)


def _mate(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of random mates: (what is left, what was taken in as (elem, head, offset))."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
    later = live.where(coin("elem") == 0).select(F.col("elem").alias("next"), F.col("next").alias("after"), F.col("size").alias("more"))
    joined = store(live.where(coin("elem") == 1).join(later, "next", "left").select("elem", "next", "size", "after", "more"), "list-mates")
    taken = joined.where("more IS NOT NULL").select(F.col("next").alias("elem"), F.col("elem").alias("head"), F.col("size").alias("offset"))
    grown = joined.select("elem", F.coalesce("after", "next").alias("next"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
    rest = live.where(coin("elem") == 0).select("elem", "next", "size").join(taken.select("elem"), "elem", "left_anti")
    return store(grown.unionByName(rest), "list-live"), taken


def list_ranks(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(elem, rank) of each element of ``links(elem, next)``, one list of distinct numbers; the last one has a next of -1.

    Elements are dealt by range and contracted in blocks of ``block``: the first of each chain inside a block stays and stands for the rest.
    Where numbers that are near in the list are near in value this leaves few elements, and each further level covers wider ranges.
    A level that leaves over three quarters is followed by rounds of random mates, which take in a quarter of any list. Once one block
    is left it is ranked, and the levels are undone: an element's rank is that of its head plus its offset. A head has fewer
    than ``block`` members, so no join has a hot key, and a task holds one block. Every level is a written table.
    """
    live, levels, turn = store(links.select("elem", "next", F.lit(1).cast("bigint").alias("size")), "list-live"), [], 0
    n = live.count()
    while n > block:
        step = _contract(live, block, "list-level", False)
        levels.append(step.where("elem <> head").select("elem", "head", "offset"))
        live = step.where("elem = head").select("elem", "next", "size")
        left = live.count()
        while left > 0.75 * n:
            live, taken = _mate(live, turn := turn + 1)
            levels.append(taken)
            left = live.count()
        n = left
    ranks = _contract(live, block, "list-level", True).select("elem", F.col("offset").alias("rank"))
    for level in reversed(levels):
        known = ranks.withColumnRenamed("elem", "head").withColumnRenamed("rank", "from")
        ranks = store(ranks.unionByName(level.join(known, "head").select("elem", (F.col("from") + F.col("offset")).alias("rank"))), "list-ranks")
    return ranks
