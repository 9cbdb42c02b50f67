"""Trie of conversation prefixes; subtree sums by an Euler tour that is ranked as a list.

A conversation is its turns in order (null first; ties by role, then by the hash of role and text). It is rebuilt: the first h turns of
the conversation at the head of its family (``c - c % FAMILY``), then its own behind its first h. A node is a distinct sequence of first turns
of rebuilt conversations; its name is (smallest member, depth).

Method:

1. Turns shrink to hashes and lengths; texts never leave the first scan. Positions come from running counts over ranges of (conversation, turn).
2. Each turn is hashed twice with its depth; a prefix is the running exclusive-or of these, 128 bits. A partial aggregate by prefix gives the nodes.
3. Nodes are numbered by (conversation, depth). A node's child with the same smallest member, if any, has the next number; all other children
   are *tops* and look up their parent by its prefix, written tables on both sides.
4. *Euler tour*: every node gives an enter arc 2v and an exit arc 2v + 1. Behind an enter arc comes that of the child of the next number, then those of
   the tops, greatest first. A running lag over (parent, number) links the tops, so a parent with any number of children is no hot group.
5. ``list_ranks`` gives the places of the arcs. Leaves and savings stand at enter arcs; a node's subtree sum is the difference of the
   prefix sums at its two arcs.
6. ``ends_sha256`` is one stream of bytes by definition. Ids are packed to pieces of ``PIECE`` ids in many tasks first, so the task that hashes a
   node's stream reads few rows and holds one piece, however many conversations are equal.

Defined cases: null role or text is empty. Turns without conv_id belong to no conversation and are left out. A conversation is a member of the root even
without turns left. Repeated turns are kept as turns of their own. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm.list_ranking import BLOCK, list_ranks
from citemill.llm.running import running
from citemill.session import store

FAMILY, SHARED, PIECE = 5, 9, 1 << 15
_KEY = ("depth", "p1", "p2")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes): the turns in order; ``key`` is the hash of role and text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("one"), F.monotonically_increasing_id().alias("equal"))
    ranked = running(slim, ["conv_id", "turn", "role", "key", "equal"], "trie-turns", "conv_id", sums=["one"])
    return ranked.select("conv_id", (F.col("one_sum") - 1).alias("pos"), "key", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv_id, len), turns (conv_id, len, depth, key, bytes)) after the first turns of each family head have been put in front."""
    counts = store(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).alias("shared")
    heads = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = counts.select("conv_id", "n", base, shared).join(heads, "base", "left").select(
        "conv_id", "base", "shared", F.least("shared", F.coalesce("n_base", F.lit(0))).alias("taken"), "n")
    convs = store(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))), "trie-conversations")
    own = turns.join(convs.select("conv_id", "shared", "taken", "len"), "conv_id").where(F.col("pos") >= F.col("shared")).select(
        "conv_id", "len", (F.col("taken") + F.col("pos") - F.col("shared") + 1).alias("depth"), "key", "bytes")
    first = turns.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.select("conv_id", "base", "taken", "len"), "base").where(F.col("pos") < F.col("taken")).select(
        "conv_id", "len", (F.col("pos") + 1).alias("depth"), "key", "bytes")
    return convs.select("conv_id", "len"), own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, len, bytes, depth, p1, p2, q1, q2): each rebuilt turn with the hash of the prefix it ends (p) and of the one before (q)."""
    hashed = turns.select("conv_id", "len", "depth", "bytes", *[F.xxhash64(F.lit(i), "depth", "key").alias(f"h{i}") for i in (1, 2)])
    ranked = running(hashed, ["conv_id", "depth"], "trie-prefixes", "conv_id", xors=["h1", "h2"])
    return ranked.select(
        "conv_id", "len", "bytes", "depth", *[F.col(f"h{i}_xor").alias(f"p{i}") for i in (1, 2)],
        *[F.col(f"h{i}_xor").bitwiseXOR(F.col(f"h{i}")).alias(f"q{i}") for i in (1, 2)])


def nodes_of(convs: DataFrame, ended: DataFrame) -> DataFrame:
    """Numbered nodes (row, conv_id, depth, len of conv_id, n_convs, bytes, prefix, prefix before, above: number of the row before in conv_id)."""
    zero = F.lit(0).cast("bigint")
    least = F.min(F.struct("conv_id", "len")).alias("least")
    found = ended.groupBy(*_KEY).agg(least, F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    root = convs.agg(least, F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(c) for c in _KEY], "least", "n_convs", *[zero.alias(c) for c in ("bytes", "q1", "q2")])
    nodes = found.unionByName(root).select("least.conv_id", "least.len", *_KEY, "n_convs", "bytes", "q1", "q2")
    return running(nodes, ["conv_id", "depth"], "trie-nodes", "conv_id", lags=["depth"]).withColumnRenamed("depth_lag", "above")


def end_digests(convs: DataFrame, ended: DataFrame, piece: int = PIECE) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the prefixes at which conversations end."""
    zero = F.lit(0).cast("bigint")
    ends = ended.where("depth = len").select(*_KEY, "conv_id").unionByName(convs.where("len = 0").select(*[zero.alias(c) for c in _KEY], "conv_id"))
    order = [*_KEY, "conv_id"]
    keys = lambda batch: [batch.column(i).to_numpy() for i in range(3)]
    edges = lambda key: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of one prefix in pieces; a piece never waits for a second batch with another prefix, nor grows beyond ``piece`` ids."""
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*order, "ids"])

        now, ids = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, conv, rows = keys(batch), batch.column(3).to_pylist(), []
            cuts = [*edges(key).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                at = tuple(int(k[a]) for k in key)
                if at != now:
                    if ids:
                        rows.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = at, []
                ids += conv[a:b]
                while len(ids) >= piece:
                    rows.append((*now, ids[0], ",".join(map(str, ids[:piece]))))
                    ids = ids[piece:]
            yield made(rows)
        if ids:
            yield made([(*now, ids[0], ",".join(map(str, ids)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for *at, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != now:
                    if now:
                        rows.append((*now, state.hexdigest()))
                    now, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield out(rows)
        if now:
            yield out([(*now, state.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 3 + (pa.string(),)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*_KEY, "ends_sha256"])

    typed = ", ".join(f"{c} bigint" for c in order)
    pieces = store(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, f"{typed}, ids string"), "trie-end-pieces")
    return pieces.repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(digest, ", ".join(f"{c} bigint" for c in _KEY) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(turns_of(conversations))
    ended = prefixes(turns)
    nodes = nodes_of(convs, ended)

    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("row").alias("up"), F.col("conv_id").alias("up_conv"))
    loose = nodes.where("depth > 1 AND above IS NULL").select("row", "depth", "q1", "q2")
    root = nodes.where("depth = 0").select("conv_id").first()  # one number
    below = nodes.where("depth = 1 AND above IS NULL").select(
        "row", F.lit(0).cast("bigint").alias("up"), F.lit(root and root["conv_id"]).cast("bigint").alias("up_conv"))
    tops = store(loose.join(parent, ["depth", "q1", "q2"]).select("row", "up", "up_conv").unionByName(below), "trie-tops")
    tops = running(tops.withColumnRenamed("row", "child"), ["up", "child"], "trie-siblings", "up", lags=["child"])
    held = tops.groupBy(F.col("up").alias("row")).agg(F.max("child").alias("last_top"), F.count(F.lit(1)).alias("n_tops"))
    goes_on = (F.col("len") > F.col("depth")).cast("bigint")
    tree = store(nodes.join(held, "row", "left").select(
        "row", "conv_id", *_KEY, "n_convs", "above", "last_top", goes_on.alias("chain"), (goes_on + F.coalesce("n_tops", F.lit(0))).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie-tree")

    enter, leave = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    arc = lambda a, b: F.struct(a.cast("bigint").alias("elem"), b.cast("bigint").alias("next"))
    after_chain = F.coalesce(enter("last_top"), leave("row"))
    tour = tree.select(F.explode(F.array_compact(F.array(
        arc(enter("row"), F.when(F.col("chain") == 1, enter("row") + 2).otherwise(after_chain)),
        F.when(F.col("chain") == 1, arc(leave("row") + 2, after_chain)), F.when(F.col("row") == 0, arc(leave("row"), F.lit(-1)))))).alias("a")).select("a.elem", "a.next")
    ranks = list_ranks(tour.unionByName(tops.select(arc(leave("child"), F.coalesce(enter("child_lag"), leave("up"))).alias("a")).select("a.elem", "a.next")), block)

    weighed = ranks.select(F.shiftright("elem", 1).alias("row"), (F.col("elem") % 2).alias("side"), "rank").join(
        tree.select("row", (F.col("n_children") == 0).cast("bigint").alias("leaf"), "saved"), "row")
    weighed = weighed.select("row", "side", "rank", *[F.when(F.col("side") == 0, F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in ("leaf", "saved")])
    summed = running(weighed.withColumnRenamed("row", "node"), ["rank"], "trie-tour", sums=["leaf", "saved"])
    # at the exit arc the sum up to it, less what stood before the enter arc
    part = lambda c: F.sum(F.when(F.col("side") == 1, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum")))
    subtrees = summed.groupBy(F.col("node").alias("row")).agg(part("leaf").alias("n_leaves"), part("saved").alias("saved_tokens"))

    named = tree.join(tops.select(F.col("child").alias("row"), "up_conv"), "row", "left").join(subtrees, "row")
    digests = end_digests(convs, ended, piece)
    parent_conv = F.when(F.col("above").isNotNull(), F.col("conv_id")).otherwise(F.col("up_conv"))
    return named.join(digests, list(_KEY), "left").select(
        "conv_id", "depth", parent_conv.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
