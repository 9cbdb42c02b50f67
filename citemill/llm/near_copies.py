"""Near copies: texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more, and chains of such pairs.

Words are those of ``simhash``. Every run of ``size`` words is hashed with XXH64 (seed 42); a text with fewer words is one run, a
text without words the empty set. Texts of one set are one node, whose id is the hash of its sorted run hashes.

Method. First the operator's: SimHash fingerprints of the same runs, tables of distances to reference fingerprints that discard pairs, survivors
verified. No pair is left to chance, as it would be with fingerprints at any radius: two sets of that similarity share
a run among their first ``n - ceil(0.8 n) + 1`` under any order of all runs, so what the fingerprints miss is found there. The order puts the
runs that most texts hold last. All runs are counted, by 32 bits of their hash; the counts decide the work, never the result.

1. *Fingerprints*: nodes of one fingerprint meet one of them, and the links of ``simhash.links`` join their groups.
2. *Stars*: nodes of one least run and about one size, under 8 mixings, meet a node of that group with the least share of rare runs (the
   unedited text, if there is one): a link for each at most, whatever the group's size. The links of both steps are verified by exact counts and
   give first components, so a group of thousands of near copies is mostly one.
3. *Pairs*: runs of prefixes whose holders lie in one component are left out; the others pair up nodes of different
   components, and pairs whose sizes and places in the prefixes cannot reach the similarity are discarded.

No stage holds a text: candidates are verified from a second scan. Stage tables are deleted when what was read from them is written.
A run in the table of counts that very many texts of different components hold in their prefixes, so texts of hardly any rare run, still
pairs them up (at the cost of its holders' number squared). Other runs have fewer than ``HOT`` holders while the table holds
all that have more; it is cut at ``OFTEN`` runs, the most frequent first, which bounds the driver.

Defined cases: runs count as equal when their 64-bit hashes are. Null and empty texts are copies of each other. Repeated rows and rows with a null
doc_id are copies like others. An empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import binary_rows, text_of
from citemill.llm.components import connected_components
from citemill.session import discard, store

SIZE, SIMILARITY, SEED, STARS = 5, Fraction(4, 5), 42, 8
#: Runs are put last from so many holders on; the most frequent so many of them, which bounds the driver's memory.
HOT, OFTEN = 16, 400_000
#: Runs are counted in so many parts (a power of two), and packed when a task holds so many.
PARTS, PACK = 1 << 12, 1 << 20
#: Bits of the map that thins the second scan (8 MB), and nodes on a side of what a task verifies at once.
BITS, TILE = 1 << 26, 256
_MIX = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) | 1 for i in range(STARS)], np.uint64)
_NODES = "doc_id bigint, text_hash bigint, node bigint"


def all_runs(text: bytes, size: int = SIZE) -> np.ndarray:
    """The hashes of the text's runs in their order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    edges = np.cumsum([0, *(len(w) + 1 for w in words)])
    starts, ends = edges[: max(1, len(words) - size + 1)].tolist(), (edges[size:] - 1).tolist() or [len(joined)]
    return np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def runs_of(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of the text's runs."""
    return np.unique(all_runs(text, size))


def node_of(runs: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(runs.astype("<u8").tobytes(), SEED)).view(np.int64))


def prefix_length(n: int, similarity: Fraction = SIMILARITY) -> int:
    return n - -(-n * similarity.numerator // similarity.denominator) + 1 if n else 0


def count_key(runs: np.ndarray) -> np.ndarray:
    """The 32 bits by which runs are counted."""
    return (runs >> np.uint64(32)).astype(np.uint32)


def ranks_of(runs: np.ndarray, often: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of each run in the table of counts, zero where it is not there."""
    if not len(often):
        return np.zeros(len(runs), np.int64)
    keys = count_key(runs)
    at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
    return np.where(often[at] == keys, ranks[at], 0)


def in_order(runs: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The runs, frequent ones last and by their ranks."""
    return runs[np.lexsort((runs, rank))] if rank.any() else runs


def stars_of(runs: np.ndarray) -> list[int]:
    """The least run under each mixing."""
    if not len(runs):
        return []
    return [int(v) for v in ((runs ^ (runs >> np.uint64(29)))[None, :] * _MIX[:, None]).min(axis=1).view(np.int64)]


def packed_runs(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(part, keys) of the 32-bit keys of each text's distinct runs: sorted arrays of very many texts, cut by their leading bits.

    A row for each key would meet a hash table of some 60 bytes a key in the executor's heap, where four bytes a key do.
    """
    edges = np.arange(PARTS + 1, dtype=np.uint64) << np.uint64(32 - PARTS.bit_length() + 1)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        offsets = np.searchsorted(keys, edges).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), PARTS, [None, pa.py_buffer(offsets * np.int32(4)), pa.py_buffer(keys)])
        some = np.flatnonzero(np.diff(offsets)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(some), cut.take(pa.array(some))], ["part", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, found in binary_rows(batches, "text"):
            for text in found:
                held.append(np.unique(count_key(all_runs(text, size))))
                n += len(held[-1])
                if n >= PACK:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return texts.select("text").mapInArrow(run, "part int, keys binary")


def frequent_runs(texts: DataFrame, size: int, hot: int = HOT, most: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) of the runs that ``hot`` or more texts hold, the keys ascending. A task holds the keys of one part at a time."""

    def counted(held: list[bytes]) -> pa.RecordBatch:
        keys, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n >= hot].view(np.int32)), pa.array(n[n >= hot].astype(np.int64))], ["run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield counted(held)
                    held = []
                now = part
                held.append(keys)
        if held:
            yield counted(held)

    counts = packed_runs(texts, size).repartition("part").sortWithinPartitions("part").mapInArrow(run, "run int, n bigint")
    rows = counts.orderBy(F.desc("n"), "run").limit(most).toArrow()
    keys, n = rows["run"].to_numpy().view(np.uint32), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def reaches(shared: Column, n_a: Column, n_b: Column, similarity: Fraction) -> Column:
    """Whether so many shared runs make the similarity: shared / (a + b - shared) >= p / q."""
    p, q = similarity.numerator, similarity.denominator
    return shared * (p + q) >= p * (n_a + n_b)


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))


def bitmap_of(wanted: DataFrame) -> np.ndarray:
    """``BITS`` bits, those set that a row of ``wanted(id, text_hash)`` hashes to: at most 2^20 words come to the driver, whatever the rows."""
    slot = F.pmod(F.xxhash64("id", "text_hash"), F.lit(BITS))
    words = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, text_hash), {BITS}) % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def candidate_sets(named: DataFrame, rows: DataFrame, texts: DataFrame, size: int, short: bool) -> DataFrame:
    """(node, runs) of the nodes ``named(node)``: texts are scanned anew, and the set of one text of each node leaves the scan, ``short`` as 32 bits a run.

    The scan drops what a bitmap of fixed size rules out; the exact join follows.
    """
    one = rows.select("node", F.struct(_key("doc_id").alias("id"), "text_hash").alias("at")).join(named, "node", "left_semi").groupBy("node").agg(F.min("at").alias("at"))
    wanted = store(one.select("node", F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash")), "candidate-texts")
    words = texts.sparkSession.sparkContext.broadcast(bitmap_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((words.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            found = [runs_of(t, size) for t in batch.column(3).to_pylist()]
            sets = [np.sort((r >> np.uint64(32)).astype(np.uint32).view(np.int32)) if short else r.view(np.int64) for r in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32() if short else pa.int64()))], ["id", "text_hash", "runs"])

    slot = F.pmod(F.xxhash64("id", "text_hash"), F.lit(BITS)).alias("slot")
    marked = texts.select(_key("doc_id").alias("id"), "text_hash", "text").select("id", "text_hash", slot, "text")
    sets = store(marked.mapInArrow(run, f"id bigint, text_hash bigint, runs array<{'int' if short else 'bigint'}>").join(wanted, ["id", "text_hash"]).select("node", "runs"), "candidate-sets")
    discard(wanted)
    return sets


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, size: int, similarity: Fraction, short: bool = True) -> DataFrame:
    """The pairs (a, b) of the similarity among ``pairs(a, b, key)``, by the whole sets of their texts.

    Pairs of one ``key`` (something both hold) are judged together, so a set travels once for each key and not for each pair. A key with
    more than ``TILE`` nodes is cut to tiles of two parts of them; a task streams the tiles and holds the sets of one.
    Sets travel as 32 bits a run first. That finds a run too many in common with a chance of n * m / 2^32 for sets of n and m runs; pairs within
    2 + n * m / 2^26 runs of the limit are judged again by 64 bits (more chance matches than that: below 1e-11).
    """
    members = store(pairs.select("key", F.explode(F.array("a", "b")).alias("node")).distinct(), "key-members")
    named = store(members.select("node").distinct(), "candidate-nodes")
    sets = candidate_sets(named, rows, texts, size, short)
    cuts = store(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("cuts")), "pair-keys")
    part = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    tiled = store(pairs.join(cuts, "key").select("key", F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"), "a", "b"), "pair-tiles")
    held = tiled.select("key", "i", "j", F.explode(F.array("a", "b")).alias("a")).distinct().join(sets.withColumnRenamed("node", "a"), "a")
    nothing = F.lit(None)
    both = held.select("key", "i", "j", F.lit(0).alias("kind"), "a", nothing.cast("bigint").alias("b"), "runs").unionByName(
        tiled.select("key", "i", "j", F.lit(1).alias("kind"), "a", "b", nothing.cast(sets.schema["runs"].dataType).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = similarity.numerator, similarity.denominator
        now, own = None, {}
        for batch in batches:
            *tile, kind, a, b, runs = batch.columns
            out = []
            for n, (at, k, x, y) in enumerate(zip(zip(*[c.to_pylist() for c in tile], strict=True), kind.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)):
                if at != now:
                    now, own = at, {}
                if k == 0:
                    own[x] = runs[n].values.to_numpy()
                    continue
                one, two = own[x], own[y]
                both = np.sort(np.concatenate([one, two]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                over = shared * (p + q) - p * (len(one) + len(two))
                sure = not short or abs(over) > (2 + (len(one) * len(two) >> 26)) * (p + q)
                if over >= 0 or not sure:
                    out.append((x, y, at[0], sure))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["a", "b", "key", "sure"])

    links = store(both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind").mapInArrow(
        run, "a bigint, b bigint, key bigint, sure boolean").distinct(), "verified-links")
    discard(members, named, sets, cuts, tiled)
    if not short:
        return links
    close = store(links.where("NOT sure").select("a", "b", "key"), "close-pairs")
    again = close if close.isEmpty() else verified(close, rows, texts, size, similarity, short=False)
    found = store(links.where("sure").select("a", "b").unionByName(again.select("a", "b")), "verified-links")
    discard(links, close)
    return found


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, key, n_a, n_b) of nodes whose fingerprints are equal or linked by the operator: they span its components."""
    from citemill.llm.simhash import links  # which builds on this module

    own = store(rows.groupBy("fingerprint").agg(F.min(F.struct("rare", "node", "n")).alias("f"), F.max("node").alias("most"), F.min("node").alias("least")), "fingerprint-nodes")
    one = F.col("f.node").alias("a"), F.col("node").alias("b"), F.col("fingerprint").alias("key"), F.col("f.n").alias("n_a"), F.col("n").alias("n_b")
    equal = rows.select("fingerprint", "node", "n").join(own.where("most <> least"), "fingerprint").where("node <> f.node").select(*one)
    side = lambda c: own.select(F.col("fingerprint").alias(f"p_{c}"), F.col("f.node").alias(c), F.col("f.n").alias(f"n_{c}"))
    linked = links(own.select("fingerprint")).select(F.col("a").alias("p_a"), F.col("b").alias("p_b")).distinct()
    found = store(equal.unionByName(linked.join(side("a"), "p_a").join(side("b"), "p_b").select("a", "b", F.col("p_a").alias("key"), "n_a", "n_b")), "fingerprint-pairs")
    discard(own)
    return found


def star_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, key, n_a, n_b) of each node and the most typical one of its group, for every mixing.

    A group holds sizes within a quarter; its bounds shift with the mixing.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + F.col("mix") / STARS).alias("band")
    stars = rows.select("node", "n", "rare", F.posexplode("stars").alias("mix", "least")).select("node", "n", "rare", "mix", band, "least")
    first = stars.groupBy("mix", "band", "least").agg(
        F.min(F.struct("rare", F.xxhash64("mix", "node").alias("turn"), "node", "n")).alias("f"), F.max("node").alias("high"), F.min("node").alias("low"))
    least = store(first.where("low <> high").select("mix", "band", "least", "f"), "stars")
    found = store(stars.join(least, ["mix", "band", "least"]).where("node <> f.node").select(
        F.col("f.node").alias("a"), F.col("node").alias("b"), F.col("least").alias("key"), F.col("f.n").alias("n_a"), F.col("n").alias("n_b")), "star-rows")
    discard(least)
    return found


def classes(documents: DataFrame, size: int = SIZE, similarity: Fraction = SIMILARITY, sample: int = OFTEN) -> DataFrame:
    """(doc_id, text_hash, root) of each row; ``root`` is one node of the component. ``sample`` bounds the frequent runs that are put last."""
    from citemill.llm.simhash import print_of  # which builds on this module

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))
    often, ranks = frequent_runs(texts, size, most=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in binary_rows(batches, "text"):
            whole = [all_runs(t, size) for t in found]
            sets = [np.unique(w) for w in whole]
            rank = [ranks_of(s, often, ranks) for s in sets]
            lists = lambda of: pa.array([of(s, r) for s, r in zip(sets, rank, strict=True)], pa.list_(pa.int64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([float((r == 0).mean()) if len(r) else 0.0 for r in rank], pa.float64()),
                 pa.array(np.array([print_of(w) for w in whole], np.uint64).view(np.int64), pa.int64()),
                 lists(lambda s, r: in_order(s, r)[: prefix_length(len(s), similarity)].view(np.int64)), lists(lambda s, _: stars_of(s))],
                ["doc_id", "text_hash", "node", "n", "rare", "fingerprint", "prefix", "stars"])

    rows = store(texts.mapInArrow(run, f"{_NODES}, n int, rare double, fingerprint bigint, prefix array<bigint>, stars array<bigint>"), "run-prefixes")
    close = lambda a, b: F.least(a, b) * similarity.denominator >= F.greatest(a, b) * similarity.numerator

    prints, stars = fingerprint_pairs(rows), star_pairs(rows)
    either = prints.unionByName(stars).where(close(F.col("n_a"), F.col("n_b")))
    pairs = store(either.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("key").alias("key")), "first-pairs")
    discard(prints, stars)
    first_links = verified(pairs, rows, texts, size, similarity)
    known = connected_components(first_links)
    discard(pairs)

    # runs of prefixes that different components hold: a partial aggregate, so a run of very many texts is a few rows a task
    held = rows.select("node", "n", "prefix").join(known, "node", "left").select(
        "node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("prefix").alias("at", "run"))
    mixed = store(held.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("run"), "open-runs")
    open_ = store(held.join(mixed, "run").dropDuplicates(["run", "node"]), "open-prefixes")
    side = lambda c: open_.select("run", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "root", "at")])
    both = side("a").join(side("b"), "run").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & close(F.col("n_a"), F.col("n_b"))
        # the first run that two sets share leaves room for all they must share; later shared runs that do not are not needed
        & reaches(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")), F.col("n_a"), F.col("n_b"), similarity))
    counted = both.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(
        F.count(F.lit(1)).alias("shared"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), F.min("run").alias("key"))
    most = F.col("shared") + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    pairs = store(counted.where(reaches(most, F.col("n_a"), F.col("n_b"), similarity)).select("a", "b", "key"), "prefix-pairs")
    discard(known, mixed, open_)
    more_links = verified(pairs, rows, texts, size, similarity)
    roots = connected_components(first_links.unionByName(more_links)).withColumnRenamed("root", "top")
    found = store(rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("top", "node").alias("root")), "near-copy-classes")
    discard(rows, pairs, first_links, more_links)
    return found
