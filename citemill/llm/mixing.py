"""Mixing sources to target weights by hierarchical budgets.

The tree is domain > language > source; weights are positive whole numbers, 1 where none is given. A
leaf holds its documents' tokens (words ``[^\\x20\\x09-\\x0D]+``) ``max_epochs`` times at most. The
target is ``percent`` of all tokens.

*Budgets*. A node's budget is shared among its children by weight, none above what its subtree holds. What a child
cannot take goes to its siblings by weight; only a node whose whole subtree is used up leaves a shortage to
its own siblings. Whole tokens left by rounding go to the first children by label, one each. A level is one set of windows
over the node table, which has a row for each leaf, not for each document.

*Selection*. A leaf reads its documents in seeded order, a new one in each epoch, and takes the prefix of that stream
which its budget fills: whole epochs first, then documents of the last epoch up to the one that crosses the budget
(``take`` says how many of its tokens are inside). The cut is found from sums of tokens by (leaf, ``key`` prefix), partial
sums first, and an exact window only inside the one of 4096 key ranges where the budget ends. So no
step sorts a leaf, and a leaf on a third of all rows is spread over all tasks.

Defined cases: null lang or source is the empty label; a null doc_id is ordered by its text. Rows that share a doc_id are separate
documents; equal rows are all in or out at the cut together with the first of them. Null and empty texts have no tokens; they come along in whole
epochs, and before the cut. A leaf without tokens gets no budget. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill.llm.common import local_table, text_of
from citemill.session import store

LEAF = ["domain", "lang", "source"]
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights by label, and the domain of each source (``other`` where it is not listed)."""

    domain_of: dict[str, str] = field(default_factory=dict)
    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    percent: int = 60
    max_epochs: int = 3
    seed: int = 7
    other: str = "web"


PRODUCTION = Mix(
    domain_of={"src1": "books", "src2": "books", "src3": "books", "src4": "code", "src5": "code"}, domains={"web": 5, "books": 3, "code": 2},
    languages={"en": 6, "de": 2, "fr": 2, "es": 1}, sources={"src0": 2, "src3": 3})


def _labelled(documents: DataFrame, mix: Mix) -> DataFrame:
    """Each row as ``row``, with its leaf, tokens and tie key."""
    spark = documents.sparkSession
    named = local_table(spark, {"of": ("string", list(mix.domain_of)), "in_domain": ("string", list(mix.domain_of.values()))})
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), label("lang").alias("lang"), label("source").alias("source"),
        F.col("doc_id").cast("bigint").alias("id"), F.regexp_count(text_of(), F.lit(WORDS)).cast("long").alias("tokens"), F.xxhash64(text_of()).alias("tie"))
    return rows.join(named, rows["source"] == named["of"], "left").withColumn("domain", F.coalesce("in_domain", F.lit(mix.other))).drop("of", "in_domain")


def _share(nodes: DataFrame, parent: list[str], label: str) -> DataFrame:
    """``budget`` of each node (parent, label, weight, capacity) from ``given``, the budget of its parent."""
    by_ratio = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), label)
    n = nodes.withColumn("full_before", F.coalesce(F.sum("capacity").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    n = n.withColumn("full", (wide("given") - wide("full_before")) * F.col("weight") >= wide("capacity") * F.col("weight_left"))
    whole = W.partitionBy(*parent)
    n = n.withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)).withColumn(
        "open_weight", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(whole))
    n = n.withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(
        F.floor(wide("left") * F.col("weight") / F.greatest("open_weight", F.lit(1))).cast("long")))
    over = F.col("left") - F.sum(F.when(~F.col("full"), F.col("part")).otherwise(0)).over(whole)
    first = F.row_number().over(W.partitionBy(*parent, "full").orderBy(label))
    n = n.withColumn("over", over).withColumn("nth", first)
    budget = F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("over")), 1).otherwise(0)
    return n.select(*nodes.columns, budget.cast("long").alias("budget"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(leaf, available, budget) from leaves (domain, lang, source, available)."""
    spark = leaves.sparkSession
    table = lambda w: local_table(spark, {"label": ("string", list(w)), "given_weight": ("bigint", list(w.values()))})

    def weighed(nodes: DataFrame, label: str, weights: dict[str, int]) -> DataFrame:
        t = table(weights)
        return nodes.join(t, nodes[label] == t["label"], "left").withColumn("weight", F.coalesce("given_weight", F.lit(1))).drop("label", "given_weight")

    level = leaves.withColumn("capacity", F.col("available") * mix.max_epochs)
    grouped = lambda cols: level.groupBy(*cols).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
    top = W.partitionBy(F.lit(1))  # one row a domain
    domains = weighed(grouped(["domain"]), "domain", mix.domains).withColumn(
        "given", F.least(F.floor(F.sum(F.col("available")).over(top) * mix.percent / 100).cast("long"), F.sum("capacity").over(top)))
    given = _share(domains.withColumn("root", F.lit(0)), ["root"], "domain").select("domain", F.col("budget").alias("given"))
    langs = weighed(grouped(["domain", "lang"]), "lang", mix.languages).join(given, "domain")
    given = _share(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    sources = weighed(level, "source", mix.sources).join(given, ["domain", "lang"])
    return _share(sources, ["domain", "lang"], "source").select(*LEAF, "available", "budget")


def _key(mix: Mix, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """Place of a document in its leaf's order of an epoch."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), tie.cast("string")))
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), name)), 1, 16)


def plan(documents: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """One row a leaf: available, budget, whole epochs, and the cut (key, id, tie, take) in the epoch after these."""
    docs = store(_labelled(documents.select("doc_id", "text", "lang", "source"), mix).select(*LEAF, "id", "tie", "tokens"), "mix-tokens")
    leaves = store(docs.groupBy(*LEAF).agg(F.sum("tokens").alias("available")), "mix-leaves")
    whole = F.when(F.col("available") > 0, F.expr("budget DIV available")).otherwise(0)
    shares = store(budgets(leaves, mix).withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("available")), "mix-shares")
    keyed = docs.join(shares.where("rest > 0").select(*LEAF, "whole", "rest"), LEAF).withColumn("key", _key(mix, F.col("whole"), F.col("id"), F.col("tie")))
    ranges = keyed.groupBy(*LEAF, "rest", F.substring("key", 1, 3).alias("range")).agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    end = store(ranges.withColumn("before", before).where("before < rest AND rest <= before + n").select(*LEAF, "range", "before"), "mix-ranges")
    inside = keyed.withColumn("range", F.substring("key", 1, 3)).join(end, [*LEAF, "range"])
    order = W.partitionBy(*LEAF).orderBy("key", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    cut = inside.withColumn("start", start).where("start < rest AND rest <= start + tokens").select(
        *LEAF, F.struct("key", "id", "tie").alias("cut"), (F.col("rest") - F.col("start")).alias("take"))
    return store(shares.join(cut, LEAF, "left"), "mix-plan")


def mix(documents: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The documents' rows that the plan takes, once for each epoch, with ``mix_domain``, ``mix_epoch``, ``mix_tokens`` and ``mix_take``.

    A column of the documents with one of these names is replaced. The text never moves: rows meet the plan, which has one row a leaf.
    """
    chosen = _labelled(documents, mix).join(plan(documents, mix).select(*LEAF, "whole", "cut", "take"), LEAF)
    here = F.struct(_key(mix, F.col("whole"), F.col("id"), F.col("tie")).alias("key"), "id", "tie")
    in_last = F.coalesce(F.col("cut").isNotNull() & (here <= F.col("cut")), F.lit(False))
    rounds = F.col("whole") + F.when(in_last, 1).otherwise(0)
    epochs = chosen.withColumn("at_cut", F.coalesce(here == F.col("cut"), F.lit(False))).withColumn("rounds", rounds).where("rounds > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
    own = ("mix_domain", "mix_epoch", "mix_tokens", "mix_take")
    take = F.when((F.col("epoch") == F.col("whole")) & F.col("at_cut"), F.col("take")).otherwise(F.col("tokens"))
    return epochs.select(
        *[F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in own], F.col("domain").alias("mix_domain"), F.col("epoch").alias("mix_epoch"),
        F.col("tokens").alias("mix_tokens"), take.alias("mix_take"))
