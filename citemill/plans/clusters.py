"""Article features and exploratory K-Means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citemill import fixed
from citemill.functions.labels import category_or_label, first_filled, lookup, relation_weight
from citemill.operators.groups import top_rows
from citemill.session import store


def article_features(articles: DataFrame, summaries: DataFrame, relations: DataFrame) -> DataFrame:
    """Long table article_id, feature, value; absent features count as zero."""
    label = first_filled(F.trim("label_es"), F.trim("label_en"), F.trim("entity_id"))
    strength = lookup(F.col("role"), fixed.ROLE_WEIGHTS, F.lit(1.0)) * F.log1p(F.coalesce("n_mentions", F.lit(0)))
    slot = F.col("entity_type")

    def feature(name: Column, value: Column) -> Column:
        return F.struct(name.alias("feature"), value.cast("double").alias("value"))

    def named(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix + "::"), F.coalesce(value, F.lit("")))

    from_summaries = summaries.select("article_id", F.explode(F.array(
        feature(F.concat(slot, F.lit("_category::"), category_or_label(F.col("category"), label)), strength),
        feature(F.concat(slot, F.lit("_label::"), label), strength * 0.65),
        feature(F.concat(slot, F.lit("_confidence::"), F.coalesce("confidence", F.lit(""))), F.lit(1.0)),
    )).alias("f"))
    a = category_or_label(F.col("entity_a_category"), F.col("entity_a_label"))
    b = category_or_label(F.col("entity_b_category"), F.col("entity_b_label"))
    arrow = F.lit(" → ")
    weight = F.col("weight")
    from_relations = (
        relations.withColumn("weight", relation_weight(F.col("association"), F.col("confidence")))
        .where(weight > 0)
        .select("article_id", F.explode(F.array(
            feature(named("relation_association", F.col("association")), weight),
            feature(named("relation_confidence", F.col("confidence")), weight),
            feature(named("relation_section", F.col("section")), weight),
            feature(named("relation_pair", F.concat("entity_a_label", arrow, "entity_b_label")), weight * 0.5),
            feature(named("relation_category_pair", F.concat(a, arrow, b)), weight),
        )).alias("f"))
    )
    from_articles = articles.select(
        "article_id", feature(named("article_kind", F.col("article_kind")), F.lit(2.0)).alias("f")
    )
    rows = from_summaries.unionByName(from_relations).unionByName(from_articles)
    return rows.groupBy("article_id", F.col("f.feature").alias("feature")).agg(F.sum("f.value").alias("value"))


def log_features(features: DataFrame) -> DataFrame:
    return features.withColumn("value", F.log1p("value"))


def select_features(features: DataFrame) -> DataFrame:
    """Compact features only; all of them when none has a known prefix."""
    prefix = F.regexp_extract("feature", r"^[^:]*::", 0).isin(*fixed.CLUSTER_FEATURE_PREFIXES)
    usable = features.agg(F.coalesce(F.bool_or(prefix), F.lit(False)).alias("any")).scalar()
    return features.where(prefix | ~usable)


def feature_stats(features: DataFrame, articles: DataFrame) -> DataFrame:
    """Mean and population deviation per feature over *all* articles, constant ones dropped."""
    n = articles.agg(F.count("*").alias("n")).scalar()
    # deviations around the mean: stored values plus the implicit zeros
    sums = features.groupBy("feature").agg(
        F.sum("value").alias("total"), F.count("*").alias("filled"),
        F.var_pop("value").alias("spread"), F.avg("value").alias("filled_mean"),
    )
    mean = F.col("total") / n
    share = F.col("filled") / n
    variance = share * F.col("spread") + share * (1 - share) * F.col("filled_mean") * F.col("filled_mean")
    stats = sums.select("feature", mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("deviation"))
    return stats.where(F.col("deviation") > 1e-12)


def standardised(features: DataFrame, articles: DataFrame) -> DataFrame:
    """z-scores of the stored values; an absent value stands for ``-mean / deviation``.

    The statistics have one row per feature; adaptive execution broadcasts them when they are
    small and splits a common feature otherwise.
    """
    return features.join(feature_stats(features, articles), "feature").select(
        "article_id", "feature", ((F.col("value") - F.col("mean")) / F.col("deviation")).alias("z")
    )


def dense_vectors(features: DataFrame, articles: DataFrame) -> tuple[DataFrame, list[str]]:
    """``article_id, x array<double>`` of z-scores, and the feature order.

    The feature list is bounded by the dictionary and the fixed vocabularies, so it is
    the one thing read by the driver; vectors stay distributed.
    """
    stats = feature_stats(features, articles).orderBy("feature").collect()
    names = [r["feature"] for r in stats]
    if not names:
        return articles.select("article_id", F.array(F.lit(0.0)).alias("x")), names
    values = features.where(F.col("feature").isin(names)).groupBy("article_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")
    )
    x = F.array(*[
        (F.coalesce(F.element_at("m", F.lit(r["feature"])), F.lit(0.0)) - F.lit(r["mean"])) / F.lit(r["deviation"])
        for r in stats
    ])
    return articles.select("article_id").join(values, "article_id", "left").select("article_id", x.alias("x")), names


def natural_order() -> list[Column]:
    """Letters then number for ids like ``A12``; other ids by text."""
    number = F.regexp_extract("article_id", r"^([A-Za-z]+)(\d+)$", 2)
    prefix = F.regexp_extract("article_id", r"^([A-Za-z]+)(\d+)$", 1)
    return [
        F.when(prefix != "", prefix).otherwise(F.col("article_id")),
        F.length(F.ltrim(number, F.lit("0"))), F.ltrim(number, F.lit("0")),  # numbers of any size
        "article_id",
    ]


def squared_distance(x: Column, center: list[float]) -> Column:
    terms = F.zip_with(x, F.array(*[F.lit(float(c)) for c in center]), lambda p, q: (p - q) * (p - q))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


#: Means that agree to this many digits are a tie, which names decide.
TIE_DIGITS = 9


@dataclass
class Clusters:
    assigned: DataFrame          # article_id, cluster, distance_to_centroid
    centers: list[list[float]]
    inertia: float
    features: list[str]
    converged: bool = True       # False when the round limit ended the loop


def kmeans(points: DataFrame, features: list[str], k: int, seed: int = fixed.SEED, rounds: int = 100) -> Clusters:
    """Seeded first centre, farthest-first start, then Lloyd rounds until nothing changes.

    The first centre is the row whose id has the least hash with the seed, so no order of all rows is needed.
    ``rounds`` is the reference limit; ``converged`` tells whether it was reached. Rows are then assigned to the last centres.

    Each round is one narrow assignment and one aggregate of k rows per task; the driver
    holds the k centres only. Points are a stored table, so lineage does not grow.
    """
    points = store(points, "points")
    n = points.count()
    if n == 0:
        return Clusters(points.selectExpr("article_id", "0 cluster", "0D distance_to_centroid"), [], 0.0, features)
    k = max(1, min(k, n))
    centers = [points.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "article_id")), "article_id").head()["x"]]
    while len(centers) < k:
        nearest = F.least(*[squared_distance(F.col("x"), c) for c in centers], F.lit(float("inf")))
        far = points.select("article_id", "x", nearest.alias("d")).orderBy(F.col("d").desc(), *natural_order())
        centers.append(far.head()["x"])

    def assign(current: list[list[float]]) -> DataFrame:
        distances = F.array(*[squared_distance(F.col("x"), c) for c in current])
        return points.withColumn("d", distances).withColumn("best", F.array_min("d")).withColumn(
            "cluster", (F.array_position("d", F.col("best")) - 1).cast("int")
        )

    width = len(centers[0])
    labels, converged = None, False
    for _ in range(rounds):
        now = assign(centers)
        sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]
        # the label histogram and the inertia identify an unchanged assignment together
        rows = now.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.xxhash64("article_id", "cluster").cast("decimal(38,0)")).alias("h"), *sums).collect()
        signature = sorted((r["cluster"], r["n"], int(r["h"])) for r in rows)
        if signature == labels:
            converged = True
            break
        labels = signature
        for r in rows:
            centers[r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(width)]
    final = assign(centers).select("article_id", "cluster", F.sqrt("best").alias("distance_to_centroid"), "best")
    final = store(final, "assigned")
    inertia = final.agg(F.sum("best")).head()[0]
    return Clusters(final.drop("best"), centers, float(inertia), features, converged)


def cluster_articles(clusters: DataFrame, articles: DataFrame, relations: DataFrame) -> DataFrame:
    """Assignment with article fields and the relation weight of each article."""
    weights = relations.groupBy("article_id").agg(
        F.sum(relation_weight(F.col("association"), F.col("confidence"))).alias("n_relations_weighted")
    )
    meta = articles.select("article_id", "title", "year", "doi", "article_kind", "text_extractable")
    return meta.join(clusters, "article_id").join(weights, "article_id", "left").withColumn(
        "n_relations_weighted", F.coalesce("n_relations_weighted", F.lit(0.0))
    )


def cluster_profiles(features: DataFrame, clusters: DataFrame, top: int = 8) -> DataFrame:
    """Size and strongest features (mean over all members, zeros included) per cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n_articles"))
    sums = features.join(clusters.select("article_id", "cluster"), "article_id").groupBy("cluster", "feature").agg(
        F.sum("value").alias("total")
    )
    means = sums.join(sizes, "cluster").withColumn("mean", F.round(F.col("total") / F.col("n_articles"), TIE_DIGITS)).where("mean > 0")
    best = top_rows(means, ["cluster"], [F.col("mean").desc(), "feature"], top)
    text = F.concat("feature", F.lit("="), F.format_string("%.2f", "mean"))
    listed = best.groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]), " | ").alias("top_features")
    )
    return sizes.join(listed, "cluster", "left").select(
        "cluster", "n_articles", F.coalesce("top_features", F.lit("")).alias("top_features")
    )


def centroid_table(clusters: Clusters, top: int = 20) -> DataFrame:
    """Strongest features per non-empty cluster in z units: feature_i / zscore_i columns."""
    spark = clusters.assigned.sparkSession
    # k x features numbers the driver already holds
    cells = [(c, f, round(float(v), TIE_DIGITS)) for c, row in enumerate(clusters.centers) for f, v in zip(clusters.features, row)]
    table = spark.createDataFrame(cells, "cluster int, feature string, z double")
    sizes = clusters.assigned.groupBy("cluster").agg(F.count("*").alias("n_articles"))
    best = top_rows(table, ["cluster"], [F.col("z").desc(), "feature"], top).join(sizes, "cluster")
    shown = min(top, len(clusters.features))
    return best.groupBy("cluster", "n_articles").agg(*[
        e for i in range(1, shown + 1) for e in (
            F.max(F.when(F.col("rank") == i, F.col("feature"))).alias(f"feature_{i}"),
            F.max(F.when(F.col("rank") == i, F.col("z"))).alias(f"zscore_{i}"),
        )
    ])


def run_clusters(articles: DataFrame, summaries: DataFrame, relations: DataFrame, k: int) -> tuple[Clusters, DataFrame]:
    """Features to clusters; also returns the selected log features."""
    features = store(select_features(log_features(article_features(articles, summaries, relations))), "features")
    points, names = dense_vectors(features, articles)
    return kmeans(points, names, k), features
