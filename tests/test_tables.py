import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill import fixed
from citemill.operators.groups import exact_median, first_ids
from citemill.operators.lexicon import check_samples
from citemill.operators.sampling import sample_coverage, stratified_sample
from citemill.plans import clusters as cl
from citemill.plans import context as ctx
from citemill.plans import figures as fg
from citemill.plans import publication as pb
from citemill.plans import review as rv
from citemill.plans import survey as sv
from citemill.plans import validation as va
from citemill.session import checkpoint_dir, store
from tests import brute


# --- bounded group helpers ------------------------------------------------------------


def test_exact_median_with_one_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([-3.5, 0.0, rng.uniform(-1e6, 1e6), 1e-9])) for _ in range(3001)]
    rows += [(f"k{i % 40}", rng.uniform(-5, 5)) for i in range(1003)]
    got = {r["k"]: r["median"] for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == pytest.approx(float(np.median([v for n, v in rows if n == k])), abs=1e-12)


def test_median_of_one_hot_range_ranks_a_small_part(spark):
    """Distinct values inside one coarse bin; the last window sees about a thousandth of them."""
    rng = random.Random(6)
    values = [1.0 + rng.random() * 0.05 for _ in range(20001)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    assert exact_median(df, ["k"], "v").head()["median"] == float(np.median(values))
    same = spark.createDataFrame([("k", 2.5)] * 10 + [("j", -1.0), ("j", -1.0 - 1e-15)], "k string, v double")
    assert {r["k"]: r["median"] for r in exact_median(same, ["k"], "v").collect()} == {"k": 2.5, "j": float(np.median([-1.0, -1.0 - 1e-15]))}


def test_first_ids_are_distinct_and_sorted(spark):
    df = spark.createDataFrame([("k", str(i % 50)) for i in range(500)], "k string, id string")
    assert first_ids(df, ["k"], "id", 3, "ids").head()["ids"] == "0; 1; 10"


@pytest.mark.parametrize("sizes, n", [([50, 3, 1, 20], 30), ([5, 5, 5], 2), ([1, 1, 100], 50), ([4, 4], 100), ([7, 9, 2, 2, 2], 11)])
def test_stratified_sample_fills_strata_evenly(spark, sizes, n):
    rows = [(f"s{i}", j) for i, size in enumerate(sizes) for j in range(size)]
    df = spark.createDataFrame(rows, "s string, j int")
    got = stratified_sample(df, ["s"], ["s", "j"], n)
    counts = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
    assert [counts.get(f"s{i}", 0) for i in range(len(sizes))] == brute.quotas(sizes, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stratified_sample(df.repartition(3), ["s"], ["s", "j"], n).collect()))
    assert sample_coverage(got, ["s"], "x").head()["x_strata"] == len(counts)


def test_other_seeds_draw_other_rows(spark):
    df = spark.range(1000).withColumn("s", F.lit("x"))
    draws = [{r["id"] for r in stratified_sample(df, ["s"], ["id"], 50, seed).collect()} for seed in (13, 14)]
    assert draws[0] != draws[1] and draws[0] != set(range(50))


# --- clustering -------------------------------------------------------------------------


def distances(x, centers):
    return np.stack([np.square(x - np.asarray(c)).sum(axis=1) for c in centers], axis=1)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_kmeans_ends_at_a_fixed_point(spark, k):
    """Start: far rows. End: rows at their nearest centre, centres at the mean of their rows."""
    rng = np.random.default_rng(k)
    x = rng.normal(size=(60, 4)) + rng.integers(0, 4, size=(60, 1)) * 5
    points = spark.createDataFrame([(f"A{i}", [float(v) for v in row]) for i, row in enumerate(x)], "article_id string, x array<double>").repartition(5)
    start = cl.kmeans(points, ["f1", "f2", "f3", "f4"], k, rounds=0)
    assert not start.converged and np.isclose(distances(x, start.centers).min(axis=0), 0).all()
    for i in range(1, k):
        gap = distances(x, start.centers[:i]).min(axis=1)
        assert np.isclose(np.square(np.array(start.centers[:i]) - start.centers[i]).sum(axis=1).min(), gap.max())
    got = cl.kmeans(points.repartition(3), ["f1", "f2", "f3", "f4"], k)
    found = {r["article_id"]: (r["cluster"], r["distance_to_centroid"]) for r in got.assigned.collect()}
    labels = np.array([found[f"A{i}"][0] for i in range(60)])
    d = distances(x, got.centers)
    assert got.converged and (d.argmin(axis=1) == labels).all()
    assert all(np.allclose(x[labels == c].mean(axis=0), got.centers[c]) for c in set(labels.tolist()))
    assert got.inertia == pytest.approx(d.min(axis=1).sum()) == pytest.approx(sum(v * v for _, v in found.values()))
    assert np.allclose(cl.kmeans(points, ["f1", "f2", "f3", "f4"], k).centers, got.centers)
    table = cl.centroid_table(got).collect()
    assert len(table) == k and table[0]["zscore_1"] >= table[0]["zscore_4"]


def test_feature_stats_count_implicit_zeros(spark):
    features = spark.createDataFrame([("a", "f", 2.0), ("b", "f", 4.0), ("a", "const", 1.0), ("b", "const", 1.0), ("c", "const", 1.0), ("d", "const", 1.0)],
                                     "article_id string, feature string, value double")
    articles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "article_id string")
    got = cl.feature_stats(features, articles).collect()
    assert [(r["feature"], r["mean"]) for r in got] == [("f", 1.5)]
    assert got[0]["deviation"] == pytest.approx(np.std([2, 4, 0, 0]))
    points, names = cl.dense_vectors(features, articles)
    assert names == ["f"] and sum(r["x"][0] for r in points.collect()) == pytest.approx(0)


# --- whole review on a small corpus --------------------------------------------------------


TEXTS = [
    ("A1", "Cohort of zinc users\n\nAbstract\nZinc was significantly linked to epilepsy in patients.\n\nMethods\nPatients were exposed to 5 ppm zinc. A stroke was rare.\n" + "word " * 60),
    ("A2", "Mercury only here\n\nResults\nMercury might rise.\n" + "word " * 60),
    ("A10", "Stroke only here\n\nResults\nStroke was common.\n" + "word " * 60),
    ("B1", "short zinc"),
    ("C1", "Nothing to be found in this longer text\n" + "word " * 60),
]


@pytest.fixture(scope="module")
def small(spark, protocol):
    raw = spark.createDataFrame(TEXTS, "article_id string, text string").select(
        "article_id", F.lit("f").alias("source_path"), "text", F.lit(1).alias("pages"), F.lit("").alias("embedded_title"),
        F.create_map().cast("map<string,string>").alias("metadata"))
    return rv.run_review(raw, protocol)


def test_review_table_keeps_a_without_b_and_marks_unrelated_pairs(small, protocol):
    table = rv.review_table(small.summaries, small.relations, small.articles, protocol)
    assert table.columns == rv.review_columns(protocol)
    rows = {(r[0], r[4], r[8]): r for r in table.collect()}
    assert rows[("A2", "mercurio", "no detectado")][14] == "no detectado"
    assert rows[("A1", "cinc", "epilepsia")][14] == "asociacion_fuerte"
    assert set(rows) == {("A2", "mercurio", "no detectado"), ("A1", "cinc", "epilepsia"), ("A1", "cinc", "ictus")}


def test_headers_of_equal_display_names_stay_apart(protocol):
    from dataclasses import replace

    names = rv.review_columns(replace(protocol, name_a="X", name_b="X"))
    assert len(set(names)) == len(names) == 17


def test_matrices_are_dense_over_extractable_articles(small):
    m = pb.term_matrix(small.mentions, small.articles, "b", "n")
    assert m.columns[-2:] == ["b::epilepsia::epilepsy", "b::ictus::stroke"]
    assert {r[0]: (r[-2], r[-1]) for r in m.collect()} == {"A1": (1, 1), "A2": (0, 0), "A10": (0, 2), "C1": (0, 0)}


def test_totals_and_warnings(spark, small, protocol, make_articles):
    got = pb.corpus_totals(small.articles, small.mentions, small.summaries, small.relations).head()
    assert (got["n_articles"], got["n_extractable_articles"], got["warning"]) == (5, 4, "")
    none = small.mentions.where("false")
    got = pb.corpus_totals(small.articles, none, small.summaries.where("false"), small.relations.where("false")).head()
    assert "no pattern" in got["warning"]


def test_tables_of_an_empty_result_keep_their_columns(small, protocol):
    m, s, r = small.mentions.where("false"), small.summaries.where("false"), small.relations.where("false")
    for df in (rv.mention_rows(m), rv.summary_rows(s), rv.relation_rows(r, small.articles), rv.review_table(s, r, small.articles, protocol),
               pb.kwic(m, small.articles), pb.entity_frequency(m, small.articles), pb.cooccurrence(m, r, small.articles), pb.weight_sensitivity(s, protocol),
               pb.role_template(s, small.articles, 5), pb.relation_template(r, small.articles, 5), fg.pair_table(r, True), fg.pair_table(r, False)):
        assert df.columns and df.count() == 0
    assert pb.term_matrix(m, small.articles, "a", "tfidf").count() == 4


def test_pair_weights_multiply_association_and_confidence(small):
    got = fg.pair_table(small.relations, True).collect()
    weights = {(r["entity_a_label"], r["entity_b_label"]): r["weighted_score"] for r in got}
    assert weights[("cinc", "epilepsia")] == 9.0


def test_clusters_of_the_small_corpus(small):
    found, features = cl.run_clusters(small.articles, small.summaries, small.relations, 2)
    table = cl.cluster_articles(found.assigned, small.articles, small.relations)
    assert table.count() == 5 and {r["cluster"] for r in table.collect()} == {0, 1}
    assert sum(r["n_articles"] for r in cl.cluster_profiles(features, found.assigned).collect()) == 5
    assert fg.cluster_map_labels(table).count() == 5


# --- single-variable classifier ----------------------------------------------------------------


def context_group(spark, items, kind="no_determinado"):
    rows = [("x", "f", "t", kind, i, "zinc", "Metals", s, 1, f"c{i}", "e" in cues, "d" in cues, "b" in cues,
             fixed.CONTEXT_SECTION_WEIGHTS[s] + 4 * ("e" in cues) + 5 * ("d" in cues) - ("b" in cues)) for i, (s, cues) in enumerate(items)]
    df = spark.createDataFrame(rows, "article_id string, source_path string, title string, article_kind string, nth int, contaminant string, family string, "
                               "section string, page int, context string, exposure_cue boolean, dose_cue boolean, background_cue boolean, score int")
    return ctx.summarize(df).head()


@pytest.mark.parametrize("items, kind, label", [
    ([("methods", "e")], "revision_o_sintesis", "revision_o_sintesis"),
    ([("references", "ed")] * 3, "no_determinado", "solo_referencias"),
    ([("introduction", ""), ("references", "")], "no_determinado", "mencion_de_contexto"),
    ([("methods", "e"), ("methods", "")], "no_determinado", "trabajado_como_exposicion_o_ensayo"),
    ([("title_abstract", "e")], "no_determinado", "posible_secundario"),
    ([("title_abstract", "ed")], "no_determinado", "trabajado_como_exposicion_o_ensayo"),
    ([("discussion", "e")], "no_determinado", "posible_secundario"),
    ([("other", "")], "no_determinado", "mencion_de_contexto"),
])
def test_context_classes(spark, items, kind, label):
    assert context_group(spark, items, kind)["clasificacion"] == label


def test_context_mentions_keep_overlaps_but_not_equal_spans(spark):
    from citemill.config import Term

    p = ctx.ContextProtocol(terms=(Term("a", "x", (r"well water", r"water", r"WATER"), "x", "", "f"),))
    text = "Title\n" + "well water. " + "pad " * 400 + "\nResults\nwater was exposed"
    df = spark.createDataFrame([("x", "f", "t", text, [0], "no_determinado")], "article_id string, source_path string, title string, text string, page_starts array<int>, article_kind string")
    got = ctx.find_mentions(df, p).orderBy("start", "end").collect()
    assert [(r["matched_text"], r["section"]) for r in got] == [("well water", "title_abstract"), ("water", "title_abstract"), ("water", "results")]
    assert got[-1]["exposure_cue"] and not got[-1]["background_cue"]


# --- survey, validation, samples -------------------------------------------------------------------


def test_survey_answers(spark):
    rows = [
        ("1", "Peso X (valor actual: 3)", "choice", None, "Mantener"), ("2", "Peso X (valor actual: 3)", "choice", None, "Subir un poco"),
        ("3", "Peso X (valor actual: 3)", "choice", None, ""), ("1", "Valor propuesto — Peso X", "text", None, " 4,5 puntos"),
        ("2", "Valor propuesto — Peso X", "text", None, "2"), ("3", "Valor propuesto — Peso X", "text", None, "no"),
        ("1", "Rejilla", "grid", "zinc", "No sé"), ("2", "Rejilla", "grid", "zinc", None), ("1", "Comentario", "text", None, "  hola "),
        ("2", "Comentario", "text", None, "  "), ("1", "Perfil", "choice", None, "Docente"),
    ]
    df = spark.createDataFrame(rows, "response_id string, question string, kind string, row_label string, answer string")
    v = sv.votes(df).head()
    assert (v["parameter"], v["current_value"], v["mantener"], v["subir"], v["bajar"], v["no_se"], v["pct_change"]) == ("Peso X", "3", 1, 1, 0, 1, 33)
    s = sv.proposal_stats(df).head()
    assert (s["n"], s["mean"], s["median"], s["min"], s["max"]) == (2, 3.25, 3.25, 2.0, 4.5)
    g = sv.term_grid(df).head()
    assert g["No sé"] == 1 and g["(sin responder)"] == 1
    assert [tuple(r) for r in sv.comments(df).collect()] == [("1", "Comentario", "hola")]
    assert [tuple(r) for r in sv.profiles(df).collect()] == [("Docente", 1)]


def test_agreement_and_kappa(spark):
    judged = [(i, "r1", "yes" if i < 6 else "no") for i in range(10)] + [(i, "r2", "yes" if i % 2 == 0 else "no") for i in range(10)] + [(99, "r1", "yes")]
    got = va.agreement(spark.createDataFrame(judged, "i int, who string, label string"), "i", "who", "label", "r1", "r2").head()
    assert (got["items"], got["equal"]) == (10, 5)
    assert got["kappa"] == pytest.approx((0.5 - 0.5) / 0.5)


def test_sample_assertions(spark, protocol):
    rows = [("ok", "zinc and stroke", ["zinc"], ["epilepsy"]), ("bad", "epilepsy", ["zinc", "gone"], ["epilepsy"])]
    df = spark.createDataFrame(rows, "sample_id string, text string, expect array<string>, reject array<string>")
    got = check_samples(df, protocol.terms).collect()
    assert [(r["sample_id"], r["missing"], r["false_positives"], r["unknown"]) for r in got] == [("bad", ["zinc"], ["epilepsy"], ["gone"])]


# --- stage tables -----------------------------------------------------------------------------------


def test_store_uses_the_shared_folder_and_cuts_the_plan(spark):
    kept = store(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert checkpoint_dir(spark).split(":")[-1] in kept.inputFiles()[0]
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 10 and kept.agg(F.sum("x")).head()[0] == 90


# --- review with metadata sources -----------------------------------------------------------------


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x]


def test_review_with_sources_equals_review_of_joined_articles(spark, protocol):
    from citemill.operators.metadata import choose_metadata

    raw = spark.createDataFrame(TEXTS, "article_id string, text string").select(
        "article_id", F.lit("f").alias("source_path"), "text", F.lit(1).alias("pages"), F.lit("").alias("embedded_title"))
    rows = [(0, "A1", {"Paper name": "Other title of things", "Year": "in 1999"}), (1, "A1", {"title": "Cohort of users", "DOI": "doi:10.1234/x.", "Study type": "mice"}),
            (0, "A2", {"Paper name": "A systematic review"}), (0, "none", {"title": "x"})]
    sources = spark.createDataFrame(rows, "source_ord int, article_id string, row map<string,string>")
    apart, joined = rv.run_review(raw, protocol, sources), rv.run_review(choose_metadata(raw, sources), protocol)
    for name in ("articles", "summaries", "relations"):
        a, b = getattr(apart, name), getattr(joined, name)
        assert sorted(map(str, a.select(*sorted(b.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert apart.mentions.drop("article_kind").exceptAll(joined.mentions.drop("article_kind").select(*apart.mentions.drop("article_kind").columns)).count() == 0


def test_the_scan_shuffles_nothing_and_reads_texts_once(spark, protocol, tmp_path):
    from citemill.operators.mentions import find_mentions

    path = str(tmp_path / "raw")
    spark.createDataFrame(TEXTS, "article_id string, text string").select(
        "article_id", F.lit("f").alias("source_path"), "text", F.lit(1).alias("pages"), F.lit("").alias("embedded_title"),
        F.create_map().cast("map<string,string>").alias("metadata")).write.parquet(path)
    scan = find_mentions(rv.describe_articles(spark.read.parquet(path), protocol), protocol, rv.CARRIED)
    assert exchanges(scan) == []
    assert scan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_summaries_shuffle_no_contexts_beyond_the_kept_ones(spark, protocol, small):
    from citemill.operators.classify import summarize

    plan = summarize(small.mentions, protocol)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    counted = [x for x in plan.split("\n") if "Aggregate" in x and "count" in x]
    assert counted and not any("context#" in x for x in counted)


def test_publication_and_analytics_jobs_write_every_table(spark, protocol, small, tmp_path):
    from citemill.plans import jobs

    out = str(tmp_path / "out")
    paths = jobs.publish(small, out)
    assert len(paths) == 18 and all(spark.read.csv(p, header=True, multiLine=True, escape='"').columns for p in paths.values())
    found = jobs.analyse_run(spark, out, str(tmp_path / "analytics"), protocol, "parquet")
    assert len(found) == 9
    row = spark.read.parquet(found["analytics_summary"]).head()
    assert row["k_requested"] == protocol.kmeans_k and 1 <= row["k_effective"] <= 5 and row["features_used"] <= row["features_available"] and row["converged"]
    assert spark.read.parquet(found["kmeans_articles"]).count() == 5


def test_jobs_of_an_empty_corpus(spark, protocol, tmp_path):
    from citemill.plans import jobs

    raw = spark.createDataFrame([], "article_id string, source_path string, text string, pages int, embedded_title string, metadata map<string,string>")
    paths = jobs.publish(rv.run_review(raw, protocol), str(tmp_path / "none"))
    assert {spark.read.csv(paths[n], header=True).count() for n in ("articles", "mentions", "relations", "kwic")} == {0}
