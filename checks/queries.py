"""Every registered query: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from citemill import fixed
from citemill.functions import labels as lb
from citemill.functions import text as tx
from citemill.operators import lexicon as lx
from citemill.operators.mentions import find_mentions
from citemill.operators.metadata import choose_metadata, from_row
from citemill.operators.pages import assemble, clean_pages, page_spans
from citemill.operators.sections import section_table
from citemill.plans import clusters as cl
from citemill.plans import context as ctx
from citemill.plans import figures as fg
from citemill.plans import publication as pb
from citemill.plans import report as rp
from citemill.plans import review as rv
from citemill.plans import survey as sv
from citemill.plans import validation as va
from citemill.sources.corpus import from_pages, natural_order, file_fields, with_metadata
from citemill.session import dealt, store
from citemill.sources.metadata import normalise_sheet
from citemill.synthetic import PROTOCOL as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return find_mentions(I.articles(spark, sf), P)


# --- text and spans -------------------------------------------------------------


@query
def mention_totals(spark, sf):
    """Mentions, articles and share of all mentions per label."""
    return rounded(fg.mention_totals(mentions(spark, sf)), "porcentaje_menciones")


@query
def mention_offsets(spark, sf):
    return mentions(spark, sf).select("article_id", "mention_idx", "nth", "entity_type", "entity_id", "start", "end", "matched_text")


@query
def mention_context(spark, sf):
    return mentions(spark, sf).select("article_id", "mention_idx", "page", "context")


@query
def mention_sentence(spark, sf):
    return mentions(spark, sf).select("article_id", "mention_idx", "sentence")


@query
def mention_score(spark, sf):
    return mentions(spark, sf).select("article_id", "mention_idx", "section", "score")


@query
def mention_rows(spark, sf):
    return rv.mention_rows(mentions(spark, sf))


@query
def sentence_spans(spark, sf):
    s = I.raw_articles(spark, sf).select("article_id", F.explode(tx.split_sentences(F.col("text"))).alias("s"))
    return s.select("article_id", "s.start", "s.end", "s.sentence")


@query
def clean_text(spark, sf):
    return I.raw_articles(spark, sf).select(
        "article_id", F.md5(tx.clean_page(F.col("text"))).alias("cleaned"), F.md5(tx.squash(F.col("text"))).alias("squashed"),
        tx.word_count(F.col("text")).alias("words"),
    )


@query
def section_spans(spark, sf):
    return section_table(I.raw_articles(spark, sf), P.headers)


# --- articles ---------------------------------------------------------------------


@query
def article_rows(spark, sf):
    return rv.article_rows(I.articles(spark, sf))


@query
def metadata_choice(spark, sf):
    chosen = choose_metadata(I.raw_articles(spark, sf).drop("metadata"), I.metadata_sources(spark, sf))
    return chosen.select("article_id", from_row(F.col("metadata"), fixed.TITLE_KEYS).alias("chosen_title"))


@query
def metadata_articles(spark, sf):
    raw = with_metadata(I.raw_articles(spark, sf).drop("metadata"), I.metadata_sources(spark, sf))
    return rv.article_rows(rv.describe_articles(raw, P)).drop("source_path", "pages", "word_count", "text_extractable")


@query
def context_metadata_choice(spark, sf):
    """The single-variable classifier's choice: other stop words and title keys."""
    chosen = choose_metadata(
        I.raw_articles(spark, sf).drop("metadata"), I.metadata_sources(spark, sf), ("Paper name", "col3"),
        fixed.CONTEXT_TITLE_STOPWORDS, fixed.CONTEXT_TITLE_TOKEN,
    )
    return chosen.select("article_id", from_row(F.col("metadata"), ("Paper name", "title")).alias("chosen_title"))


@query
def sheet_metadata(spark, sf):
    rows = normalise_sheet(I.sheet_rows(spark, sf))
    return rows.select("article_id", *[F.element_at("row", F.lit(k)).alias(k) for k in ("ID", "Title", "col3", "Title_2")])


@query
def natural_file_order(spark, sf):
    paths = I.table(spark, sf, "documents").select(
        F.concat(F.lit("/corpus/"), F.when(F.col("doc_id") % 3 == 0, "x_").otherwise("A"), F.col("doc_id"), F.lit(".TXT")).alias("p")
    )
    fields = file_fields(F.col("p"))
    return paths.select("p", *[fields[c].cast("string").alias(c) for c in ("article_id", *natural_order()) if c != "order_digits"])


@query
def page_offsets(spark, sf):
    return page_spans(clean_pages(I.pages(spark, sf)))


@query
def paged_articles(spark, sf):
    a = assemble(clean_pages(I.pages(spark, sf)))
    return a.select("article_id", "pages", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def paged_mentions(spark, sf):
    """Mentions in page-built articles, with their exact page."""
    raw = with_metadata(from_pages(I.pages(spark, sf)), None)
    found = find_mentions(rv.describe_articles(raw, P), P)
    return found.select("article_id", "mention_idx", "entity_id", "start", "page", "matched_text")


# --- summaries and relations ---------------------------------------------------------


@query
def entity_summary(spark, sf):
    return rv.summary_rows(I.review(spark, sf).summaries)


@query
def summary_roles(spark, sf):
    """Role and confidence straight from the documents in one job."""
    from citemill.operators.classify import summarize

    return summarize(store(mentions(spark, sf), "mentions"), P).groupBy("entity_type", "role", "confidence").agg(
        F.count("*").alias("n"), F.sum("confidence_score").alias("score"))


@query
def relations(spark, sf):
    r = I.review(spark, sf)
    return rv.relation_rows(r.relations, r.articles)


@query
def review_table(spark, sf):
    r = I.review(spark, sf)
    return rv.review_table(r.summaries, r.relations, r.articles, P)


# --- publication tables -----------------------------------------------------------------


@query
def kwic(spark, sf):
    r = I.review(spark, sf)
    return pb.kwic(r.mentions, r.articles)


@query
def term_values(spark, sf):
    r = I.review(spark, sf)
    return rounded(pb.term_values(r.mentions, r.articles), "per_10k", "tfidf")


@query
def term_count_matrix(spark, sf):
    r = I.review(spark, sf)
    m = pb.term_matrix(r.mentions, r.articles, "a", "n")
    return m.toDF(*[c.replace("::", "_") for c in m.columns])


@query
def term_per_10k_matrix(spark, sf):
    r = I.review(spark, sf)
    m = pb.term_matrix(r.mentions, r.articles, "b", "per_10k")
    m = m.toDF(*[c.replace("::", "_") for c in m.columns])
    return rounded(m, *[c for c in m.columns if c.startswith("b_")])


@query
def term_tfidf_matrix(spark, sf):
    r = I.review(spark, sf)
    m = pb.term_matrix(r.mentions, r.articles, "b", "tfidf")
    m = m.toDF(*[c.replace("::", "_") for c in m.columns])
    return rounded(m, *[c for c in m.columns if c.startswith("b_")])


@query
def entity_frequency(spark, sf):
    r = I.review(spark, sf)
    return rounded(pb.entity_frequency(r.mentions, r.articles), "document_frequency", "idf", "mentions_per_10k_words_corpus", "mean_mentions_per_article")


@query
def cooccurrence(spark, sf):
    r = I.review(spark, sf)
    return pb.cooccurrence(r.mentions, r.relations, r.articles)


@query
def weight_sensitivity(spark, sf):
    return pb.weight_sensitivity(I.review(spark, sf).summaries, P)


@query
def role_sample(spark, sf):
    r = I.review(spark, sf)
    return pb.role_template(r.summaries, r.articles, P.validation_sample_size)


@query
def relation_sample(spark, sf):
    r = I.review(spark, sf)
    return pb.relation_template(r.relations, r.articles, P.validation_sample_size)


@query
def run_summary(spark, sf):
    r = I.review(spark, sf)
    totals = pb.corpus_totals(r.articles, r.mentions, r.summaries, r.relations)
    n = P.validation_sample_size
    return pb.run_summary(totals, pb.role_template(r.summaries, r.articles, n), pb.relation_template(r.relations, r.articles, n), P)


def _judged(spark, sf, rows):
    """Rows with the quality label of their document as a reviewer's verdict."""
    labels = I.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("article_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("correct_evidence"))
    return rows.join(labels, "article_id", "left")


@query
def role_precision(spark, sf):
    return rounded(va.precision_by(_judged(spark, sf, I.review(spark, sf).summaries), "role"), "precision")


@query
def association_precision(spark, sf):
    return rounded(va.precision_by(_judged(spark, sf, I.review(spark, sf).relations), "association"), "precision")


@query
def section_false_positives(spark, sf):
    return va.false_positives_by(_judged(spark, sf, I.review(spark, sf).relations), "section")


@query
def entity_false_positives(spark, sf):
    return va.false_positives_by(_judged(spark, sf, I.review(spark, sf).summaries), "entity_id")


@query
def reviewer_agreement(spark, sf):
    labels = I.table(spark, sf, "labels").select("doc_id", F.explode(F.array(
        F.struct(F.lit("r1").alias("who"), F.col("quality").alias("label")),
        F.struct(F.lit("r2").alias("who"), (1 - F.col("toxic")).alias("label")))).alias("j")).select("doc_id", "j.*")
    return rounded(va.agreement(labels, "doc_id", "who", "label", "r1", "r2"), "observed", "expected", "kappa")


# --- figure tables -------------------------------------------------------------------------


@query
def detection_frequency(spark, sf):
    return fg.detection_frequency(I.review(spark, sf).summaries, "a")


@query
def category_counts(spark, sf):
    return fg.category_counts(I.review(spark, sf).relations)


@query
def articles_by_kind(spark, sf):
    return fg.articles_by_kind(I.articles(spark, sf))


@query
def relations_by_association(spark, sf):
    return fg.relations_by_association(I.review(spark, sf).relations)


@query
def pairs_by_type(spark, sf):
    return rounded(fg.pair_table(I.review(spark, sf).relations, True), "avg_strength")


@query
def pairs_collapsed(spark, sf):
    return rounded(fg.pair_table(I.review(spark, sf).relations, False), "avg_strength")


@query
def section_weight_matrix(spark, sf):
    return fg.weight_matrix(I.review(spark, sf).relations, "association", "section", [s for s in P.sections if s != "other"])


@query
def category_weight_matrix(spark, sf):
    names = sorted({t.category for t in P.terms if t.slot == "b"})
    m = fg.weight_matrix(I.review(spark, sf).relations, "entity_a_category", "entity_b_category", names)
    return m.toDF(*[c.replace(" ", "_") for c in m.columns])


@query
def top_pairs(spark, sf):
    return rounded(fg.top_pairs(fg.pair_table(I.review(spark, sf).relations, False)), "avg_strength")


@query
def bubble_cells(spark, sf):
    return rounded(fg.bubble_cells(fg.pair_table(I.review(spark, sf).relations, False)), "avg_strength")


@query
def network_edges(spark, sf):
    return fg.network_edges(fg.pair_table(I.review(spark, sf).relations, True))


@query
def section_totals(spark, sf):
    return rounded(fg.section_totals(I.review(spark, sf).mentions), "porcentaje_menciones")


@query
def label_by_section(spark, sf):
    return fg.label_by_section(I.review(spark, sf).mentions, P.sections)


# --- clusters -----------------------------------------------------------------------------------


@query
def article_features(spark, sf):
    r = I.review(spark, sf)
    return rounded(cl.log_features(cl.article_features(r.articles, r.summaries, r.relations)), "value")


@query
def feature_stats(spark, sf):
    r = I.review(spark, sf)
    features = cl.select_features(cl.log_features(cl.article_features(r.articles, r.summaries, r.relations)))
    return rounded(cl.feature_stats(features, r.articles), "mean", "deviation")


@query
def standardised_features(spark, sf):
    r = I.review(spark, sf)
    features = cl.select_features(cl.log_features(cl.article_features(r.articles, r.summaries, r.relations)))
    return rounded(cl.standardised(features, r.articles), "z", digits=5)


@query
def kmeans_articles(spark, sf):
    r = I.review(spark, sf)
    found, _ = I.clusters(spark, sf)
    return rounded(cl.cluster_articles(found.assigned, r.articles, r.relations), "distance_to_centroid", digits=5)


@query
def cluster_profiles(spark, sf):
    found, features = I.clusters(spark, sf)
    return cl.cluster_profiles(features, found.assigned)


@query
def kmeans_centroids(spark, sf):
    table = cl.centroid_table(I.clusters(spark, sf)[0])
    return rounded(table, *[c for c in table.columns if c.startswith("zscore_")], digits=5)


@query
def cluster_map_labels(spark, sf):
    r = I.review(spark, sf)
    found, _ = I.clusters(spark, sf)
    return fg.cluster_map_labels(cl.cluster_articles(found.assigned, r.articles, r.relations))


@query
def kmeans_vectors(spark, sf):
    """The same K-Means on given vectors."""
    points = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("article_id"), F.col("embedding").cast("array<double>").alias("x"))
    found = cl.kmeans(points, [], 4)
    return found.assigned.groupBy("cluster").agg(F.count("*").alias("members"))


# --- single-variable classifier -------------------------------------------------------------------


@query
def context_mention_rows(spark, sf):
    return ctx.mention_rows(ctx.find_mentions(I.context_articles(spark, sf), I.CONTEXT))


@query
def context_summary(spark, sf):
    return ctx.summarize(I.context_mentions(spark, sf))


@query
def context_articles(spark, sf):
    return ctx.article_table(ctx.summarize(I.context_mentions(spark, sf)))


@query
def context_categories(spark, sf):
    return ctx.category_table(ctx.summarize(I.context_mentions(spark, sf)))


@query
def context_diagnostics(spark, sf):
    return ctx.diagnostics(I.context_articles(spark, sf), I.context_mentions(spark, sf))


@query
def context_report(spark, sf):
    m = I.context_mentions(spark, sf)
    return ctx.report_numbers(I.context_articles(spark, sf), m, ctx.summarize(m))


@query
def context_top_families(spark, sf):
    return ctx.top_families(ctx.category_table(ctx.summarize(I.context_mentions(spark, sf))))


@query
def context_worked_names(spark, sf):
    return ctx.worked_names(ctx.summarize(I.context_mentions(spark, sf)))


@query
def context_sections(spark, sf):
    return ctx.mentions_by_section(I.context_mentions(spark, sf))


# --- reports, dictionary checks, survey ---------------------------------------------------------------


@query
def run_metrics(spark, sf):
    r = I.review(spark, sf)
    return rp.run_metrics({"articles": r.articles, "mentions": r.mentions, "summaries": r.summaries, "relations": r.relations})


@query
def relation_preview(spark, sf):
    return rp.relation_preview(I.review(spark, sf).relations)


@query
def table_preview(spark, sf):
    rows = rv.summary_rows(I.review(spark, sf).summaries)
    return rp.table_preview(rows, ["article_id", "entity_type", "entity_id"])


@query
def taxonomy_terms(spark, sf):
    flat = lx.flatten_taxonomy(I.part_nodes(spark, sf), "Parts", "a")
    return flat.select("entity_id", "label_es", "label_en", "category", F.array_join("patterns", " ").alias("patterns"), "position")


@query
def taxonomy_parents(spark, sf):
    flat = lx.flatten_taxonomy(I.part_nodes(spark, sf), "", "a", full_path=False)
    return flat.groupBy("category").agg(F.count("*").alias("terms"))


@query
def incomplete_terms(spark, sf):
    return lx.incomplete_terms(I.part_nodes(spark, sf)).select("node_id", lb.yes_no(F.col("no_label")).alias("no_label"), lb.yes_no(F.col("no_pattern")).alias("no_pattern"))


@query
def double_escaped(spark, sf):
    return lx.double_escaped(I.part_nodes(spark, sf))


@query
def unlabelled_categories(spark, sf):
    return lx.unlabelled_categories(I.part_nodes(spark, sf))


@query
def dictionary_counts(spark, sf):
    return lx.node_counts(I.part_nodes(spark, sf)).withColumn("has_terms", lb.yes_no(F.col("has_terms")))


@query
def unreachable_labels(spark, sf):
    return lx.unreachable_labels(I.part_nodes(spark, sf).where("kind = 'term'").withColumn("entity_id", F.col("node_id")))


@query
def sample_assertions(spark, sf):
    """Documents as sample texts: German ones must hold the German terms, others must not."""
    german = F.array(F.lit("der"), F.lit("nicht"), F.lit("absent_id"))
    none = F.array().cast("array<string>")
    samples = I.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), "text",
        F.when(F.col("lang") == "de", german).otherwise(none).alias("expect"),
        F.when(F.col("lang") == "de", none).otherwise(german).alias("reject"))
    out = lx.check_samples(dealt(samples), P.terms)
    return out.select("sample_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("missing", "false_positives", "unknown")])


@query
def survey_votes(spark, sf):
    return sv.votes(I.answers(spark, sf))


@query
def survey_proposals(spark, sf):
    return sv.proposals(I.answers(spark, sf))


@query
def survey_stats(spark, sf):
    return rounded(sv.proposal_stats(I.answers(spark, sf)), "mean", "median")


@query
def survey_grid(spark, sf):
    g = sv.term_grid(I.answers(spark, sf))
    return g.toDF("grid", "term", "well_placed", "other_group", "surplus", "unknown", "unanswered")


@query
def survey_comments(spark, sf):
    return sv.comments(I.answers(spark, sf))


@query
def survey_profiles(spark, sf):
    return sv.profiles(I.answers(spark, sf))


# --- sources and sinks: written, read back ----------------------------------------------------

import checks.kmeans_sql  # noqa: E402, F401  adds its SQL to the registry
from checks.trips import TRIPS  # noqa: E402

QUERIES.update(TRIPS)
