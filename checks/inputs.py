"""The driver tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.plans.review import Review, describe_articles, run_review
from citemill.session import configure, dealt, store
from citemill.synthetic import PROTOCOL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as undescribed articles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dealt(docs).select(
        F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("source_path"), "text",
        F.lit(1).alias("pages"), F.lit("").alias("embedded_title"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_articles(raw_articles(spark, sf_dir), PROTOCOL)


_stages: dict[tuple, object] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, build):
    """Stage tables of one input are written once per application and shared by queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        _stages[key] = build()
    return _stages[key]


def review(spark: SparkSession, sf_dir: str) -> Review:
    return _stage(spark, sf_dir, "review", lambda: run_review(raw_articles(spark, sf_dir), PROTOCOL))


def clusters(spark: SparkSession, sf_dir: str):
    from citemill.plans.clusters import run_clusters

    r = review(spark, sf_dir)
    return _stage(spark, sf_dir, "clusters", lambda: run_clusters(r.articles, r.summaries, r.relations, PROTOCOL.kmeans_k))


def context_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for the single-variable classifier, with a page start every 1000 characters."""
    from citemill.functions.text import word_count
    from citemill.plans import context as ctx

    text = F.coalesce("text", F.lit(""))
    return ctx.describe_articles(raw_articles(spark, sf_dir), CONTEXT).select(
        "article_id", "source_path", "text", "pages", "title", F.sequence(F.lit(0), F.length(text), F.lit(1000)).alias("page_starts"),
        word_count(F.col("text")).alias("word_count"), "article_kind")


def _context_protocol():
    from citemill.plans.context import ContextProtocol

    return ContextProtocol(
        terms=tuple(t for t in PROTOCOL.terms if t.slot == "a"),
        headers={
            "introduction": [r"(?im)^\s*(of|der)\b"], "methods": [r"(?im)^\s*(and|de)\b"],
            "results": [r"(?im)^\s*(in)\b"], "discussion": [r"(?im)^\s*(to)\b"],
            "conclusion": [r"(?im)^\s*(was)\b"], "references": [r"(?im)^\s*(that|licensed)\b"],
        },
        cues={
            "exposure": [r"\bfor\b", r"\bfrom\b"], "dose": [r"\bon\b"], "background": [r"\bthis\b"],
            "review": [r"\blicensed\b"], "epidemiology": [r"\band\b"], "preclinical_metadata": [r"\bund\b"],
            "preclinical_text": [r"\bles\b"],
        },
    )


CONTEXT = _context_protocol()


def context_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citemill.plans import context as ctx

    return _stage(spark, sf_dir, "context", lambda: store(ctx.find_mentions(context_articles(spark, sf_dir), CONTEXT), "context"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as page texts: one article per conversation, one page per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("article_id"), F.col("turn").alias("page_no"), F.col("text").alias("page_text")
    )


def metadata_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metadata sources for every document, titled by slices from anywhere in its whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("article_id"), F.coalesce("text", F.lit("")).alias("text"))

    def piece(step: int, size: int):
        return F.substring("text", (F.col("doc_id") * step % F.greatest(F.length("text") - size, F.lit(1)) + 1).cast("int"), F.lit(size))

    one = F.create_map(
        F.lit("Paper name"), piece(7919, 60), F.lit("Year"), F.concat(F.lit("in "), F.lit(1950) + F.col("doc_id") % 100),
        F.lit("DOI"), F.concat(F.lit("doi:10.1234/AB."), "article_id", F.lit(".")),
    )
    two = F.create_map(F.lit("title"), piece(104729, 80), F.lit("Study type"), F.lit(" cohort  study "))
    return docs.select(F.lit(0).alias("source_ord"), "article_id", one.alias("row")).unionByName(
        docs.select(F.lit(1).alias("source_ord"), "article_id", two.alias("row")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as survey answers, one answer per event."""
    e = table(spark, sf_dir, "events")
    pick = F.col("event_id") % 5
    name, user = F.col("event_type"), F.col("user_id")
    number = F.when(F.col("event_id") % 7 == 0, "abc").otherwise(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
    given = (F.col("event_id") / 5).cast("long") % 6
    question = (
        F.when(pick == 0, F.concat(name, F.lit(" (valor actual: 3)"))).when(pick == 1, F.concat(F.lit("Valor propuesto — "), name))
        .when(pick == 2, F.concat(F.lit("Rejilla "), name)).when(pick == 3, F.concat(F.lit("Comentario "), name)).otherwise("Perfil")
    )
    vote = F.when(user % 4 == 0, "Mantener igual").when(user % 4 == 1, "Subir").when(user % 4 == 2, "Bajar").otherwise("No sé")
    cell = (
        F.when(given == 0, "Bien clasificado").when(given == 1, "Debería ir en otro grupo")
        .when(given == 2, "No debería estar / sobra").when(given == 3, "No sé").when(given == 4, "").otherwise(F.lit(None))
    )
    note = F.when(user % 3 == 0, "  ").otherwise(F.concat(F.lit(" nota "), user, F.lit(" ")))
    profile = F.when(user % 5 == 0, "").when(user % 5 == 1, " Docente ").otherwise("Investigador")
    return e.select(
        F.col("event_id").cast("string").alias("response_id"), question.alias("question"),
        F.when(pick == 0, "choice").when(pick == 2, "grid").otherwise("text").alias("kind"),
        F.when(pick == 2, F.concat(F.lit("k"), user % 10)).alias("row_label"),
        F.when(pick == 0, vote).when(pick == 1, number).when(pick == 2, cell).when(pick == 3, note).otherwise(profile).alias("answer"),
    )


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a taxonomy: type > brand > part. Some nodes have defects on purpose."""
    p = table(spark, sf_dir, "part")
    no_patterns = F.array().cast("array<string>")

    def node(node_id, parent, position, kind, entity, es, en, patterns):
        return [
            node_id.alias("node_id"), parent.alias("parent_id"), position.alias("position"), F.lit(kind).alias("kind"),
            entity.alias("entity_id"), es.alias("label_es"), en.alias("label_en"), F.lit(False).alias("generic"),
            patterns.alias("patterns"),
        ]

    type_id, brand_id = F.col("p_type"), F.concat("p_type", F.lit("/"), "p_brand")
    null = F.lit(None).cast("string")
    types = p.select("p_type").distinct().select(
        *node(type_id, null, type_id, "category", null, type_id, F.lit(""), no_patterns))
    label = F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand"))
    brands = p.select("p_type", "p_brand").distinct().select(
        *node(brand_id, type_id, brand_id, "category", null, label, F.lit(""), no_patterns))
    key = F.col("p_partkey").cast("string")
    word = F.replace(F.col("p_name"), F.lit(" "), F.lit(r"\s+"))
    patterns = (
        F.when(F.col("p_partkey") % 11 == 0, no_patterns)
        .when(F.col("p_partkey") % 13 == 0, F.array(F.concat(F.lit(r"\\b"), word)))
        .when(F.col("p_partkey") % 17 == 0, F.array(F.concat(F.lit(r"\bnot "), word)))
        .otherwise(F.array(F.concat(F.lit(r"\b"), word, F.lit(r"\b"))))
    )
    terms = p.select(*node(
        F.concat(F.lit("t"), key), brand_id, key, "term", F.when(F.col("p_partkey") % 3 == 0, null).otherwise(F.concat(F.lit("part"), key)),
        F.when(F.col("p_partkey") % 19 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 5 == 0, F.initcap("p_name")).otherwise(""), patterns))
    return types.unionByName(brands).unionByName(terms)


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as sheet rows without a header row, under two leading rows."""
    p = table(spark, sf_dir, "part")
    body = p.select(
        (F.col("p_partkey") + 2).cast("long").alias("row_no"),
        F.array(
            F.when(F.col("p_partkey") % 10 == 9, F.lit("n/a")).otherwise(F.concat(F.lit(" P"), F.col("p_partkey") % 1500)),
            F.col("p_name"), F.lit(None).cast("string"), F.col("p_brand"),
        ).alias("cells"),
    )
    head = spark.sql(
        "SELECT * FROM VALUES (0L, array('Listado', CAST(NULL AS STRING))), (1L, array(' ID ', 'Title', '', 'Title')) t(row_no, cells)"
    )
    return head.unionByName(body)


def forget_stages() -> None:
    """Rebuild stage tables on the next use."""
    _stages.clear()
