"""Queries that write a given table, read it back through a source, and return the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks.sql import ORACLES, sql, yes
from citemill.operators import scan
from citemill.config import Term
from citemill.plans import jobs
from citemill.session import checkpoint_dir
from citemill.sinks.lexicons import write_context_lines, write_entity_lines
from citemill.sinks.tables import write_tables
from citemill.sinks.texts import write_texts
from citemill.sources.corpus import discover, read_texts
from citemill.sources.lexicons import read_context_lines, read_entity_lines
from citemill.sources.metadata import read_sources
from citemill.sources.runs import read_run_table
from citemill.synthetic import PROTOCOL as P

TRIPS = {}


def trip(fn):
    TRIPS[fn.__name__] = fn
    return fn


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/citemill/trip-{uuid.uuid4().hex}"


def escape_terms() -> tuple[Term, ...]:
    """Patterns in spellings that a literal prefilter must not misread."""
    spelled = {"hex": r"th\x65", "class": r"[a\]é]nd", "named": r"(?P<x>w)as", "optional": r"of(?: the)?", "unicode": r"\u0069n", "octal": r"\151s"}
    return tuple(Term("a", name, (pattern,), name, name, "C") for name, pattern in spelled.items())


@trip
def escape_pattern_counts(spark, sf):
    """Matches per pattern and document."""
    terms = escape_terms()
    hits = I.raw_articles(spark, sf).select("article_id", F.explode(scan.find_terms(F.col("text"), terms)).alias("h"))
    names = F.array(*[F.lit(t.entity_id) for t in terms])
    return hits.groupBy("article_id", F.element_at(names, F.col("h.term") + 1).alias("term")).agg(F.count("*").alias("n"))


@trip
def text_folder(spark, sf):
    """Conversations as text files, one each, written by many tasks; one without a line has no file and no text."""
    at = folder(spark)
    lines = I.table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit("\r\n"), "text").alias("value"))
    write_texts(lines.withColumn("name", F.concat(F.lit("N"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))), at, "turn", "value")
    texts = read_texts(spark, f"{at}/*").select("source_path", F.md5("text").alias("text_md5"), "pages")  # no text travels to the join
    found = discover(spark, f"{at}/*").select("source_path")
    rows = texts.join(found, "source_path").select(F.nullif(F.regexp_extract("source_path", r"[/=]N(-?[0-9]*)(/[^/]*)?\.txt$", 1), F.lit("")).alias("conv_id"), "text_md5", "pages")
    silent = lines.groupBy("conv_id").agg(F.count("value").alias("n")).where("n = 0")
    return rows.unionByName(silent.select(F.col("conv_id").cast("string"), F.lit(None).cast("string").alias("text_md5"), F.lit(1).alias("pages")))


@trip
def csv_metadata_rows(spark, sf):
    """Suppliers and customers as two CSV metadata files, in order; a third path is missing."""
    at = folder(spark)
    s = I.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ID"), F.col("s_name").alias("Paper name"), F.lit('quote " and, comma').alias("Note"))
    c = I.table(spark, sf, "customer").select(F.concat(F.lit(" S"), F.col("c_custkey") % 50).alias("article_id"), F.col("c_name").alias("title"))
    c = c.groupBy("article_id").agg(F.max("title").alias("title"))
    paths = write_tables({"s": s, "c": c}, at, "csv")
    return read_sources(spark, f"{paths['s']},{at}/none.csv,{paths['c']}").select(
        "source_ord", "article_id", F.coalesce(F.element_at("row", F.lit("Paper name")), F.element_at("row", F.lit("title"))).alias("title"),
        F.coalesce(F.element_at("row", F.lit("Note")), F.lit("")).alias("note"))


def _parts(spark, sf, category: str) -> DataFrame:
    """``part`` as a dictionary."""
    return I.table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_name").alias("label_es"), F.lit("").alias("label_en"), F.col(category).alias("category"),
        (F.col("p_partkey") % 2 == 0).alias("generic"), F.array("p_name").alias("patterns"), F.format_string("%012d", "p_partkey").alias("position"))


@trip
def lexicon_file(spark, sf):
    """Parts as a dictionary of JSON lines in several files, and the place of each entity over all of them."""
    at = write_entity_lines(_parts(spark, sf, "p_brand"), folder(spark))
    return read_entity_lines(spark, at, "a").select(
        "entity_type", "entity_id", "label_es", "category", F.get("patterns", F.lit(0)).alias("pattern"), F.substring("position", 2, 12).cast("long").alias("place"))


@trip
def context_lexicon_file(spark, sf):
    """Parts as the dictionary of the single-variable classifier, in several files."""
    at = write_context_lines(_parts(spark, sf, "p_type").withColumn("entity_id", F.col("label_es")), folder(spark))
    return read_context_lines(spark, at).select("entity_id", "category", "generic", F.substring("position", 2, 12).cast("long").alias("place"))


@trip
def core_csv_articles(spark, sf):
    """The article table of the review job, written as CSV and read back."""
    at = folder(spark)
    write_tables({"articles": jobs.review_tables(I.review(spark, sf))["articles"]}, at, "csv")
    return read_run_table(spark, at, "articles")


@trip
def core_csv_relations(spark, sf):
    at = folder(spark)
    write_tables({"relations": jobs.review_tables(I.review(spark, sf))["relations"]}, at, "csv")
    return read_run_table(spark, at, "relations")


@trip
def core_csv_summaries(spark, sf):
    at = folder(spark)
    write_tables({"entity_summaries": jobs.review_tables(I.review(spark, sf))["entity_summaries"]}, at, "csv")
    return read_run_table(spark, at, "entity_summaries")


@trip
def empty_run_table(spark, sf):
    """A table without rows keeps its header; the count of what comes back, beside that of all rows."""
    at = folder(spark)
    rows = jobs.review_tables(I.review(spark, sf))["articles"]
    write_tables({"articles": rows.where("article_id IS NULL")}, at, "csv")
    back = read_run_table(spark, at, "articles")
    return rows.agg(F.count("*").alias("n_all")).select("n_all", back.agg(F.count("*").alias("n")).scalar().alias("n_back"), F.lit(len(back.columns)).alias("columns"))


@trip
def published_tables(spark, sf):
    """Rows of each table that the publication job wrote as CSV."""
    at = folder(spark)
    paths = jobs.publish(I.review(spark, sf), at)
    wanted = ("articles", "mentions", "entity_summaries", "relations", "kwic", "entity_frequency")
    counts = [spark.read.csv(paths[n], header=True, multiLine=True, escape='"').agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n in wanted]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@trip
def json_rows(spark, sf):
    """Orders as JSON and back."""
    at = folder(spark)
    paths = write_tables({"orders": I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")}, at, "json")
    return spark.read.schema("o_orderkey bigint, o_orderstatus string, o_totalprice double").json(paths["orders"])


@trip
def run_cluster_sizes(spark, sf):
    """Analytics over the CSV tables of a run: every article in one cluster, as the summary says."""
    run, at = folder(spark), folder(spark)
    write_tables({k: v for k, v in jobs.review_tables(I.review(spark, sf)).items() if k in ("articles", "entity_summaries", "relations")}, run, "csv")
    paths = jobs.analyse_run(spark, run, at, P, "parquet")
    found = spark.read.parquet(paths["kmeans_articles"])
    summary = spark.read.parquet(paths["analytics_summary"])
    return found.agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"), (F.count_distinct("cluster") <= P.kmeans_k).alias("within_k")).select(
        "*", summary.select("k_requested").scalar().alias("k_requested"), summary.select("converged").scalar().alias("converged"))


@trip
def cluster_fixed_point(spark, sf):
    """Faults of the clustering: rows nearer to another cluster's mean than to their own, and gaps of the reported distance."""
    r = I.review(spark, sf)
    found, features = I.clusters(spark, sf)
    from citemill.plans import clusters as cl

    points, _ = cl.dense_vectors(features, r.articles)
    nearest = F.least(*[cl.squared_distance(F.col("x"), c) for c in found.centers], F.lit(float("inf")))
    own = F.element_at(F.array(*[cl.squared_distance(F.col("x"), c) for c in found.centers]), F.col("cluster") + 1)
    rows = points.join(found.assigned, "article_id")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(own > nearest + 1e-9).alias("misplaced"), F.count_if(F.abs(F.sqrt(own) - F.col("distance_to_centroid")) > 1e-9).alias("wrong_distance"),
        F.count_if(F.lit(not found.converged)).alias("open"))


def _of(name: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({ORACLES[name]})"


_PLAIN = {"hex": "the", "class": r"[a\]é]nd", "named": "was", "optional": "of( the)?", "unicode": "in", "octal": "is"}
_COUNTED = {"articles": "article_rows", "mentions": "mention_rows", "entity_summaries": "entity_summary", "relations": "relations", "kwic": "kwic", "entity_frequency": "entity_frequency"}
_texts = lambda names: ", ".join(f"coalesce({n}, '') AS {n}" for n in names.split())

TRIP_SQL = {
    "escape_pattern_counts": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT CAST(doc_id AS VARCHAR) AS article_id, '{k}' AS term, len(regexp_extract_all(text, '{p}', 0, 'i')) AS n FROM documents" for k, p in _PLAIN.items()) + ") WHERE n > 0",
    "text_folder": "SELECT conv_id::VARCHAR AS conv_id, md5(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS text_md5, 1 AS pages FROM conversations GROUP BY conv_id",
    "csv_metadata_rows": """SELECT 0 AS source_ord, 'S' || s_suppkey AS article_id, s_name AS title, 'quote " and, comma' AS note FROM supplier
 UNION ALL SELECT 1, 'S' || (c_custkey % 50), max(c_name), '' FROM customer GROUP BY c_custkey % 50""",
    "lexicon_file": "SELECT 'a' AS entity_type, 'p' || p_partkey AS entity_id, p_name AS label_es, p_brand AS category, p_name AS pattern, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part",
    "context_lexicon_file": "SELECT p_name AS entity_id, p_type AS category, p_partkey % 2 = 0 AS generic, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part",
    "core_csv_articles": sql(f"SELECT {_texts('article_id title year doi article_kind')}, {yes('word_count >= 50')} AS text_extractable FROM art", "art"),
    "core_csv_relations": _of("relations", _texts("article_id entity_a_label entity_a_category entity_b_label entity_b_category association confidence section")),
    "core_csv_summaries": _of("entity_summary", _texts("article_id entity_type entity_id label_es label_en category role confidence") + ", n_mentions"),
    "empty_run_table": sql("SELECT count(*) AS n_all, 0 AS n_back, 6 AS columns FROM art", "art"),
    "published_tables": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM ({ORACLES[name]})" for t, name in _COUNTED.items()),
    "json_rows": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "run_cluster_sizes": f"SELECT count(*) AS n, count(DISTINCT doc_id) AS articles, true AS within_k, {P.kmeans_k} AS k_requested, true AS converged FROM documents",
    "cluster_fixed_point": "SELECT count(*) AS n, 0 AS misplaced, 0 AS wrong_distance, 0 AS open FROM documents",
}
ORACLES.update(TRIP_SQL)
