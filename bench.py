"""Headline timings. Prints one JSON line.

``FROM_RAW`` queries start from the raw tables. ``review`` times the whole mining job, from
raw documents to the four stage tables (mentions, articles, summaries, relations), and
``clusters`` the feature and K-Means job. ``FROM_STAGES`` queries build result tables from
those stage tables, as a run does. The total is one complete run plus the separate jobs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import inputs  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

FROM_RAW = (
    "mention_totals", "mention_rows", "sentence_spans", "section_spans", "article_rows", "metadata_choice", "summary_roles",
    "context_mention_rows", "taxonomy_terms", "survey_stats",
)
FROM_STAGES = (
    "entity_summary", "relations", "review_table", "kwic", "term_tfidf_matrix", "entity_frequency", "cooccurrence",
    "weight_sensitivity", "role_sample", "pairs_collapsed", "article_features", "kmeans_articles", "cluster_profiles",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.citemill.partitions", str(2 * int(cpus))).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["mention_totals"](spark, sf_dir).limit(1).collect()  # start JVM and Python workers
    times: dict[str, float] = {}

    def timed(name, job) -> None:
        begin = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - begin, 3)

    def run(name) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in FROM_RAW:
        timed(name, lambda: run(name))
    inputs.forget_stages()
    timed("review", lambda: inputs.review(spark, sf_dir))
    timed("clusters", lambda: inputs.clusters(spark, sf_dir))
    for name in FROM_STAGES:
        timed(name, lambda: run(name))
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
