import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citemill.config import Protocol, Term  # noqa: E402
from citemill.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.citemill.partitions", "8").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("spark-shared")))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def protocol():
    return Protocol(
        terms=(
            Term("a", "zinc", (r"\bzinc\b", r"\bcinc\b"), "cinc", "zinc", "Metals"),
            Term("a", "mercury", (r"\bmercur(y|io)\b", r"\bmethyl\s+mercury\b"), "mercurio", "mercury", "Metals"),
            Term("a", "toxicant", (r"\btoxicants?\b",), "toxico", "toxicant", "Generic", True),
            Term("b", "epilepsy", (r"\bepileps(y|ia)\b",), "epilepsia", "epilepsy", "Brain"),
            Term("b", "stroke", (r"\bstrokes?\b",), "ictus", "stroke", "Vessels"),
        ),
        cues={
            "exposure": [r"\b(exposed|exposure|exposici[oó]n)\b"], "dose": [r"\b\d+\s*(mg/l|ppm)\b"],
            "association": [r"\b(associated\s+with|linked\s+to)\b"], "strong_association": [r"\bsignificantly\b"],
            "speculative": [r"\b(may|might)\b"], "negation": [r"\bnot\s+(associated|linked)\b"],
            "review": [r"\bsystematic\s+review\b"], "human": [r"\b(cohort|patients?)\b"], "in_vivo": [r"\bmice\b"],
            "in_vitro": [r"\bcell\s+lines?\b"],
        },
        name_a="Metales", name_b="Trastornos",
    )


@pytest.fixture(scope="session")
def make_articles(spark, protocol):
    """(article_id, text) pairs as described articles."""
    from pyspark.sql import functions as F

    from citemill.plans.review import describe_articles

    def make(rows, keep_short=True, using=None):
        raw = spark.createDataFrame(rows, "article_id string, text string").select(
            "article_id", F.lit("f").alias("source_path"), "text", F.lit(1).alias("pages"), F.lit("").alias("embedded_title"),
            F.create_map().cast("map<string,string>").alias("metadata"))
        df = describe_articles(raw, using or protocol)
        return df.withColumn("text_extractable", F.lit(True)) if keep_short else df

    return make
