"""Calibration survey: answers in long form (response_id, question, kind, row_label, answer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill import fixed
from citemill.operators.groups import exact_median


def _answers() -> Column:
    return F.coalesce("answer", F.lit(""))


def votes(answers: DataFrame) -> DataFrame:
    """Keep / raise / lower / unknown votes per parameter and the share that would change it."""
    parameter = F.regexp_extract("question", fixed.SURVEY_PARAMETER, 1)
    current = F.regexp_extract("question", fixed.SURVEY_PARAMETER, 2)
    kinds = {name: _answers().startswith(word) for name, word in fixed.SURVEY_VOTES.items()}
    known = kinds["mantener"] | kinds["subir"] | kinds["bajar"]
    rows = answers.where(F.col("question").rlike(fixed.SURVEY_PARAMETER)).groupBy(parameter.alias("parameter")).agg(
        F.max(current).alias("current_value"), F.count("*").alias("responses"),
        *[F.count_if(c).alias(n) for n, c in kinds.items()], F.count_if(~known).alias("no_se"),
    )
    share = (F.col("subir") + F.col("bajar")) / F.col("responses") * 100
    return rows.withColumn("pct_change", F.floor(share + 0.5).cast("int"))


def proposals(answers: DataFrame) -> DataFrame:
    """Numbers proposed per parameter, one row each; a decimal comma is accepted."""
    prefix = fixed.SURVEY_PROPOSAL_PREFIX
    leading = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
    number = F.regexp_extract(F.regexp_replace(F.trim(_answers()), ",", "."), leading, 0)
    return (
        answers.where(F.col("question").startswith(prefix))
        .select(
            "response_id",
            F.col("question").substr(F.lit(len(prefix) + 1), F.length("question")).alias("parameter"),
            F.nullif(number, F.lit("")).try_cast("double").alias("value"),
        )
        .where("value is not null")
    )


def _two_decimals(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def proposal_stats(answers: DataFrame) -> DataFrame:
    """Count, mean, median, minimum and maximum of the proposed numbers."""
    rows = proposals(answers)
    stats = rows.groupBy("parameter").agg(
        F.count("*").alias("n"), _two_decimals(F.avg("value")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    median = exact_median(rows, ["parameter"], "value")
    return stats.join(median, "parameter").withColumn(
        "median", F.when(F.col("n") % 2 == 1, F.col("median")).otherwise(_two_decimals(F.col("median")))
    )


def term_grid(answers: DataFrame) -> DataFrame:
    """Answers per grid row, one column per possible answer."""
    columns = list(fixed.SURVEY_GRID_ANSWERS)
    given = F.when(_answers() == "", fixed.NO_ANSWER).otherwise(F.col("answer"))
    return (
        answers.where("kind = 'grid'").withColumn("given", given)
        .groupBy(F.col("question").alias("grid"), F.col("row_label").alias("term"))
        .pivot("given", columns).agg(F.count(F.lit(1))).fillna(0, columns)
    )


def comments(answers: DataFrame) -> DataFrame:
    """Non-blank free text per question."""
    special = (
        F.col("question").rlike(fixed.SURVEY_PARAMETER)
        | F.col("question").startswith(fixed.SURVEY_PROPOSAL_PREFIX)
        | F.col("question").startswith(fixed.SURVEY_PROFILE_PREFIX)
    )
    text = F.trim(_answers())
    return answers.where((F.col("kind") == "text") & ~special & (text != "")).select(
        "response_id", "question", text.alias("comment")
    )


def profiles(answers: DataFrame) -> DataFrame:
    given = F.trim(_answers())
    return answers.where(F.col("question").startswith(fixed.SURVEY_PROFILE_PREFIX)).groupBy(
        F.when(given == "", fixed.NO_ANSWER).otherwise(given).alias("profile")
    ).agg(F.count("*").alias("responses"))
