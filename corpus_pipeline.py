"""The training-data pipeline: five stages, each written and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; the last returns doc_id, start, n_tokens and ids_crc32 of what it wrote, read back from its files.
Documents leave for four reasons only: a toxicity score of one half or more, a near-copy with a smaller doc_id, a test
item inside, or a full budget of their source. Texts are never changed. A source below its
share gives documents several times, once an epoch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citemill.llm import decontamination, mixing, simhash, token_files, toxicity
from citemill.llm.common import prepare, table
from citemill.session import checkpoint_dir, store

VOCABULARY, END_ID = 50_257, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    folder = f"{checkpoint_dir(spark)}/citemill/pipeline-ids-{uuid.uuid4().hex}"
    token_files.write_ids(docs.select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), VOCABULARY, END_ID)
    return token_files.read_documents(spark, folder, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_ids),
]

#: Scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
