"""From raw documents to a training mix: every stage works on all that its predecessor kept.

toxicity          rows that the classifier rejects go
near_duplicates   one document of each class stays, the one of smallest doc_id; fingerprints within two bits (SimHash)
                  and 5-word shingle sets of Jaccard >= 0.8, which two bits mostly miss, both link documents
decontamination   rows that overlap a benchmark item go
secrets           every secret is masked; no row goes
mixing            rows are repeated to the sources' targets, numbered by copy_number

Cases, for every stage: null and empty texts are texts without words (judged by the classifier's intercept, one class
of duplicates, no overlap, no secret, size 0); rows without a doc_id cannot be told apart and stay through
near_duplicates, the other stages treat them like any other; of rows that repeat a doc_id near_duplicates keeps one;
very long texts are read whole; an empty table passes as an empty table; further columns pass by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmine.llm import decontam, mixing, near, secrets, toxicity
from quillmine.llm.common import park


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one_jointly(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The classifier and the fingerprints have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = park(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
