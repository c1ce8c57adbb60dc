"""Corpus pipeline: documents to packed training sequences.

Quality rules, one document of each near-duplicate group, secrets masked, sources
mixed to target weights, best-fit packing.  Every stage takes all that the stage
before it kept, and all but the last return the columns of documents.

Null and empty texts are rejected by the quality rules; repeated rows are one
document for the near-duplicate stage; the mix repeats rows as often as it takes
them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netcohort.llm import jaccard, mixing, packing, repetition, secrets
from netcohort.llm.common import documents
from netcohort.session import cut

#: Words of a packed sequence.
CAPACITY = packing.CAPACITY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.drop_repetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", packing_stage),
]

#: The secret scan's network and the hashes that draw the mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
