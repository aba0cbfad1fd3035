"""The corpus pipeline: five stages, each an operator of ``sparquill.llm`` over all that the stage before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; ``run`` applies them in turn.

Edge cases, for every stage: null and empty texts are documents (the classifier scores them, all of them are exact
copies of each other, none is a near copy, the mix never takes them); very long texts go through whole; rows with a
null id or with an id that others have are rows of their own; further columns, whatever their names, are carried
along up to the mix; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import exact_dedup, mixing, near_dedup, packing, quality
from sparquill.llm.common import documents, materialize, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose score is under the threshold go."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: five words a shingle, similarity 0.8 or more; of each group one document stays."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources at their target weights; a document comes as often as the mix takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token sequences; one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mixing", mixed_sources),
    ("packing", packed),
]

#: Learned scores, hashed draws and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
