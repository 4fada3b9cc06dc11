"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``docs`` has the columns of
``documents``, and any more, whatever their names but those with two leading underscores. Models learn from the labelled rows of
the whole corpus in ``sf_dir``, as the single operators do. In every stage null texts count as empty, rows may repeat or lack an
id, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate as decontamination
from tideline.llm import mixing, near_copies, sharding, toxicity
from tideline.llm.common import documents, mark, release, release_since, written
from tideline.llm.queries import TARGETS, domain_model

SHARDS = 16


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose worst window scores 0.3 or more go."""
    model = toxicity.fit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that hang together by near copies, 0.8 of five-word shingles, one stays: the one with the smallest id. SimHash tables
    find them first, MinHash bands what those miss; shingle sets decide."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain at least 0.8 of a benchmark item's five-word shingles go."""
    return decontamination.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as their rates say."""
    return mixing.mix(docs, domain_model(spark, sf_dir), TARGETS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents``, and size, curve, shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained models decide in two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared folder, which goes, with all that a stage
    stored for itself, when the next one's stands."""
    docs, last = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        point = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            release_since(spark, point, docs)
            if last is not None:
                release(last)
            last = docs
    return docs
