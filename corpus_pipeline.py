"""From documents to the shards of a training corpus.

Each stage takes nulls in any column, empty and very long texts, repeated rows, columns
of any name and an empty table, as the operator that it calls says; all but the last
return the columns of their documents. The last gives the place of each document of the
mixture, which carries the rows' order; texts are joined to it from the stage before
by doc_id, of which equal ones have the same text_crc32 where they are copies.

Each stage's rows are written as Parquet to the shared folder and read again as
the next stage's documents, so no stage works out its predecessors again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import ensure_checkpoint_dir, table
from gristmill.llm.decontamination import decontaminated
from gristmill.llm.mixing import mix
from gristmill.llm.near_copies import without_near_copies
from gristmill.llm.quality_classifier import classify
from gristmill.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return classify(docs, table(spark, sf_dir, "labels")).where("quality_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more join, found by SimHash fingerprints and by minima."""
    return without_near_copies(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and ordered as the target weights of their sources ask; none is left out."""
    mixed = mix(docs)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mixture."""
    return shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup by SimHash and shingles", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("sharding", sharding),
]

#: SQL can express neither the classifier's model nor the alignments of the decontamination.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
