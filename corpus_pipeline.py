"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept.  The first four return rows of the columns of
documents; the last returns the digest of the encoding (doc_id, n_tokens, ids_sha256, decoded_sha256).
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import byte_bpe, decontaminate, jaccard_join, langid, toxicity
from graphloom.llm.components import written
from graphloom.llm.queries import table
from graphloom.llm.ship import ship
from graphloom.session import ensure_checkpoint_dir


#: Whole texts that an Arrow batch holds at most: Spark's 10,000 would be some hundred MB in every worker and executor.
BATCH_ROWS = 512


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the rows' own ``lang``; rows go whose text is null, has no letter, or has no
    language that makes up half of it.  Without any labelled row no language is known and all rows go."""
    _ready(spark)
    return langid.keep_identified(docs, langid.learn(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from ``labels`` of the rows at hand; rows go whose calibrated score is 0.5 or more."""
    _ready(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles that overlap by 0.8 or more; the row of the smallest id of each group stays."""
    _ready(spark)
    return jaccard_join.keep_one(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go of whose words a twentieth or more stands in 13-word windows of ``benchmark``."""
    _ready(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each text, decoded again, as digests."""
    _ready(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("encoding", encoding)]

#: Learned models stand in the first two stages, so SQL can't give the rows; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    _ready(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
