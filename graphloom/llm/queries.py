"""Registered queries of the operators: one per dealt operator, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (byte_bpe, collocations, decontaminate, jaccard_join, langid, license_scan, mixing_lm, mixture, sharding, spotsigs, token_counts, toxicity,
                           whitening)
from graphloom.llm.ship import ship
from graphloom.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards of nearly equal bytes by histogram sort."""
    found = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by prefix dynamic programming."""
    return token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the transducer, decoded again by the UTF-8 machine, as digests."""
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     public_tokenizers.PATTERN, ids=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document by the paragraph classifier, confirmed against templates."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document by suffix arrays."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.drop("spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by boosted trees, learned from labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(remainder(5) != 0))
    found = toxicity.predict(docs, model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every document and of its edited text, and their likeness."""
    return spotsigs.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets overlap by 0.9 or more."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by mixture inference, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(remainder(5) != 0))
    found = langid.predict(docs, model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op10_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-mixing score of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model, counts = mixing_lm.learn(docs.where(remainder(7) != 2))
    found = mixing_lm.score(docs, model, counts)
    return found.withColumn("held_out", remainder(7) == 2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened to 16 components by polarisation covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets; a document marked good counts four times one marked bad."""
    quality = table(spark, sf_dir, "labels").select("doc_id", (F.lit(0.5) + F.lit(1.5) * F.col("quality")).alias("weight"))
    return mixture.mix(table(spark, sf_dir, "documents"), quality)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents by multikey quicksort of suffix pointers."""
    return collocations.mine(table(spark, sf_dir, "documents"), depth=5, least=100, top=2000)


def registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


REGISTRY: dict[str, Query] = {f.__name__: registered(f) for f in (
    op1_sharding, op2_token_counts, op3_license_scan, op4_decontaminate, op5_toxicity, op6_byte_bpe, op7_spotsigs, op8_jaccard_join, op9_language_id, op10_mixing_lm,
    op11_whitening, op12_mixture, op13_collocations)}
ORACLES: dict[str, str] = {"op4_decontaminate": decontaminate.ORACLE, "op8_jaccard_join": jaccard_join.ORACLE,
                           "op12_mixture": mixture.ORACLE, "op13_collocations": collocations.ORACLE}
