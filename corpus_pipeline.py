"""A corpus from raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, simhash, tokens
from tessera.llm.common import bound_batches, new_path, read
from tessera.llm.queries import tokenizer_path


#: Near copies have this similarity of their five-word shingles, or more.
SIMILARITY = 0.8
#: Bits that their fingerprints differ in at most; of the pairs with that similarity in the test tables, 95 % do.
RADIUS = 12


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels of the documents at hand are learned from."""
    bound_batches(spark)
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs, radius=RADIUS, similarity=SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    bound_batches(spark)
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's token ids, read back from the files written."""
    bound_batches(spark)
    return tokens.token_table(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", to_tokens),
]

#: Classifier, fingerprints and tokenizer have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
