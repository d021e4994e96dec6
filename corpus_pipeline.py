"""A corpus from raw documents to packed sequences, in stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickweave.llm import jaccard, mixing, packing, quality, secrets
from clickweave.llm.shared import materialized, table, workers_find_package

TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps: fewer than packing by itself, as the workers still hold memory of the stages before.
WORDS_KEPT = 300_000
#: Of them, those that stay when a task has ended, as the workers go on with other stages.
WORDS_BETWEEN_TASKS = 30_000


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    workers_find_package(spark)
    return quality.keep_good(docs, quality.fit_model(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    workers_find_package(spark)
    return jaccard.one_of_each_component(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    workers_find_package(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    workers_find_package(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), memory=WORDS_KEPT, between=WORDS_BETWEEN_TASKS)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages learn, hash and tokenize, which SQL does not; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
