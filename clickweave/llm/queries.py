"""The operators as named queries over the test tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clickweave.llm import collocations, fingerprints, infill, jaccard, mixing, neardup, packing, phrases, quality, secrets, suffixes, token_counts, topk
from clickweave.llm.shared import table, workers_find_package

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", secrets.spans_text(F.col("spans")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeated(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = phrases.remove_recurring(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", neardup.fingerprint_text(F.col("fingerprint")))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.col("output")
    return infill.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(output, F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _runnable(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return query(spark, sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    named = (op1_jaccard, op2_token_counts, op3_secrets, op4_suffix_dedup, op5_mixing, op6_packing, op7_quality, op8_topk, op9_phrase_dedup,
             op10_fingerprints, op11_neardup, op12_infill, op13_collocations)
    return {query.__name__: _runnable(query) for query in named} | {"pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE, "op8_topk": topk.ORACLE, "op12_infill": infill.ORACLE, "op13_collocations": collocations.ORACLE}
