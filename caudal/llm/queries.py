"""The registered queries of this folder: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caudal.llm import sql
from caudal.llm.alignment import aligned
from caudal.llm.bpe import encode, tokenizer_path
from caudal.llm.chat import chat_digests, probe
from caudal.llm.decontaminate import contaminations
from caudal.llm.exact import exact_duplicates
from caudal.llm.jaccard import near_duplicates
from caudal.llm.language_model import lm_scores
from caudal.llm.pii import pii_digests
from caudal.llm.quality import quality_scores
from caudal.llm.substring import without_repeats
from caudal.llm.tables import table
from caudal.llm.toxicity import toxicity_scores
from caudal.llm.variants import spelling_variants
from caudal.llm.warc import archived_pages


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "held_out", "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(given.unionByName(probe(spark)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_path()).select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs).select("doc.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "held_out", "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (pipeline, op1_substring_dedup, op2_quality, op3_pii, op4_chat, op5_bpe, op6_exact_dedup, op7_jaccard_join, op8_decontamination, op9_lm_scoring, op10_warc, op11_alignment, op12_toxicity, op13_spelling_variants)}
SQL: dict[str, str] = {"op1_substring_dedup": sql.SUBSTRING_DEDUP, "op4_chat": sql.CHAT, "op6_exact_dedup": sql.EXACT_DEDUP, "op7_jaccard_join": sql.JACCARD_JOIN, "op10_warc": sql.WARC, "op13_spelling_variants": sql.SPELLING_VARIANTS}
