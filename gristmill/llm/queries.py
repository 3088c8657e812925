"""Queries of the operators on the tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import chat_tools, decontamination, filter_audit, fingerprints, html_text, importance, near_vectors, ngram_join, quality, segmentations, token_counts, token_files, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash", "leads")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_chats(chat_tools.turns_as_calls(table(spark, sf_dir, "conversations")), chat_tools.TURN_SCHEMAS)


#: Segmentations that are drawn of each document.
SAMPLES = 2


def segment_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, sample, ids, log_prob, log_inclusion, round_trip): the samples of each document, and whether their
    pieces decode to its text."""
    return segmentations.sample_segmentations(docs, tokenizer("piece_bpe_32k.model"), SAMPLES)


def op5_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with a hash for the ids: (doc_id, sample, n_pieces, ids_hash, log_prob, log_inclusion,
    round_trip)."""
    drawn = segment_documents(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion", "round_trip")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(url_filters.page_captures(pages), url_filters.page_list(pages), "page_id", "url", "fetched_on")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_text": op2_html_text,
    "op3_decontamination": op3_decontamination,
    "op4_chat_tools": op4_chat_tools,
    "op5_segmentations": op5_segmentations,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_url_filters": op9_url_filters,
    "op10_quality": op10_quality,
    "op11_importance": op11_importance,
    "op12_filter_audit": op12_filter_audit,
    "op13_near_vectors": op13_near_vectors,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op4_chat_tools": chat_tools.ORACLE,
    "op8_fingerprints": fingerprints.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_near_vectors": near_vectors.ORACLE,
}
