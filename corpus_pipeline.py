"""The corpus pipeline: each stage applies one operator to all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the docs of the next. All but the last return the columns of ``documents``. A row is known by
its doc_id and a hash of its text: of rows with one doc_id, or none, each different text is judged by itself,
and repeated rows are kept or left out together, but for near_duplicates, which keeps one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontamination, ngram_join, quality
from gristmill.llm.queries import segment_documents, table
from gristmill.llm.storage import broadcast_if_small, materialize, text_hash


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows (doc_id, text_hash). These are broadcast, if their count allows it; else both
    sides are shuffled by text."""
    gone = materialize(rows.select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, 32), (text_hash("text") == F.col("gone_hash")) & docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return _without(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles the one with the least doc_id; of rows that repeat it one. Texts without
    words link with nothing and stay."""
    joined = materialize(ngram_join.ngram_jaccard_join(docs), "joined")
    kept = _without(docs, joined.where("not leads"))
    leaders = joined.where("leads and n_shingles > 0").groupBy("doc_id", "text_hash").count()
    repeated = materialize(leaders.where("count > 1"), "repeated")
    if not repeated.limit(1).count():
        return kept
    own = F.struct("doc_id", text_hash("text").alias("text_hash"))
    twice = kept.withColumn("row", own).join(repeated.select(F.struct("doc_id", "text_hash").alias("again")), F.col("row").eqNullSafe(F.col("again")), "left_semi")
    return _without(kept, repeated).union(twice.dropDuplicates(["row"]).select(docs.columns))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return _without(docs, decontamination.leaks(docs, table(spark, sf_dir, "benchmark")))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document that is left."""
    return segment_documents(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each_group), ("decontamination", keep_clean), ("segmentation", segment)]

#: SQL can't express the classifier, the latent search or the sampling; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
