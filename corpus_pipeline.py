"""From raw documents to a tokenized training mixture: five stages, one of the operators each.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are written as Parquet and read again, so a lost executor costs one
stage's tasks. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm import line_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from cortexloom.llm._text import free_name, table
from cortexloom.plans.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate lines stay once in the whole corpus; a document left without a word goes."""
    left = line_dedup.dedup_lines(docs)
    return left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest by doc_id (null ids last), then text hash; of rows equal in both, one."""
    scratch, row = Scratch(spark, "groups"), line_dedup.row_hash(F.col("text"))
    found = scratch.save(simhash.grouped_rows(docs, row))
    keys = scratch.save(found.groupBy("root", "doc_id", "row").agg(F.count("*").alias("n")))
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k"))
    first = scratch.save(first.select("root", F.col("k.doc_id").alias("kd"), F.col("k.row").alias("kr")))
    mark, t = free_name(docs, "_gone"), free_name(docs, "_text_hash")
    gone = keys.join(first, "root").where("not (doc_id <=> kd and row = kr)").select(F.col("doc_id").alias(mark), F.col("row").alias(t))
    gone = scratch.save(gone)
    gone = F.broadcast(gone) if gone.count() <= line_dedup.BROADCAST_ROWS else gone
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(mark)) & (line_dedup.row_hash(docs["text"]) == F.col(t)), "left_anti")
    again = keys.where("n > 1").join(first, "root").where("doc_id <=> kd and row = kr")
    if again.isEmpty():
        return kept
    return kept.withColumn(t, row).dropDuplicates(["doc_id", t]).drop(t)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources replicated to their target weights, in a global shuffle."""
    return mixing.mix(docs, mixing.WEIGHTS, other=mixing.OTHER, seed=mixing.SEED).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip): the token ids, and whether they decode to the text."""
    encoded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), sentencepiece_codec.model_bytes(), round_trip_col="round_trip")
    return encoded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("SentencePiece", tokens),
]

#: Fuzzy lines and SimHash groups have no SQL: tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
