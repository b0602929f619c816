"""A training-data pipeline over ``documents``: quality, line dedup, near dedup, decontamination, packing.

Each stage reads what its predecessor kept. run() writes every stage's result to the shared folder and reads it again.

Every stage but the last returns the columns of documents and ignores others, whatever their names. Repeated rows are
judged alike and all stay or all go; ties are decided by the smaller doc_id. Rows with a null doc_id have no duplicates
and are judged by their text alone. Null and empty texts have the labelled documents' share of good ones as their score;
they have no lines, words or windows, so the later stages keep them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import bin_slack, hyperminhash, line_edit, quality_knn, winnowing
from lodeworks.llm.common import Scratch, held_out, table
from lodeworks.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the labelled documents outside the held-out fold."""
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return quality_knn.score(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that earlier documents have; a document whose lines all have gone goes itself."""
    out = line_edit.deduplicate(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_words_left") > 0))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates."""
    docs = docs.select(*COLUMNS)
    kept = hyperminhash.near_duplicates(docs, size=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of words from a benchmark item."""
    docs = docs.select(*COLUMNS)
    hit = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_id"))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return bin_slack.pack_documents(docs.select(*COLUMNS), tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The classifier and the packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    out = STAGES[-1][1](spark, docs, sf_dir)  # has its pieces in a checkpoint of its own by now
    scratch.drop()
    return out
