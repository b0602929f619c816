"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_slack, hyperminhash, license_rules, line_edit, line_quality, link_graph, quality_knn, recompress, toxic_cnn, winnowing
from .oracles import oracle_sql as oracle_sql
from .common import held_out, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_knn.train(docs, labels, ~held_out(F.col("doc_id")))
    scored = quality_knn.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_edit.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.licences(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judged(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    model = toxic_cnn.train(docs, labels, ~held_out(F.col("doc_id")))
    scored = toxic_cnn.score(docs, model)
    flag = F.col("score") >= toxic_cnn.threshold(model, F.col("lang"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), flag.alias("flagged_for_lang"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_lines": op3_lines,
        "op4_licences": op4_licences,
        "op5_decontamination": op5_decontamination,
        "op6_line_quality": op6_line_quality,
        "op7_substrings": op7_substrings,
        "op8_toxicity": op8_toxicity,
        "op9_urls": op9_urls,
        "op10_packing": op10_packing,
    }


