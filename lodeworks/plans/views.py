"""Inputs of the registered queries, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.readers import table


def sold(spark: SparkSession, d: str) -> DataFrame:
    """order_id, brand of each line item."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("order_id"), F.col("p_brand").alias("brand"))


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """order_id, brand: what is bought together."""
    return sold(spark, d).distinct()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("item_id"), "value")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type != 'purchase'").select("user_id", "item_id", F.col("value").alias("stars"))


def test_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'purchase'").select("user_id", "item_id").distinct()


def purchase_days(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'purchase'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(tokens(F.lower("text")))
    return table(spark, d, "documents").select("doc_id", F.explode(words).alias("token"))


def doc_sets(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(entity, tokens of doc_words as an array, perhaps repeated; rows of documents)."""
    docs = table(spark, d, "documents")
    sets = docs.select(F.col("doc_id").alias("entity"), tokens(F.lower("text")).alias("tokens"))
    rows, ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return sets if ids == rows else sets.groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")), rows


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select((F.col("doc_id") % 37).alias("user_id"), F.col("source").alias("business_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
