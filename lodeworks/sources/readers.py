"""Readers for the engine's inputs, all with explicit schemas; rows with a null key are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
REVIEW = T.StructType([T.StructField("business_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("stars", T.DoubleType()), T.StructField("text", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_csv(spark: SparkSession, path: str, header: bool = True, trim: bool = True, pivot: bool = False) -> DataFrame:
    """Two-column CSV as (key, value), or (value, key) for the inverted pivot. Ids stay strings."""
    df = spark.read.csv(path, schema=PAIR, header=header, ignoreTrailingWhiteSpace=trim)
    df = df.where(F.col("key").isNotNull() & F.col("value").isNotNull())
    return df.select(F.col("value").alias("key"), F.col("key").alias("value")) if pivot else df


def reviews_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW).json(path).where(F.col("business_id").isNotNull() & F.col("user_id").isNotNull())


def matrix_csv(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Headerless CSV (id, x1 ... xd) as (id, vec, chunk); chunk is the file the row comes from."""
    schema = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(f"x{i}", T.DoubleType()) for i in range(dims)])
    df = spark.read.csv(path, schema=schema)
    return df.select("id", F.array(*(f"x{i}" for i in range(dims))).alias("vec"), F.col("_metadata.file_path").alias("chunk")).where(F.col("id").isNotNull())


def words_text(spark: SparkSession, path: str) -> DataFrame:
    """One word per line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word != ''")


def json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of JSON files replayed as a stream, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def tagged(statuses: DataFrame, text: str, lang: str, track: list[str], languages: list[str]) -> DataFrame:
    """Statuses (batch or stream) in one of the languages whose text mentions a tracked word."""
    pattern = "(?i)(" + "|".join(f"\\Q{x}\\E" for x in track) + ")"
    return statuses.where(F.col(text).rlike(pattern) & F.col(lang).isin(languages))


def sample_states(spark: SparkSession) -> DataFrame:
    """A small user-state table for examples and tests."""
    rows = [("u1", "OH"), ("u1", "NV"), ("u2", "OH"), ("u2", "AZ"), ("u3", "NV"), ("u3", "OH"), ("u4", "AZ"), ("u4", "NC"), ("u5", "NC")]
    return spark.createDataFrame(rows, PAIR)
