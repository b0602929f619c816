"""Bloom filter, Flajolet-Martin distinct count, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BLOOM, FM, PRIME_BLOOM, permuted, trailing_zeros


def bloom_positions(key: Column, buckets: int, constants=BLOOM) -> Column:
    """Array of (row, pos): where each hash row has its bit for a BIGINT key below 2^31."""
    return F.array(*(F.struct(F.lit(i).alias("row"), permuted(key.cast("bigint"), a, b, PRIME_BLOOM, buckets).alias("pos")) for i, (a, b) in enumerate(constants)))


def bloom_build(df: DataFrame, key: str, buckets: int = 250_000, constants=BLOOM) -> DataFrame:
    """row, pos of every set bit."""
    return df.where(F.col(key).isNotNull()).select(F.explode(bloom_positions(F.col(key), buckets, constants)).alias("b")).select("b.row", "b.pos").distinct()


def bloom_probe(bits: DataFrame, df: DataFrame, key: str, buckets: int = 250_000, constants=BLOOM) -> DataFrame:
    """key, hit of every distinct key of df: whether all its bits are set."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    spots = keys.select("key", F.explode(bloom_positions(F.col("key"), buckets, constants)).alias("b")).select("key", "b.row", "b.pos")
    found = spots.join(bits.withColumn("_set", F.lit(1)), ["row", "pos"], "left")
    return found.groupBy("key").agg((F.count("_set") == len(constants)).alias("hit"))


def fm_columns(key: Column, groups: int = 3, per_group: int = 7, constants=FM) -> tuple[list[Column], Column]:
    """(an aggregate for each hash: its largest trailing-zero count, named r0 ...; the estimate from those columns)."""
    largest = [F.max(trailing_zeros((F.lit(a).cast("bigint") * key.cast("bigint") + F.lit(b).cast("bigint")) % F.lit(2**32))).alias(f"r{i}") for i, (a, b) in enumerate(constants[: groups * per_group])]
    power = lambda i: F.pow(F.lit(2.0), F.col(f"r{i}"))
    means = [sum((power(g * per_group + i) for i in range(1, per_group)), power(g * per_group)) / per_group for g in range(groups)]
    return largest, F.sort_array(F.array(*means))[groups // 2]


def fm_distinct(df: DataFrame, key: str, groups: int = 3, per_group: int = 7) -> DataFrame:
    """One row: estimate (median of the groups' means of 2^R) and truth."""
    largest, estimate = fm_columns(F.col(key), groups, per_group)
    return df.where(F.col(key).isNotNull()).agg(*largest, F.count_distinct(key).alias("truth")).select(estimate.alias("estimate"), "truth")


def fm_windowed(df: DataFrame, ts: str, key: str, window: str = "30 hours", slide: str = "5 hours", groups: int = 3, per_group: int = 7) -> DataFrame:
    """window_start, window_end, estimate, truth of each sliding window; works on a stream as well (with a watermark)."""
    largest, estimate = fm_columns(F.col(key), groups, per_group)
    truth = F.size(F.collect_set(key)).cast("long").alias("truth") if df.isStreaming else F.count_distinct(key).alias("truth")
    rows = df.where(F.col(key).isNotNull()).groupBy(F.window(ts, window, slide)).agg(*largest, truth)
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), estimate.alias("estimate"), "truth")


def bottom_k_sample(df: DataFrame, id_col: str, tag: str, size: int = 100) -> DataFrame:
    """id, tag: a uniform sample of ``size`` rows, those whose hashed id is smallest. The batch twin of a reservoir."""
    rank = F.md5(F.col(id_col).cast("string"))
    return df.where(F.col(tag).isNotNull()).select(F.col(id_col).alias("id"), F.col(tag).alias("tag"), rank.alias("_r")).orderBy("_r", "id").limit(size).select("id", "tag")


def tag_frequency(sample: DataFrame, tag: str = "tag") -> DataFrame:
    """tag, freq; a report orders by freq descending, then tag."""
    return sample.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("freq"))
