"""Streaming forms: sliding distinct counts, a reservoir, and running frequencies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sketches import fm_windowed


def fm_stream(events: DataFrame, ts: str, key: str, window: str = "30 seconds", slide: str = "5 seconds", late: str = "5 seconds") -> DataFrame:
    """fm_windowed on a stream; windows are final once the watermark has passed them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return fm_windowed(timed, ts, key, window, slide)


def reservoir_stream(tags: DataFrame, id_col: str, tag: str, size: int = 100, shards: int = 1) -> DataFrame:
    """shard, seen, tags (array of the sample so far), updated with each micro-batch: a uniform sample of a stream.

    A tag's place is decided by the hash of its id: the ``size`` smallest stay. That is a uniform sample without a draw
    of the order in which tags arrive, so restarts and retries give the same one. With several shards each keeps its own
    ``size``; the overall sample is the ``size`` smallest of theirs.
    """
    keyed = tags.where(F.col(tag).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).cast("string").alias("id"), F.col(tag).cast("string").alias("tag"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = (state.get[0], list(zip(state.get[1], state.get[2], strict=True))) if state.exists else (0, [])
        for p in parts:
            seen += len(p)
            held += [(hashlib.md5(i.encode()).hexdigest() + ":" + i, t) for i, t in zip(p["id"], p["tag"], strict=True)]
            held = sorted(held)[:size]
        state.update((seen, [h for h, _ in held], [t for _, t in held]))
        yield pd.DataFrame({"shard": [key[0]], "seen": [seen], "tags": [[t for _, t in held]]})

    return keyed.groupBy("shard").applyInPandasWithState(update, "shard int, seen long, tags array<string>", "seen long, ranks array<string>, tags array<string>", "update", GroupStateTimeout.NoTimeout)


def running_frequency(tags: DataFrame, tag: str) -> DataFrame:
    """tag, freq over all of the stream; for complete or update mode."""
    return tags.where(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("freq"))


def append_report(stream: DataFrame, path: str, checkpoint: str, order: list | None = None):
    """Starts a query that appends each micro-batch's rows to a parquet folder, all available data at once."""

    def write(df: DataFrame, _: int) -> None:
        (df.orderBy(*order) if order else df).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tag_report(reservoir: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends a report to a text folder for each micro-batch of reservoir_stream(): how many tags came
    so far, then the sample's tags by frequency, descending, and name. The reservoir has one shard."""

    def write(df: DataFrame, _: int) -> None:
        seen = df.select(F.lit(0).alias("k"), F.lit("").alias("tag"), F.concat(F.lit("Tags from the beginning: "), F.col("seen")).alias("value"))
        freq = df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).select((-F.col("n")).alias("k"), "tag", F.concat_ws(" : ", "tag", "n").alias("value"))
        end = df.select(F.lit(1).alias("k"), F.lit("").alias("tag"), F.lit("").alias("value"))
        rows = seen.select(F.lit(0).alias("part"), "*").union(freq.select(F.lit(1), "*")).union(end.select(F.lit(2), "*"))
        rows.orderBy("part", "k", "tag").select("value").coalesce(1).write.mode("append").text(path)  # a sample's rows

    return reservoir.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
