"""A stream's result is the batch result."""

from pyspark.sql import functions as F

from lodeworks.operators.sketches import bottom_k_sample, fm_windowed
from lodeworks.streaming import streams


def events(spark, path, n=300):
    df = spark.range(n).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3).alias("ts"), (F.col("id") % 17).alias("k"), F.concat(F.lit("t"), F.col("id") % 5).alias("tag"))
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    query = streams.fm_stream(stream, "ts", "k", late="1 hour").writeStream.format("memory").queryName("fm").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("fm").collect()}
    assert got == {tuple(r) for r in fm_windowed(batch, "ts", "k", "30 seconds", "5 seconds").collect()}


def test_reservoir(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    query = streams.reservoir_stream(stream, "id", "tag", 20).writeStream.format("memory").queryName("res").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(spark.table("res").collect(), key=lambda r: r["seen"])
    assert last["seen"] == 300
    assert sorted(last["tags"]) == sorted(r["tag"] for r in bottom_k_sample(batch, "id", "tag", 20).collect())


def test_append(spark, tmp_path):
    _, stream = events(spark, str(tmp_path / "in"))
    streams.append_report(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300


def test_running_frequency(spark, tmp_path):
    _, stream = events(spark, str(tmp_path / "in"))
    query = streams.running_frequency(stream, "tag").writeStream.format("memory").queryName("freq").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["freq"] for r in spark.table("freq").collect()} == {60}
