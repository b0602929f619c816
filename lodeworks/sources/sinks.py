"""Reports as text lines, and model folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(items: Column) -> Column:
    """('a', 'b') of an array; ('a') of one item."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """size, line: one line for each size, its sets in order, joined by commas."""
    sets = itemsets.groupBy("size").agg(F.array_sort(F.collect_list("items")).alias("sets"))
    return sets.select("size", F.array_join(F.transform("sets", quoted), ",").alias("line"))


def itemset_file(candidates: DataFrame, itemsets: DataFrame) -> DataFrame:
    """n, line of a whole report, to be ordered by n: the candidates' lines, then the frequent sets', each size a paragraph."""
    out = None
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", itemsets))):
        spark = sets.sparkSession
        head = spark.range(1).select(F.lit(k * 2_000_000).cast("long").alias("n"), F.lit(title).alias("line"))
        lines = itemset_report(sets).select((F.col("size") * 2 + k * 2_000_000).cast("long").alias("n"), "line")
        gaps = lines.select((F.col("n") + 1).alias("n"), F.lit("").alias("line"))
        part = head.union(lines).union(gaps)
        out = part if out is None else out.union(part)
    return out


def write_log(log: DataFrame, path: str, order: str = "round") -> None:
    """A round log, a row for each chunk, as CSV with a header."""
    log.orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def community_report(labels: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """n, line: a community a line, members quoted and sorted; to be ordered by n and line."""
    groups = labels.groupBy(label).agg(F.array_sort(F.collect_list(F.col(id_col).cast("string"))).alias("m"))
    return groups.select(F.size("m").alias("n"), F.concat(F.lit("'"), F.array_join("m", "', '"), F.lit("'")).alias("line"))


def betweenness_report(edges: DataFrame) -> DataFrame:
    return edges.select("betweenness", F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("betweenness")).alias("line"))


def flags_line(hits: DataFrame, order: str, hit: str = "hit") -> DataFrame:
    """One row: T or F for each probe in order, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.when(F.col(hit), "T").otherwise("F").alias("f"))))
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["f"]), " ").alias("line"))


def write_lines(df: DataFrame, path: str, *order: Column | str) -> None:
    df.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def point_map(labels: DataFrame, id_col: str = "id", cluster: str = "cluster") -> DataFrame:
    """id and cluster as JSON lines, sorted by id; a single JSON map would be one task's row."""
    return labels.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.create_map(F.col(id_col).cast("string"), F.col(cluster))).alias("line"))


def save_model(path: str, **tables: DataFrame) -> None:
    """A model folder: one parquet table for each part."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{name}") for name in names]
