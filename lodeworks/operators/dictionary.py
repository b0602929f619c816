"""Dense numbering of ids without a global single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def id_dictionary(df: DataFrame, id_col: str) -> DataFrame:
    """id, code: the distinct ids, numbered from 0 in their order.

    Ids are range-partitioned and numbered within partitions; the partitions' offsets, one row for each, are added.
    """
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    ranged = cut(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.select("id", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return ranged.join(F.broadcast(offsets), "_p").select("id", (F.col("_i") + F.col("_o")).alias("code"))
