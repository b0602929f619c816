"""Connected components of a link table: forests within tasks, then DataFrame rounds until one task can finish."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, tidy

#: Links that a task contracts at a time, and of which a single task makes the components: 16 MB of them.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of the nodes of the links a-b that are not the least of their component among these links."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(len(names)))
    return names[label[node]], names[node]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield out()
            held = []
    if held:
        yield out()


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        root, node = forest(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        roots = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots]), pa.int64()), pa.array(np.concatenate([root, roots]), pa.int64())], ["id", "label"])


def components(links: DataFrame, finish: int = CHUNK) -> tuple[DataFrame, int]:
    """id, label (the least id reachable) of every id in links (a, b), and how many ids there are at most.

    Tasks contract the links they have. While more than ``finish`` are left, those that share a larger end meet and are
    contracted again, until each node has one parent, a smaller node; then parents are replaced by their parents until
    none has one. Contracting first turns the links of a node with many of them into links of its neighbours, so no such
    node gathers in a task. ``finish`` links or fewer go to one task at once. Each round is written to the shared folder.
    Links with a null end are none.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = links.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found, n = counted(found.mapInArrow(tidy(_forests), "a long, b long"))
    while n > finish:
        found, n = counted(found.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(tidy(_forests), "a long, b long"))
        if n <= finish:
            break
        parent = cut(found.groupBy("b").agg(F.min("a").alias("a"), F.count("*").alias("n")))
        if parent.where("n > 1").isEmpty():
            return _roots(parent.select("b", "a")), 2 * n
    return cut(found.coalesce(1).mapInArrow(tidy(_labels), "id long, label long")), 2 * n


def _roots(parent: DataFrame) -> DataFrame:
    """id, label from b, a: each node's one parent."""
    while True:
        up = parent.select(F.col("b").alias("a"), F.col("a").alias("up"))
        jumped = cut(parent.join(up, "a", "left"))
        if jumped.where("up is not null").isEmpty():
            break
        parent = jumped.select("b", F.coalesce("up", "a").alias("a"))
    return parent.select(F.col("b").alias("id"), F.col("a").alias("label")).union(parent.select("a", F.col("a").alias("label")).distinct())
