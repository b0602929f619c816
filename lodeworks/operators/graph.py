"""Graphs as edge tables: builders, label propagation, components, betweenness, Girvan-Newman."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import tiles
from .similarity import coded_sets, common_counts, jaccard_pairs, memberships

#: Edge tables up to this many rows may be held by each task or by the driver; larger ones go through joins.
LOCAL_EDGES = 200_000
#: Beyond every place of a row in blocks.
PLACES = (1 << 42) - 1


def cooccurrence_edges(df: DataFrame, basket: str, member: str, threshold: int) -> DataFrame:
    """src, dst, weight, both directions, of members that share at least ``threshold`` baskets."""
    pairs = common_counts(memberships(df, member, basket)).where(F.col("n_common") >= threshold)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n_common").alias("weight")).union(pairs.select("b", "a", "n_common"))


def jaccard_graph(df: DataFrame, user: str, item: str, threshold: float = 0.5) -> DataFrame:
    """src, dst, weight, both directions, of users whose item sets are similar."""
    pairs = jaccard_pairs(df, user, item, threshold)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sim").alias("weight")).union(pairs.select("b", "a", "sim"))


def bipartite_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """src, dst, both directions, of the distinct pairs."""
    pairs = df.select(F.col(left).cast("string").alias("src"), F.col(right).cast("string").alias("dst")).where("src is not null and dst is not null and src != dst").distinct()
    return pairs.union(pairs.select("dst", "src")).distinct()


def label_propagation(edges: DataFrame, max_iter: int = 5) -> DataFrame:
    """id, label after synchronous rounds: each vertex takes its neighbours' commonest label, the least of equals."""
    both = cut(edges.select("src", "dst").distinct())
    labels = cut(both.select(F.col("src").alias("id")).union(both.select("dst")).distinct().select("id", F.col("id").alias("label")))
    for _ in range(max_iter):
        votes = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        first = votes.withColumn("_k", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("n"), "label"))).where("_k = 1")
        heard = first.select(F.col("dst").alias("id"), F.col("label").alias("_new"))
        labels = cut(labels.join(heard, "id", "left").select("id", F.coalesce("_new", "label").alias("label")))
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """id, label (the component's least id), by least labels with pointer jumping."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels.toDF("dst", "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        new = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        new = cut(new.join(new.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", "old", F.least("label", "up").alias("label")))
        labels = new.select("id", "label")
        if new.where("label != old").isEmpty():
            return labels


def _user_blocks(df: DataFrame, user: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(Blocks of users' item sets; at, entity), places in the order of the users: the least place is the least user."""
    sets = coded_sets(df, user, item)
    blocks = tiles.pack_in_order(sets, df.select(user).distinct().count(), ["entity"])
    return blocks, tiles.rows_of(blocks, sets.schema["entity"].dataType.simpleString())


def _named(labels: DataFrame, names: DataFrame) -> DataFrame:
    """id, label of at, number."""
    return labels.join(names.toDF("at", "id"), "at").join(names.toDF("number", "label"), "number").select("id", "label")


def similar_communities(df: DataFrame, user: str, item: str, threshold: float, max_iter: int = 5) -> DataFrame:
    """label_propagation() on jaccard_graph(), whose edges are found again in each round instead of being written."""
    blocks, names = _user_blocks(df, user, item)

    def votes(pairs, first: bool) -> Iterator[pa.RecordBatch]:
        held = None
        for left, right, same, a, b in tiles.with_sets(pairs):
            if left is not held:
                if held is not None:
                    yield from told(held, found, count)
                held, found, count = left, np.zeros(0, np.int64), np.zeros(0, np.int64)
            ia, ib, _, _ = tiles.alike(a, b, same, threshold)
            if same:
                ia, ib = np.concatenate([ia, ib]), np.concatenate([ib, ia])
            at = right["_at" if first else "_more"].to_numpy()[ib]
            if first:  # all labels differ, so the least is heard
                least = np.full(a.n, PLACES)
                np.minimum.at(least, ia, at)
                ia = np.flatnonzero(least < PLACES)
                at = least[ia]
            own, n = np.unique((ia << 42) + at, return_counts=True)
            found, to = np.unique(np.concatenate([found, own]), return_inverse=True)
            count = np.bincount(to, np.concatenate([count, n]), len(found)).astype(np.int64)
        if held is not None:
            yield from told(held, found, count)

    def told(left: pa.Table, found: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"at": left["_at"].to_numpy()[found >> 42], "number": found & PLACES, "n": count})

    labels = names.select("at", F.col("at").alias("number"))
    for k in range(max_iter):
        own = blocks if not k else tiles.with_numbers(blocks, names.select("at").join(labels, "at", "left").select("at", F.coalesce("number", F.lit(PLACES)).alias("number")))
        heard = tiles.across(own, lambda pairs, first=not k: votes(pairs, first), "at long, number long, n long", ordered=True)
        if not k:
            labels = cut(heard.groupBy("at").agg(F.min("number").alias("number")))
        else:
            total = heard.groupBy("at", "number").agg(F.sum("n").alias("n"))
            labels = cut(total.groupBy("at").agg(F.min(F.struct(-F.col("n"), "number")).alias("_b")).select("at", F.col("_b.number").alias("number")))
    if not max_iter:
        raise ValueError("max_iter must be at least 1")
    return _named(labels, names)


def similar_components(df: DataFrame, user: str, item: str, threshold: float) -> DataFrame:
    """connected_components() of jaccard_graph(), whose edges are not written.

    First links within blocks and to the first block are contracted, to two for each user at most; then all pairs of blocks
    are searched for links between users that those leave apart.
    """
    blocks, names = _user_blocks(df, user, item)

    def stars(pairs) -> Iterator[pa.RecordBatch]:
        for left, right, same, a, b in tiles.with_sets(pairs):
            ia, ib, _, _ = tiles.alike(a, b, same, threshold)
            x, y = (t["_more" if "_more" in t.column_names else "_at"].to_numpy() for t in (left, right))
            p, q = x[ia], y[ib]
            apart = p != q
            ends, to = np.unique(np.concatenate([p[apart], q[apart]]), return_inverse=True)
            p, q = np.split(to, 2)
            least = np.arange(len(ends))
            while len(p):
                new = least.copy()
                np.minimum.at(new, p, least[q])
                np.minimum.at(new, q, least[p])
                new = new[new]
                if (new == least).all():
                    break
                least = new
            own = np.flatnonzero(least != np.arange(len(ends)))
            yield pa.RecordBatch.from_pydict({"src": ends[own], "dst": ends[least[own]]})

    root = blocks.agg(F.min("i")).first()[0]
    links = cut(tiles.across(blocks, stars, "src long, dst long", only=(F.col("i") == F.col("j")) | (F.col("i") == F.lit(root))))
    known = connected_components(links).toDF("at", "number")
    numbers = names.select("at").join(known, "at", "left").select("at", F.coalesce("number", "at").alias("number"))
    more = tiles.across(tiles.with_numbers(blocks, numbers), stars, "src long, dst long").distinct()
    return _named(connected_components(links.union(more)).toDF("at", "number"), names)


def _credits(neighbours: dict, root) -> dict:
    """Edge credits of the shortest paths from a root: breadth first, then back from the leaves."""
    depth, paths, order, queue = {root: 0}, {root: 1.0}, [], deque([root])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in neighbours[v]:
            if w not in depth:
                depth[w], paths[w] = depth[v] + 1, 0.0
                queue.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
    credit, out = dict.fromkeys(order, 1.0), {}
    for w in reversed(order):
        for v in neighbours[w]:
            if depth[v] == depth[w] - 1:
                share = credit[w] * paths[v] / paths[w]
                out[(v, w) if v < w else (w, v)] = share
                credit[v] += share
    return out


def _neighbours(pairs) -> dict:
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return {v: sorted(ws) for v, ws in out.items()}


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """src, dst (src < dst), betweenness: shortest paths between all pairs of vertices that use the edge, in shares.

    Roots are dealt over the tasks, which hold the edges while they are at most LOCAL_EDGES; beyond that all roots'
    searches advance level by level in joins.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct())
    kind = both.schema["src"].dataType.simpleString()
    if both.count() > LOCAL_EDGES:
        return _betweenness_by_joins(both)
    neighbours = _neighbours([(r["src"], r["dst"]) for r in both.where("src < dst").collect()])
    shared = both.sparkSession.sparkContext.broadcast(neighbours)
    roots = both.select(F.col("src").alias("root")).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            total: dict = defaultdict(float)
            for root in p["root"]:
                for e, c in _credits(shared.value, root).items():
                    total[e] += c
            yield pd.DataFrame([(a, b, c) for (a, b), c in total.items()], columns=["src", "dst", "c"])

    credit = roots.repartition(max(8, both.sparkSession.sparkContext.defaultParallelism), "root").mapInPandas(run, f"src {kind}, dst {kind}, c double")
    return credit.groupBy("src", "dst").agg((F.sum("c") / 2).alias("betweenness"))


def _betweenness_by_joins(both: DataFrame) -> DataFrame:
    """Level-synchronous searches from all roots at once: frontiers and credits are tables of (root, vertex)."""
    seen = cut(both.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    depth = 0
    while True:
        step = seen.where(F.col("d") == depth).join(both, F.col("v") == F.col("src")).groupBy("root", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(seen.select("root", "v"), ["root", "v"], "left_anti").select("root", "v", F.lit(depth + 1).alias("d"), "paths"))
        if new.isEmpty():
            break
        seen, depth = cut(seen.union(new)), depth + 1
    credit = seen.select("root", "v", F.lit(1.0).alias("credit")).limit(0)
    out = None
    for d in range(depth, 0, -1):
        own = seen.where(F.col("d") == d).join(credit, ["root", "v"], "left").select("root", F.col("v").alias("w"), F.col("paths").alias("pw"), (F.coalesce("credit", F.lit(0.0)) + 1).alias("cw"))
        above = seen.where(F.col("d") == d - 1).select("root", "v", "paths")
        share = own.join(both, F.col("w") == F.col("src")).select("root", "w", "pw", "cw", F.col("dst").alias("v")).join(above, ["root", "v"])
        share = cut(share.select("root", "v", "w", (F.col("cw") * F.col("paths") / F.col("pw")).alias("c")))
        credit = cut(share.groupBy("root", "v").agg(F.sum("c").alias("credit")))
        level = share.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"), "c")
        out = level if out is None else out.union(level)
    if out is None:
        return both.select("src", "dst", F.lit(0.0).alias("betweenness")).limit(0)
    return out.groupBy("src", "dst").agg((F.sum("c") / 2).alias("betweenness"))


def _groups(vertices: list, pairs: set) -> dict:
    neighbours, label = _neighbours(pairs), {}
    for v in vertices:
        if v not in label:
            queue = deque([v])
            label[v] = v
            while queue:
                for w in neighbours.get(queue.popleft(), ()):
                    if w not in label:
                        label[w] = v
                        queue.append(w)
    return label


def modularity(label: dict, pairs: set, original: set, variant: str = "textbook", base: int = 2, cuts: dict | None = None) -> float:
    """Modularity of a partition.

    textbook: on the original graph. residual: on the remaining edges, with degrees that start at twice the original
    ones and lose one for each edge that is cut, summed over pairs i < j.
    """
    if variant == "textbook":
        m = len(original)
        degree = defaultdict(int)
        for a, b in original:
            degree[a] += 1
            degree[b] += 1
        inside, total = defaultdict(int), defaultdict(int)
        for a, b in original:
            inside[label[a]] += label[a] == label[b]
        for v, g in label.items():
            total[g] += degree[v]
        return sum(inside[g] / m - (total[g] / (2 * m)) ** 2 for g in total)
    if variant != "residual":
        raise ValueError(f"variant must be textbook or residual, not {variant!r}")
    m = len(pairs)
    if not m:
        return float("-inf")
    degree = defaultdict(int)
    for a, b in original:
        degree[a] += 2
        degree[b] += 2
    for v, n in (cuts or {}).items():
        degree[v] -= n
    groups = defaultdict(list)
    for v, g in label.items():
        groups[g].append(v)
    links = sum(label[a] == label[b] for a, b in pairs)
    expected = 0.0
    for vs in groups.values():
        s, q = sum(degree[v] for v in vs), sum(degree[v] ** 2 for v in vs)
        expected += (s * s - q) / 2 / (base * m)
    return (links - expected) / (2 * m)


def girvan_newman(edges: DataFrame, max_iter: int = 50, variant: str = "textbook", base: int = 2, tie: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """(id, community; iteration, edges_left, n_components, q): the partition with the best modularity.

    Each iteration cuts all edges whose betweenness is within ``tie`` of the largest. Without edges all vertices are
    communities of their own. The edge list is held by the driver while it is at most LOCAL_EDGES, with betweenness
    computed there for up to a few hundred vertices and in tasks beyond; larger graphs raise ValueError.
    """
    spark = edges.sparkSession
    own = edges.select("src", "dst").where("src != dst")
    if own.count() > LOCAL_EDGES:
        raise ValueError("Girvan-Newman takes a round over all roots for each cut; reduce the graph first")
    kind = own.schema["src"].dataType.simpleString()
    original = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in own.distinct().collect()}
    vertices = sorted({v for e in original for v in e})
    pairs, cuts, log = set(original), defaultdict(int), []
    best, best_q = {v: v for v in vertices}, float("-inf")
    for i in range(1, max_iter + 1):
        if not pairs:
            break
        if len(vertices) <= 400:
            total: dict = defaultdict(float)
            neighbours = _neighbours(pairs)
            for root in sorted(neighbours):
                for e, c in _credits(neighbours, root).items():
                    total[e] += c
            score = {e: c / 2 for e, c in total.items()}
        else:
            rest = spark.createDataFrame(sorted(pairs), f"src {kind}, dst {kind}")
            score = {(r["src"], r["dst"]): r["betweenness"] for r in edge_betweenness(rest).collect()}
        top = max(score.values())
        for e in [e for e, c in score.items() if c >= top - tie]:
            pairs.remove(e)
            for v in e:
                cuts[v] += 1
        label = _groups(vertices, pairs)
        q = modularity(label, pairs, original, variant, base, cuts)
        log.append((i, len(pairs), len(set(label.values())), None if q == float("-inf") else q))
        if q > best_q:
            best, best_q = label, q
    return spark.createDataFrame(sorted(best.items()), f"id {kind}, community {kind}"), spark.createDataFrame(log, "iteration int, edges_left int, n_components int, q double")
