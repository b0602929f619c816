"""k-means and BFR clustering on array<double> vectors.

Assignments and sums run in numpy on Arrow batches against the centroids, of which there are few; what leaves a task are
counts and sums by cluster, so no points are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut

#: Points of a block.
POINTS = 4096


def points(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, vec (array<double>) of the rows with both."""
    return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")


def _nearest(x: np.ndarray, centres: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, squared distance); ties go to the lowest index. scale: variances by centre."""
    d = np.stack([((x - c) ** 2 / (1.0 if scale is None else scale[j])).sum(1) for j, c in enumerate(centres)], 1)
    k = d.argmin(1)
    return k, d[np.arange(len(x)), k]


def _nearest_fast(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """_nearest()'s index, by a matrix product; points whose two nearest centres are too close to tell by it are taken again."""
    if len(centres) < 2 or not len(x):
        return np.zeros(len(x), np.int64)
    # ranks by |c|^2 - 2 x.c, about the centres' middle: what all centres share of a distance is left out
    middle = centres.mean(0)
    x0, c0 = x - middle, centres - middle
    d = (c0**2).sum(1) - 2 * (x0 @ c0.T)
    k = d.argmin(1)
    rows = np.arange(len(x))
    least = d[rows, k]
    d[rows, k] = np.inf
    scale = (x0**2).sum(1) + (c0**2).sum(1).max()
    unsure = ~(d.min(1) - least > 1e-9 * scale)
    if unsure.any():
        k[unsure] = _nearest(x[unsure], centres)[0]
    return k


def _blocks(pts: DataFrame) -> DataFrame:
    """n, d, x (bytes), ids: points, some thousands a row, so that rounds read arrays as they are; written once.

    Vectors of another length than their neighbours are in a row of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(size)]]) if len(size) else np.zeros(1, np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for at in range(lo, hi, POINTS):
                    end = min(hi, at + POINTS)
                    yield pa.RecordBatch.from_pydict({"n": pa.array([end - at], pa.int32()), "d": pa.array([size[at]], pa.int32()), "x": pa.array([flat[start[at] : start[end]].tobytes()], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), b.column("id").slice(at, end - at))})

    return cut(pts.select("id", "vec").mapInArrow(run, f"n int, d int, x binary, ids array<{pts.schema['id'].dataType.simpleString()}>"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array | None]]:
    """(vectors, ids if they were selected) of _blocks()."""
    for b in batches:
        for r in range(b.num_rows):
            n, d, x = (b.column(k)[r] for k in range(3))
            yield np.frombuffer(x.as_buffer(), np.float64).reshape(n.as_py(), d.as_py()), b.column(3)[r].values if b.num_columns > 3 else None


def assign(pts: DataFrame, centres: np.ndarray, variances: np.ndarray | None = None) -> DataFrame:
    """id, vec, cluster (index of the nearest centre), dist (Euclidean, or Mahalanobis with diagonal variances)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                k, d = _nearest(np.stack(p["vec"].to_numpy()), centres, variances)
                yield p.assign(cluster=k.astype("int32"), dist=np.sqrt(d))

    return pts.mapInPandas(run, f"id {pts.schema['id'].dataType.simpleString()}, vec array<double>, cluster int, dist double")


def _assigned(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster, dist of the points of _blocks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _arrays(batches):
            k, d = _nearest(x, centres)
            yield pa.RecordBatch.from_arrays([ids, pa.array(k.astype(np.int32)), pa.array(np.sqrt(d))], names=["id", "cluster", "dist"])

    return blocks.mapInArrow(run, f"id {blocks.schema['ids'].dataType.elementType.simpleString()}, cluster int, dist double")


def statistics(assigned: DataFrame) -> DataFrame:
    """cluster, n, mean, meansq (arrays): what merges of a cluster's points. Tasks sum arrays, a row for each cluster they have."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for p in parts:
            if len(p):
                x, c = np.stack(p["vec"].to_numpy()), p["cluster"].to_numpy()
                for k in np.unique(c):
                    own = x[c == k]
                    n, m, q = sums.get(k, (0, 0.0, 0.0))
                    sums[k] = (n + len(own), m + own.sum(0), q + (own**2).sum(0))
        yield pd.DataFrame([(k, n, m.tolist(), q.tolist()) for k, (n, m, q) in sums.items()], columns=["cluster", "n", "m", "q"])

    kind = assigned.schema["cluster"].dataType.simpleString()
    rows = assigned.select("cluster", "vec").where("cluster is not null").mapInPandas(run, f"cluster {kind}, n long, m array<double>, q array<double>")
    added = lambda c: F.aggregate(F.collect_list(c), F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda u, v: u + v)))
    rows = rows.groupBy("cluster").agg(F.sum("n").alias("n"), added("m").alias("m"), added("q").alias("q"))
    return rows.select("cluster", "n", F.transform("m", lambda x: x / F.col("n")).alias("mean"), F.transform("q", lambda x: x / F.col("n")).alias("meansq"))


def variance(mean: np.ndarray, meansq: np.ndarray) -> np.ndarray:
    return np.maximum(meansq - mean**2, 1e-9)


def _starts(x: np.ndarray, k: int) -> list[int]:
    """The places of initial_centres() among points sorted by id."""
    picked, free = [0], np.ones(len(x), bool)
    free[0] = False
    while len(picked) < min(k, len(x)):
        far = int(((x - x[picked[-1]]) ** 2).sum(1).argmax())
        far = far if free[far] else int(free.argmax())
        free[far] = False
        picked.append(far)
    return picked


def initial_centres(pts: DataFrame, k: int, one_task: int = 8_000_000, blocks: DataFrame | None = None) -> np.ndarray:
    """The lowest id, then each time the point farthest from the last centre, or the lowest unused id if that is used.

    While the points have at most one_task numbers, one task finds all; else there is a job for each centre, in which a
    task sends its farthest point and its lowest unused id. Both pick the same.
    """
    kind = pts.schema["id"].dataType.simpleString()
    size = pts.agg(F.sum(F.size("vec"))).first()[0] or 0
    if size <= one_task:

        def every(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [p for p in parts if len(p)]
            if held:
                own = pd.concat(held).sort_values("id", kind="stable")
                picked = _starts(np.stack(own["vec"].to_numpy()), k)
                yield pd.DataFrame({"n": range(len(picked)), "vec": [own["vec"].iloc[i] for i in picked]})

        rows = sorted(pts.select("id", "vec").coalesce(1).mapInPandas(every, "n int, vec array<double>").collect())
        return np.array([r["vec"] for r in rows]) if rows else np.zeros((0, 0))
    used: list = []
    centres: list[np.ndarray] = []
    id_type = to_arrow_type(pts.schema["id"].dataType)

    blocks = _blocks(pts) if blocks is None else blocks

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, low = None, None
        for x, ids in _arrays(batches):
            free = ids.filter(pc.invert(pc.is_in(ids, value_set=pa.array(used, ids.type))))
            least = pc.min(free).as_py()
            if least is not None and (low is None or least < low[0]):
                low = (least, x[pc.index(ids, least).as_py()])
            if centres:
                d = ((x - centres[-1]) ** 2).sum(1)
                at = np.flatnonzero(d == d.max())
                own = min((ids[int(i)].as_py(), int(i)) for i in at) if len(at) else None
                if own is not None and (far is None or (-d.max(), own[0]) < far[:2]):
                    far = (-d.max(), own[0], x[own[1]])
        rows = ([(0, *far)] if far else []) + ([(1, 0.0, *low)] if low else [])
        what, d, own, vec = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(d, pa.float64()), pa.array(own, id_type), pa.array([v.tolist() for v in vec], pa.list_(pa.float64()))], names=["what", "d", "id", "vec"])

    while len(centres) < k:
        found = sorted(((r["what"], r["d"], r["id"], r["vec"]) for r in blocks.mapInArrow(search, f"what int, d double, id {kind}, vec array<double>").collect()), key=lambda r: r[:3])
        pick = next((r for r in found if r[0] == 0), None)
        if pick is None or pick[2] in used:
            pick = next((r for r in found if r[0] == 1), None)
        if pick is None:
            break
        used.append(pick[2])
        centres.append(np.array(pick[3]))
    return np.stack(centres) if centres else np.zeros((0, 0))


def random_membership(pts: DataFrame, k: int) -> DataFrame:
    """id, vec, cluster: a start by hashed membership."""
    return pts.withColumn("cluster", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))


def _round(blocks: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> tuple[dict[int, tuple[int, np.ndarray]], int]:
    """(cluster -> points and their mean, points in another cluster than with the centres before) in one job over _blocks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, changed = np.zeros(len(centres), np.int64), np.zeros(centres.shape), 0
        for x, _ in _arrays(batches):
            c = _nearest_fast(x, centres)
            changed += len(x) if before is None else int((c != _nearest_fast(x, before)).sum())
            n += np.bincount(c, minlength=len(centres))
            one = np.zeros((len(centres), len(x)))
            one[c, np.arange(len(x))] = 1.0
            total += one @ x
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([-1, *own], pa.int32()), "n": pa.array([changed, *n[own]], pa.int64()), "total": pa.array([[], *total[own].tolist()], pa.list_(pa.float64()))})

    sums, changed = {}, 0
    for r in blocks.select("n", "d", "x").mapInArrow(run, "cluster int, n long, total array<double>").collect():  # k + 1 rows a task
        if r["cluster"] < 0:
            changed += r["n"]
        else:
            n, total = sums.get(r["cluster"], (0, 0.0))
            sums[r["cluster"]] = (n + r["n"], total + np.array(r["total"]))
    return {c: (n, total / n) for c, (n, total) in sums.items()}, changed


def kmeans(df: DataFrame, id_col: str, vec: str, k: int, max_iter: int = 1000, tol: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, dist; centres) by Lloyd rounds until at most ``tol`` points change. An empty cluster keeps its centre.

    A round is one job without a shuffle: tasks send counts and sums by cluster.
    """
    pts = points(df, id_col, vec)
    blocks = _blocks(pts)
    centres, before, used = initial_centres(pts, k, blocks=blocks), None, None
    if not len(centres):
        return pts.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("dist")), centres
    for _ in range(max_iter):
        used = centres.copy()
        means, changed = _round(blocks, used, before)
        for c, (_, mean) in means.items():
            centres[c] = mean
        if before is not None and changed <= tol:
            break
        before = used
    return cut(_assigned(blocks, used if used is not None else centres)), centres


def merge_statistics(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(p[0] for p in parts)
    return n, sum(p[0] * p[1] for p in parts) / n, sum(p[0] * p[2] for p in parts) / n


def bfr(df: DataFrame, id_col: str, vec: str, chunk: str, k: int, radius: float = 2.0, max_iter: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(id, cluster; round log) by BFR, chunk by chunk in the order of ``chunk``.

    The first chunk is clustered 5k-fold; its clusters of fewer than 4 points are retained, the rest is clustered k-fold
    into the discard set. A later chunk's points are scored against the statistics at its start: within radius * sqrt(d)
    of the nearest discard cluster, else of the nearest compression cluster, else retained. Retained points are then
    clustered min(5k, n)-fold; clusters of more than one point join the compression set, whose clusters merge while two
    are within the radius of each other. At the end compression clusters and retained points go to the nearest discard
    cluster. Points are never gathered: discard and compression sets are statistics, memberships are tables.
    """
    spark = df.sparkSession
    own = cut(df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"), F.col(chunk).alias("chunk")).where("id is not null and vec is not null and chunk is not null"))
    chunks = [r["chunk"] for r in own.select("chunk").distinct().orderBy("chunk").collect()]
    ds: list[tuple[int, np.ndarray, np.ndarray]] = []
    cs: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    parent: dict[int, int] = {}
    members: list[DataFrame] = []  # id, kind, cluster
    retained, log, next_cs = None, [], 0

    def stats(assigned: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        return {r["cluster"]: (r["n"], np.array(r["mean"]), np.array(r["meansq"])) for r in statistics(assigned).collect()}

    for i, c in enumerate(chunks):
        pts = cut(own.where(F.col("chunk") == c).select("id", "vec"))
        if i == 0:
            fine, _ = kmeans(pts, "id", "vec", 5 * k, max_iter)
            small = fine.groupBy("cluster").agg(F.count("*").alias("n")).where("n < 4").select("cluster")
            outlier = cut(fine.join(small, "cluster", "left_semi").select("id"))
            retained = cut(pts.join(outlier, "id", "left_semi"))
            body = cut(pts.join(outlier, "id", "left_anti"))
            coarse, _ = kmeans(body, "id", "vec", k, max_iter)
            coarse = cut(body.join(coarse.select("id", "cluster"), "id"))
            found = stats(coarse)
            order = {old: new for new, old in enumerate(sorted(found))}
            ds = [found[x] for x in sorted(found)]
            number = F.create_map(*(F.lit(x) for kv in order.items() for x in kv)) if order else None
            if order:
                members.append(coarse.select("id", F.lit("ds").alias("kind"), number[F.col("cluster")].alias("cluster")))
        else:
            rest = pts
            for kind in ("ds", "cs"):
                sets = dict(enumerate(ds)) if kind == "ds" else cs
                if not sets:
                    continue
                names = sorted(sets)
                centres = np.stack([sets[n][1] for n in names])
                scored = cut(assign(rest, centres, np.stack([variance(sets[n][1], sets[n][2]) for n in names])))
                gate = F.col("dist") <= radius * np.sqrt(centres.shape[1])
                hit = scored.where(gate).select("id", "vec", F.array(*(F.lit(n) for n in names))[F.col("cluster")].alias("cluster"))
                for n, s in stats(hit).items():
                    sets[n] = merge_statistics([sets[n], s])
                if kind == "ds":
                    ds = [sets[n] for n in names]
                members.append(hit.select("id", F.lit(kind).alias("kind"), "cluster"))
                rest = scored.where(~gate).select("id", "vec")
            retained = cut(retained.union(rest))
        n_retained = retained.count()
        if n_retained:
            groups, _ = kmeans(retained, "id", "vec", min(5 * k, n_retained), max_iter)
            groups = cut(retained.join(groups.select("id", "cluster"), "id"))
            goes_to = {}
            for old, s in sorted(stats(groups).items()):
                if s[0] > 1:
                    cs[next_cs], goes_to[old] = s, next_cs
                    next_cs += 1
            if goes_to:
                to = F.create_map(*(F.lit(x) for kv in goes_to.items() for x in kv))[F.col("cluster")]
                members.append(groups.select("id", F.lit("cs").alias("kind"), to.alias("cluster")).where("cluster is not null"))
            several = groups.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
            retained = cut(groups.join(several, "cluster", "left_anti").select("id", "vec"))
        merged = True
        while merged:
            merged, names = False, sorted(cs)
            for x, a in enumerate(names):
                for b in names[x + 1 :]:
                    d2 = (cs[a][1] - cs[b][1]) ** 2
                    reach = radius * np.sqrt(len(d2))
                    if min(np.sqrt((d2 / variance(*cs[a][1:])).sum()), np.sqrt((d2 / variance(*cs[b][1:])).sum())) <= reach:
                        cs[a] = merge_statistics([cs[a], cs[b]])
                        parent[b] = a
                        del cs[b]
                        merged = True
                        break
                if merged:
                    break
        log.append((i + 1, len(ds), int(sum(s[0] for s in ds)), len(cs), int(sum(s[0] for s in cs.values())), retained.count()))
    schema = "round int, ds_clusters int, ds_points long, cs_clusters int, cs_points long, rs_points long"
    if not ds:
        return own.select("id", F.lit(0).alias("cluster")), spark.createDataFrame(log, schema)
    centres, spread = np.stack([s[1] for s in ds]), np.stack([variance(s[1], s[2]) for s in ds])

    def root(n: int) -> int:
        while n in parent:
            n = parent[n]
        return n

    goes = {n: int(_nearest(cs[root(n)][1][None], centres, spread)[0][0]) for n in range(next_cs)}
    table = members[0]
    for m in members[1:]:
        table = table.union(m)
    if goes:
        number = F.create_map(*(F.lit(x) for kv in goes.items() for x in kv))
        table = table.select("id", F.when(F.col("kind") == "cs", number[F.col("cluster")]).otherwise(F.col("cluster")).alias("cluster"))
    else:
        table = table.select("id", "cluster")
    table = table.union(assign(retained, centres, spread).select("id", "cluster"))
    n = int(sum(s[0] for s in ds) + sum(s[0] for s in cs.values())) + log[-1][5]
    log[-1] = (len(chunks), len(ds), n, 0, 0, 0)
    return table, spark.createDataFrame(log, schema)
