"""Neighbourhood collaborative filtering: Pearson models and weighted-deviation predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .similarity import code, lsh_candidates, minhash_signature

#: Rows of a block that are correlated with another block at a time.
SLICE = 256


def clean_ratings(df: DataFrame) -> DataFrame:
    """user_id, item_id, stars: repeated ratings of an item by a user are averaged; rows with nulls are dropped."""
    return df.where("user_id is not null and item_id is not null and stars is not null").groupBy("user_id", "item_id").agg(F.avg("stars").alias("stars"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows of a group, with 1e-11 added to the denominator; 0 for constant sides."""
    return F.coalesce(F.regr_sxy(x, y) / (F.sqrt(F.regr_sxx(x, y)) * F.sqrt(F.regr_syy(x, y)) + F.lit(1e-11)), F.lit(0.0))


def _model(ratings: DataFrame, entity: str, by: str, min_common: int, candidates: DataFrame | None) -> DataFrame:
    often = ratings.groupBy(entity).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_common).select(entity)
    own = ratings.join(often, entity, "left_semi")
    x = own.select(F.col(entity).alias("a"), F.col(by).alias("by"), F.col("stars").alias("x"))
    y = own.select(F.col(entity).alias("b"), F.col(by).alias("by"), F.col("stars").alias("y"))
    pairs = x.join(y, "by").where("a < b")
    if candidates is not None:
        pairs = pairs.join(candidates, ["a", "b"], "left_semi")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(pearson(F.col("x"), F.col("y")), 6).alias("sim"))
    return out.where((F.col("n") >= min_common) & (F.col("sim") > 0))


def item_cf_model(ratings: DataFrame, min_corated: int = 3) -> DataFrame:
    """a, b, n, sim of item pairs (a < b) with at least min_corated common raters and a positive correlation."""
    return _model(clean_ratings(ratings), "item_id", "user_id", min_corated, None)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _profiles(own: DataFrame) -> DataFrame:
    """entity, codes, stars: each user's items as sorted numbers, and their stars."""
    rated = own.select(F.col("user_id").alias("entity"), F.struct(code("item_id", _kind(own, "item_id")).alias("c"), "stars").alias("_r"))
    rows = rated.groupBy("entity").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    return rows.select("entity", F.col("_r.c").alias("codes"), F.col("_r.stars").alias("stars"))


def _stars(table: pa.Table, s: tiles.Sets) -> np.ndarray:
    """Stars less the user's mean, which moves no correlation and keeps sums small."""
    x = table["stars"].combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False)
    return x - (np.bincount(s.row, x, s.n) / np.maximum(s.size, 1))[s.row]


def _exactly(a: tiles.Sets, b: tiles.Sets, x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Correlations of row pairs from their common items, with sums about the mean; 0 for constant sides."""
    out = np.zeros(len(ia))
    for part, pair, at, bt in tiles.matches(a, b, ia, ib):
        k, size = pair - part.start, part.stop - part.start
        n = np.maximum(np.bincount(k, minlength=size), 1)
        first = np.searchsorted(k, np.arange(size))
        first[first == len(k)] = 0
        sides = []
        for v in (x[at], y[bt]):
            v = v - v[first][k]  # exactly 0 for a constant side
            sides.append(v - (np.bincount(k, v, size) / n)[k])
        p, q = sides
        out[part] = np.bincount(k, p * q, size) / (np.sqrt(np.bincount(k, p * p, size)) * np.sqrt(np.bincount(k, q * q, size)) + 1e-11)
    return out


def _correlated(a: tiles.Sets, b: tiles.Sets, x: np.ndarray, y: np.ndarray, min_common: int, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, common items, correlation in millionths, rounded) of the pairs that a model keeps, slice by slice of a.

    Sums of all pairs are matrix products; those that cancel too far are taken again pair by pair. same: leave out a row with itself.
    """
    n = tiles.common(a, b)
    ka, kb = tiles.shared(a, b)
    dense = (n >= min_common).sum() * max(1.0, a.size.mean()) * 100 > len(ka) * a.n * b.n
    grids = []
    if dense:
        for at in range(0, len(ka), 1024):
            sides = []
            for s, v, k in ((a, x, ka[at : at + 1024]), (b, y, kb[at : at + 1024])):
                spot = s.by_name[tiles.expand(s.first[k], s.often[k])]
                where = (s.row[spot], np.repeat(np.arange(len(k)), s.often[k]), (s.n, len(k)))
                sides.append([tiles._grid(*where, w, np.float64) for w in (1.0, v[spot], v[spot] ** 2)])
            grids.append(sides)
    for lo in range(0, a.n, SLICE):
        own = n[lo : lo + SLICE]
        keep = own >= min_common
        if same:
            keep[np.arange(len(own)), lo + np.arange(len(own))] = False
        ia, ib = np.nonzero(keep)
        count = own[ia, ib].astype(np.int64)
        near = count >= threshold * (a.size[lo + ia] + b.size[ib] - count)
        ia, ib, count = ia[near], ib[near], count[near]
        if not len(ia):
            continue
        if dense:
            sums = [np.zeros(own.shape) for _ in range(5)]
            for (one, p, pp), (won, q, qq) in grids:
                for t, (u, v) in zip(sums, ((p, won), (one, q), (pp, won), (one, qq), (p, q)), strict=True):
                    t += u[lo : lo + SLICE] @ v.T
            sx, sy, sxx, syy, sxy = (t[ia, ib] for t in sums)
            vx, vy = sxx - sx * sx / count, syy - sy * sy / count
            unsure = (vx <= sxx * 1e-6) | (vy <= syy * 1e-6)
            r = (sxy - sx * sy / count) / (np.sqrt(np.maximum(vx, 0)) * np.sqrt(np.maximum(vy, 0)) + 1e-11)
            if unsure.any():
                r[unsure] = _exactly(a, b, x, y, lo + ia[unsure], ib[unsure])
        else:
            r = _exactly(a, b, x, y, lo + ia, ib)
        m = np.floor(r * 1e6 + 0.5).astype(np.int64)
        yield lo + ia[m > 0], ib[m > 0], count[m > 0], m[m > 0]


def user_cf_model(ratings: DataFrame, min_corated: int = 3, threshold: float = 0.01, candidates: str = "exact", rows: int = 1) -> DataFrame:
    """a, b, n, sim of user pairs (a < b); candidates are all pairs with a common item, or those of a banded MinHash.

    Pairs need min_corated common items and a Jaccard similarity of their item sets of at least threshold. All pairs are
    compared in blocks, without joining ratings by item.
    """
    if candidates not in ("exact", "lsh"):
        raise ValueError(f"candidates must be exact or lsh, not {candidates!r}")
    own = clean_ratings(ratings)
    if candidates == "lsh":
        sizes = own.groupBy("user_id").agg(F.count("*").alias("_s"))
        pairs = lsh_candidates(minhash_signature(own, "user_id", "item_id"), rows)
        model = _model(own, "user_id", "item_id", min_corated, pairs).join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b")
        return model.where(F.col("n") >= threshold * (F.col("sa") + F.col("sb") - F.col("n"))).select("a", "b", "n", "sim")
    kind = _kind(own, "user_id")
    blocks = tiles.pack(_profiles(own), ratings.select("user_id").distinct().count(), ["entity"])

    def kernel(pairs):
        for left, right, same, a, b in tiles.with_sets(pairs):
            for ia, ib, n, m in _correlated(a, b, _stars(left, a), _stars(right, b), min_corated, threshold, same):
                once = ia < ib if same else np.ones(len(ia), bool)
                yield tiles.named_pairs(left, right, ia[once], ib[once], n=n[once], sim=m[once] / 1e6)

    return tiles.across(blocks, kernel, f"a {kind}, b {kind}, n long, sim double")


def nearest_raters(ratings: DataFrame, test: DataFrame, k: int = 5, min_corated: int = 3, threshold: float = 0.01) -> DataFrame:
    """As top_neighbours() with the model of user_cf_model(), which is not written: a task keeps the best k for each pair of test."""
    own = clean_ratings(ratings)
    mean = own.groupBy("user_id").agg(F.round(F.avg("stars"), 9).alias("avg_nb"))
    asked = test.where("user_id is not null and item_id is not null").select(F.col("user_id").alias("entity"), F.struct(code("item_id", _kind(test, "item_id")).alias("c"), F.col("item_id").alias("item")).alias("_w"))
    wanted = asked.groupBy("entity").agg(F.sort_array(F.collect_set("_w")).alias("_w")).select("entity", F.col("_w.c").alias("wanted"), F.col("_w.item").alias("items"))
    rows = _profiles(own).join(mean.withColumnRenamed("user_id", "entity"), "entity").join(wanted, "entity", "left")
    none = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("wanted", "items")]
    rows = rows.select("entity", "avg_nb", "codes", "stars", *none)
    # the order of blocks and rows decides between equal similarities
    blocks = tiles.pack_in_order(rows, ratings.select("user_id").distinct().count(), [F.desc("avg_nb"), F.desc("entity")])
    places, span = (1 << 42) - 1, 1 << tiles.SHIFT

    def best(a: tiles.Sets, b: tiles.Sets, w: tiles.Sets, x: np.ndarray, y: np.ndarray, same: bool, at: np.ndarray, kept: np.ndarray) -> None:
        score = np.zeros((a.n, b.n), np.uint32)  # similarity, then the earlier row
        for ia, ib, _, m in _correlated(a, b, x, y, min_corated, threshold, same):
            score[ia, ib] = m * span + (span - 1 - ib)
        for p, q in zip(*tiles.shared(w, b), strict=True):
            spots = w.by_name[w.first[p] : w.first[p + 1]]
            sub = score[np.ix_(w.row[spots], b.row[b.by_name[b.first[q] : b.first[q + 1]]])]
            if sub.shape[1] > k:
                sub = np.partition(sub, sub.shape[1] - k, axis=1)[:, -k:]
            m = sub.astype(np.int64)
            full = np.where(m > 0, (m // span << 42) + places - at[np.minimum(span - 1 - m % span, b.n - 1)], 0)
            both = np.concatenate([kept[spots], full], axis=1)
            kept[spots] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]

    def kernel(pairs):
        left = None
        for table, right, same, a, b in tiles.with_sets(pairs):
            if table is not left:
                if left is not None:
                    yield told(left, w, kept, seen)
                left, w, x, seen = table, tiles.Sets(table, "wanted"), _stars(table, a), []
                kept = np.zeros((len(w.code), k), np.int64)
            seen.append(right.select(["_at", "entity"]))
            best(a, b, w, x, x if same else _stars(right, b), same, right["_at"].to_numpy(), kept)
        if left is not None:
            yield told(left, w, kept, seen)

    def told(left: pa.Table, w: tiles.Sets, kept: np.ndarray, seen: list) -> pa.RecordBatch:
        all_seen = pa.concat_tables(seen).sort_by("_at").combine_chunks()
        pair, col = np.nonzero(kept)
        value = kept[pair, col]
        nb = np.searchsorted(all_seen["_at"].to_numpy(), places - (value & places))
        items = pa.concat_arrays(left["items"].chunks).flatten()
        take = lambda c, i: pa.concat_arrays(c.chunks).take(pa.array(i)) if isinstance(c, pa.ChunkedArray) else c.take(pa.array(i))
        return pa.RecordBatch.from_pydict({"user_id": take(left["entity"], w.row[pair]), "item_id": take(items, pair), "nb": take(all_seen["entity"], nb), "sim": (value >> 42) / 1e6})

    user = _kind(own, "user_id")
    near = tiles.across(blocks, kernel, f"user_id {user}, item_id {_kind(test, 'item_id')}, nb {user}, sim double", ordered=True)
    return _ranked(near.join(mean.withColumnRenamed("user_id", "nb"), "nb"), k).join(own.withColumnRenamed("user_id", "nb"), ["nb", "item_id"]).select("user_id", "item_id", "nb", "sim", "stars", "avg_nb", "rank")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("user_id", "item_id").orderBy(F.desc("sim"), F.desc("avg_nb"), F.desc("nb"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _both_ways(model: DataFrame) -> DataFrame:
    return model.select(F.col("a").alias("e"), F.col("b").alias("nb"), "sim").union(model.select("b", "a", "sim"))


def _deviation() -> Column:
    return F.sum((F.col("stars") - F.col("avg_nb")) * F.col("sim")) / (F.sum(F.abs("sim")) + F.lit(1e-10))


def item_cf_predict(ratings: DataFrame, model: DataFrame, test: DataFrame) -> DataFrame:
    """user_id, item_id, stars: the item's mean plus the weighted deviations of the user's ratings of its neighbours.

    Pairs with a user or an item that has no rating are dropped; without a rated neighbour the item's mean stands.
    """
    own = clean_ratings(ratings)
    mean = own.groupBy("item_id").agg(F.avg("stars").alias("avg"))
    known = test.select("user_id", "item_id").distinct().join(own.select("user_id").distinct(), "user_id", "left_semi").join(mean, "item_id")
    near = known.join(_both_ways(model).withColumnRenamed("e", "item_id"), "item_id").join(own.withColumnRenamed("item_id", "nb"), ["user_id", "nb"]).join(mean.toDF("nb", "avg_nb"), "nb")
    moved = near.groupBy("user_id", "item_id").agg(_deviation().alias("dev"))
    return known.join(moved, ["user_id", "item_id"], "left").select("user_id", "item_id", F.round(F.col("avg") + F.coalesce("dev", F.lit(0.0)), 6).alias("stars"))


def top_neighbours(ratings: DataFrame, model: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """user_id, item_id, nb, sim, stars, avg_nb, rank: the k most similar users who rated the item; ties by mean, then id."""
    own = clean_ratings(ratings)
    mean = own.groupBy("user_id").agg(F.round(F.avg("stars"), 9).alias("avg_nb"))
    near = test.select("user_id", "item_id").distinct().join(_both_ways(model).withColumnRenamed("e", "user_id"), "user_id").join(own.withColumnRenamed("user_id", "nb"), ["nb", "item_id"]).join(mean.withColumnRenamed("user_id", "nb"), "nb")
    return _ranked(near, k).select("user_id", "item_id", "nb", "sim", "stars", "avg_nb", "rank")


def user_cf_predict(ratings: DataFrame, model: DataFrame | None, test: DataFrame, k: int = 5) -> DataFrame:
    """user_id, item_id, stars: the user's mean plus the weighted deviations of the top k neighbours' ratings of the item.

    Without a model it is that of user_cf_model(), and is not written.
    """
    own = clean_ratings(ratings)
    mean = own.groupBy("user_id").agg(F.avg("stars").alias("avg"))
    known = test.select("user_id", "item_id").distinct().join(mean, "user_id").join(own.select("item_id").distinct(), "item_id", "left_semi")
    top = nearest_raters(ratings, test, k) if model is None else top_neighbours(ratings, model, test, k)
    moved = top.groupBy("user_id", "item_id").agg(_deviation().alias("dev"))
    return known.join(moved, ["user_id", "item_id"], "left").select("user_id", "item_id", F.round(F.col("avg") + F.coalesce("dev", F.lit(0.0)), 6).alias("stars"))
