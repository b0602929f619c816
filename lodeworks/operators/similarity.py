"""Jaccard similarity of sets: exact, and by MinHash with banding."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MINHASH, PRIME_MINHASH
from . import tiles

#: Words of 64 bits of the map that bounds how many members two sets share; larger sets are bounded less tightly.
MAP_WORDS = 16
#: Members that are hashed at a time.
SLICE = 100_000


def memberships(df: DataFrame, entity: str, member: str) -> DataFrame:
    return df.select(F.col(entity).alias("entity"), F.col(member).alias("member")).where("entity is not null and member is not null").distinct()


def common_counts(sets: DataFrame) -> DataFrame:
    """a, b, n_common of the pairs (a < b) of entities that share a member."""
    x, y = sets.toDF("a", "member"), sets.toDF("b", "member")
    return x.join(y, "member").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"))


def code(member: str, kind: str) -> Column:
    """A number that stands for a member: itself if it is a whole number, else 64 bits of hash."""
    return F.col(member).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(member).cast("string"))


def coded_sets(df: DataFrame, entity: str, member: str) -> DataFrame:
    """entity, codes: each entity's members as sorted numbers."""
    own = df.select(F.col(entity).alias("entity"), F.col(member).alias("member")).where("entity is not null and member is not null")
    own = own.select("entity", code("member", own.schema["member"].dataType.simpleString()).alias("_c"))
    return own.groupBy("entity").agg(F.sort_array(F.collect_set("_c")).alias("codes"))


def _kind(df: DataFrame, column: str = "entity") -> str:
    return df.schema[column].dataType.simpleString()


def jaccard_pairs(df: DataFrame, entity: str, member: str, threshold: float) -> DataFrame:
    """a, b, n_common, sim of all pairs (a < b) with sim >= threshold > 0.

    Blocks of sets are compared in numpy, each with each, so neither pairs nor common members are written or shuffled.
    """
    sets = coded_sets(df, entity, member)
    blocks = tiles.pack(sets, df.select(entity).distinct().count(), ["entity"])

    def kernel(pairs):
        for left, right, same, a, b in tiles.with_sets(pairs):
            ia, ib, n, sim = tiles.alike(a, b, same, threshold)
            yield tiles.named_pairs(left, right, ia, ib, n_common=n, sim=sim)

    return tiles.across(blocks, kernel, f"a {_kind(sets)}, b {_kind(sets)}, n_common long, sim double")


def token_sets(df: DataFrame, entity: str, member: str) -> DataFrame:
    """entity, tokens: each entity's members as strings."""
    own = df.select(F.col(entity).alias("entity"), F.col(member).cast("string").alias("_m")).where("entity is not null and _m is not null")
    return own.groupBy("entity").agg(F.collect_set("_m").alias("tokens"))


def signed(sets: DataFrame, hashes: list[tuple[int, int]] = MINHASH, buckets: int = 2**31 - 1) -> DataFrame:
    """entity, codes (64 bits of each member's MD5, sorted), signature, key (128 bits of the set) of (entity, tokens), one row each.

    Members are hashed once for each slice of rows that holds them.
    """
    a, b, wide = *(np.array([h[k] for h in hashes], np.int64) for k in (0, 1)), buckets > 2**31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("tokens").offsets.to_numpy()).astype(np.int64)
            for rows in tiles._within(sizes, SLICE):
                yield sign(batch.slice(rows.start, rows.stop - rows.start))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("tokens")
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        digest = np.frombuffer(b"".join(md5(w.encode()).digest() for w in words.dictionary.to_pylist()), np.uint8).reshape(-1, 16)
        x = digest[:, :4].copy().view(">u4").ravel().astype(np.int64) % 2**31
        values = ((x[:, None] * a + b) % PRIME_MINHASH % buckets).astype(np.int64 if wide else np.int32)
        places = words.indices.to_numpy()
        least = np.minimum.reduceat(values[places], np.concatenate([[0], np.cumsum(size)[:-1]]))
        pairs = np.unique(np.repeat(np.arange(len(size)), size) * len(x) + places)
        row, code = pairs // len(x), digest[:, 8:].copy().view(np.int64).ravel()[pairs % len(x)]
        code = code[np.lexsort((code, row))]
        ends = np.cumsum(np.bincount(row, minlength=len(size)))
        starts = np.concatenate([[0], ends[:-1]])
        keys = [md5(code[lo:hi].tobytes()).digest() for lo, hi in zip(starts, ends, strict=True)]
        codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(code))
        signature = pa.ListArray.from_arrays(pa.array((np.arange(len(size) + 1) * len(a)).astype(np.int32)), pa.array(least.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("entity"), codes, signature, pa.array(keys, pa.binary())], names=["entity", "codes", "signature", "key"])

    full = sets.select("entity", "tokens").where("entity is not null and size(tokens) > 0")
    return full.mapInArrow(run, f"entity {_kind(sets)}, codes array<long>, signature array<{'long' if wide else 'int'}>, key binary")


def minhash_signature(df: DataFrame, entity: str, member: str, hashes: list[tuple[int, int]] = MINHASH, buckets: int = 2**31 - 1) -> DataFrame:
    """entity, signature (array of minima, one for each hash); members are hashed to integers first."""
    return signed(token_sets(df, entity, member), hashes, buckets).select("entity", F.col("signature").cast("array<bigint>").alias("signature"))


def _bands(table: pa.Table, rows: int) -> np.ndarray:
    """A row for each band: a number for each set, equal if all ``rows`` hashes of the band are."""
    flat = table["signature"].combine_chunks()
    s = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().astype(np.int64).reshape(table.num_rows, -1)
    s = s[:, : s.shape[1] // rows * rows].reshape(table.num_rows, -1, rows)
    return np.ascontiguousarray((s[:, :, 0] if rows == 1 else s[:, :, 0] * 2**31 + s[:, :, 1]).T)


def _agreeing(left: pa.Table, right: pa.Table, same: bool, held: dict, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that agree in a band; within one block each two rows once. held: what is kept of the left block."""
    if held.get("left") is not left:
        bands = _bands(left, rows)
        order = np.argsort(bands, axis=1, kind="stable")
        held.update(left=left, order=order, bands=np.take_along_axis(bands, order, 1))
    found = np.zeros((left.num_rows, right.num_rows), bool)
    for own, order, other in zip(held["bands"], held["order"], _bands(right, rows), strict=True):
        lo, hi = np.searchsorted(own, other, "left"), np.searchsorted(own, other, "right")
        found.reshape(-1)[order[tiles.expand(lo, hi - lo)] * right.num_rows + np.repeat(np.arange(len(other)), hi - lo)] = True
    return np.nonzero(np.triu(found, 1) if same else found)


def _signed_blocks(sets: DataFrame, rows: int, about: int | None) -> DataFrame:
    """Blocks of signed sets; about: how many there are, if they are dealt() already. A band's number takes two hashes at most, so longer ones are numbered here first."""
    own = sets
    if rows > 2:
        at = F.sequence(F.lit(0), (F.size("signature") / rows).cast("int") - 1)
        own = sets.withColumn("signature", F.transform(at, lambda i: F.xxhash64(F.slice("signature", i * rows + 1, rows))))
    return tiles.pack(own, own.count(), ["entity"]) if about is None else tiles.pack(own, about, [])


def lsh_candidates(signatures: DataFrame, rows: int, about: int | None = None) -> DataFrame:
    """a, b (a < b): pairs of entity, signature rows whose signatures agree in a whole band of ``rows`` hashes.

    Blocks of signatures are joined in numpy, each with each: pairs are not shuffled, nor those found again in other bands.
    """

    def kernel(pairs):
        held: dict = {}
        for left, right, same in pairs:
            yield tiles.named_pairs(left, right, *_agreeing(left, right, same, held, rows if rows < 3 else 1))

    return tiles.across(_signed_blocks(signatures.select("entity", "signature"), rows, about), kernel, f"a {_kind(signatures)}, b {_kind(signatures)}")


def similar_candidates(sets: DataFrame, threshold: float, rows: int, about: int | None = None) -> DataFrame:
    """a, b, n_common, sim of the candidates of signed() sets with sim >= threshold, computed on the full sets."""

    def kernel(pairs):
        held: dict = {}
        for left, right, same, a, b in tiles.with_sets(pairs):
            ia, ib = _agreeing(left, right, same, held, rows if rows < 3 else 1)
            near = np.minimum(a.size[ia], b.size[ib]) >= np.maximum(a.size[ia], b.size[ib]) * (threshold * (1 - 1e-9))
            ia, ib = ia[near], ib[near]
            if len(ia) * 10 < a.n * b.n:
                near = tiles.within_reach(a, b, ia, ib, threshold)
                ia, ib = ia[near], ib[near]
            few = a.size[ia].sum() < 4 * (len(a.code) + len(b.code))
            n = tiles.pairwise_common(a, b, ia, ib) if few else tiles.common(a, b)[ia, ib].astype(np.int64)
            sim = n / (a.size[ia] + b.size[ib] - n)
            ok = sim >= threshold
            yield tiles.named_pairs(left, right, ia[ok], ib[ok], n_common=n[ok], sim=sim[ok])

    own = _signed_blocks(sets.select("entity", "codes", "signature"), rows, about)
    return tiles.across(own, kernel, f"a {_kind(sets)}, b {_kind(sets)}, n_common long, sim double")


def dealt(signed_sets: DataFrame, about: int, distinct: bool) -> DataFrame:
    """The signed sets, or the least entity of each set by 128 bits of hash, in as many partitions as they make blocks."""
    own = signed_sets.repartition(tiles.parts(about), *(["key"] if distinct else ["entity"]))
    return own.groupBy("key").agg(F.min(F.struct("entity", "codes", "signature")).alias("s")).select("s.*") if distinct else own


def set_classes(sets: DataFrame) -> DataFrame:
    """entity, rep: the least entity with the same set, by 128 bits of hash. Copies then need not be paired."""
    own = sets.groupBy("entity").agg(F.sum(F.xxhash64("member").cast("decimal(20,0)")).alias("h1"), F.bit_xor(F.xxhash64("member", F.lit(7))).alias("h2"), F.count("*").alias("n"))
    reps = own.groupBy("h1", "h2", "n").agg(F.min("entity").alias("rep"))
    return own.join(reps, ["h1", "h2", "n"]).select("entity", "rep")


def _outlines(sets: DataFrame) -> DataFrame:
    """entity, n (members), slack (members less set bits), b0 ...: a bit map in which each member sets one bit."""
    at = sets.select("entity", F.pmod(F.xxhash64("member"), F.lit(64 * MAP_WORDS)).alias("_at")).selectExpr("entity", "shiftright(_at, 6) AS _w", "shiftleft(1L, CAST(_at & 63 AS INT)) AS _bit")
    maps = [F.bit_or(F.when(F.col("_w") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(MAP_WORDS)]
    own = at.groupBy("entity").agg(F.count("*").alias("n"), *maps)
    return own.withColumn("slack", F.col("n") - sum(F.bit_count(f"b{k}") for k in range(MAP_WORDS)))


def _within_reach(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose bit maps allow sim >= threshold. No such pair is lost: common members share their bits, and no more
    of them fall on one bit than members of either set do."""
    own = _outlines(sets)
    x, y = (own.toDF(e, *(f"_{e}{c}" for c in own.columns[1:])) for e in "ab")
    most = sum(F.bit_count(F.col(f"_ab{k}").bitwiseAND(F.col(f"_bb{k}"))) for k in range(MAP_WORDS)) + F.least("_aslack", "_bslack")
    return pairs.join(x, "a").join(y, "b").where(most * (1 + threshold) >= (F.col("_an") + F.col("_bn")) * (threshold * (1 - 1e-9))).select("a", "b")


def lsh_similar_pairs(df: DataFrame, entity: str, member: str, threshold: float, rows: int = 1, hashes: list[tuple[int, int]] = MINHASH) -> DataFrame:
    """a, b, n_common, sim of the candidates with sim >= threshold, computed on the full sets."""
    return similar_candidates(signed(token_sets(df, entity, member), hashes), threshold, rows)
