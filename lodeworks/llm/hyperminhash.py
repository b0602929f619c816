"""Near-duplicate documents by HyperMinHash.

A document's word shingles fall into 128 buckets by their hash; a bucket's register keeps the largest leading-zero count
and, below it, mantissa bits of the hash that had it, 16 bits in all. Empty registers borrow from others in an order
fixed per register, so that the registers of short texts, too, agree with the sets' similarity as their odds. Four
neighbouring registers are one 64-bit band key.

Documents with equal sets are one class from the start. Classes that share a band key are candidates, but a bucket's
pairs are never listed: its members are first tried with the bucket's least member, one try each by estimate, on full
sets, then the best try between any two components that are left. Where members of a bucket are then still in different
components, tasks compare registers across components, and of components that seem similar, all members outside the
largest component meet all of the group on full sets. A task holds a block of a group and lets those members pass; only
the links of a forest leave it. So every pair of candidates is confirmed, rejected, or needless because it is connected
already, and none is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aid, counted, cut, tidy, tune
from .components import components
from .words import WordHashes, mix, raw

REGISTERS, BAND, MANTISSA = 128, 4, 10
ORDER = np.array([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of ``size`` words in a row; of fewer words, but not none, the whole sequence is one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    x = words[: len(words) - size + 1]
    for j in range(1, size):
        x = mix(x * np.uint64(3) + words[j : len(words) - size + 1 + j], j)
    return np.unique(mix(x, size))


def registers(shingle_set: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits; none is empty unless the set is."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingle_set):
        return out
    bucket = (shingle_set >> np.uint64(57)).astype(np.int64)  # the set is sorted, so are its buckets
    h = mix(shingle_set, 51)
    zeros = np.clip(64 - np.frexp(h.astype(np.float64))[1], 0, 62)
    value = (zeros << MANTISSA | (mix(shingle_set, 52) >> np.uint64(64 - MANTISSA)).astype(np.int64)) + 1
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    out[bucket[first]] = np.maximum.reduceat(value, first)
    if len(first) < REGISTERS:
        full = out > 0
        out = np.where(full, out, out[ORDER[np.arange(REGISTERS), full[ORDER].argmax(1)]])
    return out


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (128 bits of the set's hash), bands (the registers, four in a long; null if n is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            n, h1, h2, bands = [], [], [], []
            for text in b.column(1):
                s = shingles(words.of(raw(text.as_py(), lower=True)), size)
                n.append(len(s))
                h1.append(_signed(mix(s, 1).sum(dtype=np.uint64)))
                h2.append(_signed(np.bitwise_xor.reduce(mix(s, 2), initial=np.uint64(0))))
                bands.append(registers(s).view("<i8").tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "bands"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, bands array<long>")


def agreeing(x: Column, y: Column) -> Column:
    """How many of the registers in two arrays of bands are equal."""
    lanes = [(F.lit(0xFFFF << 16 * i) if i < 3 else F.lit(-(1 << 48))) for i in range(BAND)]
    same = F.zip_with(x, y, lambda p, q: sum(((p.bitwiseXOR(q).bitwiseAND(m)) == 0).cast("int") for m in lanes))
    return F.aggregate(same, F.lit(0), lambda a, v: a + v)


def estimate(agree: Column, n1: Column, n2: Column) -> Column:
    """Jaccard similarity from the share of agreeing registers, less what unequal shingles agree on by chance."""
    per = lambda n: F.greatest(n / REGISTERS, F.lit(1.0))
    most = lambda q, n: F.pow(1 - F.pow(F.lit(2.0), -(q + 1)), n) - F.when(q == 0, F.lit(0.0)).otherwise(F.pow(1 - F.pow(F.lit(2.0), -q), n))
    chance = F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.lit(0.0), lambda a, q: a + most(q, per(n1)) * most(q, per(n2))) / (1 << MANTISSA)
    return (agree / REGISTERS - chance) / (1 - chance)


def _texts(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """wanted (rep, ...) with the texts of its documents; while it is small, texts don't travel for the join."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return texts.join(aid(wanted, rows), "rep")


def confirm(pairs: DataFrame, rows: int, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union, and how many. rows: pairs at most.

    Pairs meet by a: its text comes first, those of the b after it, so a task holds two sets at a time. The pairs of an a
    are dealt in as many shares as there are partitions.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int").alias("share"), F.lit(1).alias("kind"), F.col("b").alias("rep"))
    centres = members.select("a", "share", F.lit(0).alias("kind"), F.col("a").alias("rep")).distinct()
    met = _texts(docs, members.union(centres), 2 * rows).select("a", "share", "kind", "rep", "text").repartition(parts, "a", "share").sortWithinPartitions("a", "share", "kind", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, centre = WordHashes(), None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, share, kind, one, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                s = shingles(words.of(raw(text.as_py(), lower=True)), size)
                if (a, share) != now:
                    now, centre = (a, share), []
                if kind == 0:
                    centre.append(s)
                    continue
                for c in centre:  # one, unless rows share a doc_id
                    common = len(np.intersect1d(c, s, assume_unique=True))
                    if len(s) and 100 * common >= percent * (len(c) + len(s) - common):
                        a_out.append(a)
                        b_out.append(one)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return counted(met.mapInArrow(tidy(run), "a long, b long"))


class _Forest:
    """Union-find over labels; join() says whether it joined two trees."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        while self.parent.get(x, x) != x:
            self.parent[x] = x = self.parent.get(self.parent[x], self.parent[x])
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _met(rows: DataFrame) -> DataFrame:
    """Each row of a group once in one of its blocks (kind 0), and those outside its main component in every block (kind 1)."""
    own = rows.withColumns({"_at": F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"), "_kind": F.lit(0)})
    rest = rows.where("c != main").withColumns({"_at": F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)), "_kind": F.lit(1)})
    return own.union(rest)


def likely(rows: DataFrame, percent: int, least: float) -> tuple[DataFrame, int]:
    """a, b: links that connect the components (c) of which two members in one bucket have an estimate of at least least.

    rows: k, _at, _kind, c, n, bands of _met(). The registers of a bucket are compared in the tasks of its blocks, and only
    the links of a forest over its components leave a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("k", "_at", "_kind", "c", "n", "bands").repartition(parts, "k", "_at").sortWithinPartitions("k", "_at", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in batches:
            out = []
            regs = b.column(5).flatten().to_numpy().reshape(b.num_rows, -1).view(np.uint16)
            for k, at, kind, c, n, own in zip(*(b.column(i).to_pylist() for i in range(5)), regs, strict=True):
                if (k, at) != block.name:
                    block = _Block((k, at))
                if kind == 0:
                    block.add(c, n, own)
                    continue
                j = block.near(c, n, percent)
                if len(j):
                    j = j[(block.table()[j] == own).mean(1) >= least]
                    out += [(c, x) for x in np.unique(block.c[j]).tolist() if block.forest.join(c, x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return counted(dealt.mapInArrow(tidy(run), "a long, b long"))


class _Block:
    """Members of a block of a group: component, set size, and what is compared."""

    def __init__(self, name=None):
        self.name, self.forest = name, _Forest()
        self.cs, self.ns, self.held, self.ready = [], [], [], False

    def add(self, c: int, n: int, what: np.ndarray) -> None:
        self.cs.append(c)
        self.ns.append(n)
        self.held.append(what)
        self.ready = False

    def near(self, c: int, n: int, percent: int) -> np.ndarray:
        """Members of other components whose sizes allow the similarity."""
        if not self.ready:
            self.c, self.n, self.ready, self._table, self._index = np.array(self.cs, np.int64), np.array(self.ns, np.int64), True, None, None
        return np.flatnonzero((self.c != c) & (100 * np.minimum(self.n, n) >= percent * np.maximum(self.n, n)))

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.stack(self.held)
        return self._table

    def common(self, s: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of s with the members' sets, from an index of shingles to members."""
        if self._index is None:
            ids, owner = np.concatenate(self.held), np.repeat(np.arange(len(self.held)), [len(x) for x in self.held])
            order = np.argsort(ids, kind="stable")
            self._index = ids[order], owner[order]
        ids, owner = self._index
        lo, hi = np.searchsorted(ids, s, "left"), np.searchsorted(ids, s, "right")
        many = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
        return np.bincount(owner[at], minlength=len(self.held))


def across(rows: DataFrame, n_rows: int, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """a, b: confirmed links that connect components (c) within groups (g). rows: g, _at, _kind, c, rep of _met().

    The texts of a block of a group meet in a task all of the group's texts outside its main component; pairs across
    components are counted on full sets, and the links of a forest leave the task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _texts(docs, rows, n_rows).select("g", "_at", "_kind", "c", "rep", "text").repartition(parts, "g", "_at").sortWithinPartitions("g", "_at", "_kind", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, reps = WordHashes(), _Block(), []
        for b in batches:
            out = []
            for g, at, kind, c, rep, text in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
                s = shingles(words.of(raw(text.as_py(), lower=True)), size)
                if (g, at) != block.name:
                    block, reps = _Block((g, at)), []
                if kind == 0:
                    block.add(c, len(s), s)
                    reps.append(rep)
                    continue
                if not len(s) or not len(near := block.near(c, len(s), percent)):
                    continue
                common = block.common(s)[near]
                for j in near[(100 * common >= percent * (len(s) + block.n[near] - common)) & (common > 0)]:
                    if block.forest.join(c, int(block.c[j])):
                        out.append((rep, reps[j]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return counted(dealt.mapInArrow(tidy(run), "a long, b long"))


def _mains(rows: DataFrame, by: str, weight: str, block: int) -> DataFrame:
    """Of each group (by) of rows (by, c, weight) with several components: main, the largest, and blocks, of some block weight."""
    per = rows.groupBy(by, "c").agg(F.count("*").alias("_m"), F.sum(weight).alias("_w"))
    out = per.groupBy(by).agg(F.max_by("c", F.struct("_m", "c")).alias("main"), F.count("*").alias("_several"), F.ceil(F.sum("_w") / block).cast("int").alias("blocks"))
    return out.where("_several > 1").select(by, "main", "blocks")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, margin: float = 0.175, block_members: int = 1000, block_shingles: int = 1_000_000) -> DataFrame:
    """A row for each doc_id of docs (doc_id, text): n_shingles, component_id, kept.

    Linked are documents whose sets of ``size``-word shingles (A-Z lower-cased) have 100 * intersection >= percent *
    union; component_id is the least doc_id reachable, kept says that it is the row's own. Pairs whose estimate is more
    than margin below the threshold are not confirmed; with 128 registers that is five standard deviations or more.

    Null and empty texts have an empty set and are linked with nothing. Rows that share a doc_id are one document with
    the links of all of its rows; n_shingles is the largest. Rows with a null doc_id are one such document, linked with
    nothing and kept. Other columns are ignored; an empty table gives an empty result.

    A task compares a block of some block_members registers, or texts with some block_shingles shingles, at a time.
    """
    tune(docs.sparkSession)
    least = percent / 100 - margin
    found = cut(sketches(docs, size))
    usable = found.where("n > 0 and doc_id is not null")
    classes = cut(usable.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("h1", "h2", "n", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    reps = classes.select("rep", "n", "bands")
    keyed = reps.select("rep", F.posexplode_outer("bands").alias("_p", "_k")).select("rep", F.xxhash64("_p", "_k").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("k", "lo")
    buckets = cut(keyed.join(shared, "k"))

    x = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ra"))
    y = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("rb"))
    tries = buckets.where("lo != rep").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    tries = tries.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    tries = tries.select("a", "b", estimate(agreeing(F.col("ra"), F.col("rb")), F.col("na"), F.col("nb")).alias("est")).where(F.col("est") >= least)
    # first the least of the members that seem similar enough: so a group gathers around one document
    own = Window.partitionBy("b")
    wanted = F.coalesce(F.min(F.when(F.col("est") >= percent / 100, F.col("a"))).over(own), F.max_by("a", F.struct("est", "a")).over(own))
    tries, n_tries = counted(tries.withColumn("_first", F.col("a") == wanted))
    links, n_links = confirm(tries.where("_first").select("a", "b"), n_tries, docs, size, percent)
    label, n_label = components(links)

    def named(df: DataFrame, c: str, to: str) -> DataFrame:
        return df.join(aid(label.select(F.col("id").alias(c), F.col("label").alias("_c")), n_label), c, "left").withColumn(to, F.coalesce("_c", c)).drop("_c")

    # what these tries left apart: the best try between any two components
    apart = named(named(tries.where("not _first").drop("_first"), "a", "ca"), "b", "cb").where("ca != cb")
    second = apart.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("e")).select("e.a", "e.b")
    second, n_second = counted(second)
    if n_second:
        more, n_more = confirm(second, n_second, docs, size, percent)
        if n_more:
            links, n_links = links.union(more), n_links + n_more
            label, n_label = components(links)
    member = named(buckets.select("k", "rep"), "rep", "c")
    open_keys = member.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    member = cut(member.join(open_keys, "k", "left_semi"))
    mains, n_mains = counted(_mains(member.withColumn("_w", F.lit(1)), "k", "_w", block_members))
    if n_mains:
        near, n_near = likely(_met(member.join(aid(mains, n_mains), "k")).join(reps, "rep"), percent, least)
        if n_near:
            group, n_group = components(near)
            in_group = named(reps.select("rep", "n"), "rep", "c").join(aid(group.toDF("c", "g"), n_group), "c")
            in_group = cut(in_group)
            met, n_met = counted(_met(in_group.join(aid(_mains(in_group, "g", "n", block_shingles), n_group), "g")))
            more, n_more = across(met, n_met, docs, size, percent)
            if n_more:
                label, n_label = components(links.union(more))
    rows = found.join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left")
    rows = rows.join(aid(label.withColumnRenamed("id", "rep"), n_label), "rep", "left")
    rows = rows.select("doc_id", "n", F.coalesce("label", F.when(F.col("n") > 0, F.col("rep")), "doc_id").alias("c"))
    out = rows.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("c").alias("c"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"), F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), F.col("c"))).alias("kept"))
