"""Line deduplication by a segment-partition edit join.

Two lines within an edit distance t share, if the shorter one is cut into t + 1 segments, at least one of the segments
unchanged. Each distinct line is therefore indexed by its t + 1 segments and probes, for each length that a partner may
have, only those of its own substrings that such a segment can match. Keys are hashes of segment, number and length.

Keys are dealt in packed shares and matched there by sorting. Candidates must also agree in a 64-bit signature of their
characters' parities, of which an edit changes two bits at most. A key that holds more candidates than a few per line
gives a star around its first line at once and is left open. When the links found so far are connected, the lines of an
open key outside its largest component meet all of its lines, block by block, and a forest's links leave each task.
Candidates are confirmed on the lines' characters by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aid, counted, cut, tidy, tune, unused
from .components import components
from .words import mix

ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("sign", "<u8"), ("len", "<i4"), ("probe", "<i4")])


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most limit (31 or less): bit-parallel over a band of diagonals 64 wide."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return False
    if a == b:
        return True
    if limit == 0 or len(a) <= limit:
        return len(a) <= limit
    full, at = (1 << 64) - 1, {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    vp, vn, dist, start = full << 63 - limit & full, 0, limit, limit - 63
    across, most = 1 << 62, 2 * limit + len(b) - len(a)
    for i, c in enumerate(b):
        x = at.get(c, 0)
        x = (x >> start if start >= 0 else x << -start) & full
        d0 = (((x & vp) + vp & full) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        if i < len(a) - limit:
            dist += not d0 >> 63
        else:
            dist += bool(hp & across) - bool(hn & across)
            across >>= 1
        if dist > most:
            return False
        vp, vn = hn | ~(d0 >> 1 | hp) & full, d0 >> 1 & hp
        start += 1
    return dist <= limit


def normal(line: str) -> str:
    """A-Z lower-cased, white space between words one space."""
    return b" ".join(line.encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def line_id(line: str) -> int:
    x = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def lines_of(text: str | None, least: int) -> list[tuple[int, str]]:
    """(number, normalised line) of the lines with at least ``least`` characters."""
    return [(i, x) for i, line in enumerate((text or "").split("\n")) if len(line) >= least and len(x := normal(line)) >= least]


def segment(length: int, parts: int, k: int) -> tuple[int, int]:
    """(start, length) of the k-th of ``parts`` segments of a line of that length; the last ones are longer by one."""
    small, longer = divmod(length, parts)
    return k * small + max(0, k - (parts - longer)), small + (k >= parts - longer)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse; kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9FB21C651E98DF25
        own = [np.full(1 << max(16, n.bit_length()), x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in own:
            x[0] = 1
        _POWERS[:] = [np.multiply.accumulate(x) for x in own]
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(lines: list[str], most: int = 500_000) -> Iterator[list[str]]:
    """The lines in order, in lists of at most that many characters; a longer line is a list of its own."""
    own, n = [], 0
    for x in lines:
        if own and n + len(x) > most:
            yield own
            own, n = [], 0
        own.append(x)
        n += len(x)
    if own:
        yield own


def entries(lines: list[str], ids: np.ndarray, limit: int) -> np.ndarray:
    """The index and probe entries of distinct lines."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in lines]
    sizes = np.array([len(c) for c in codes], np.int64)
    offset = np.append(0, np.cumsum(sizes))
    chars = np.concatenate(codes).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) if codes else np.zeros(0, np.uint64)
    up, down = _powers(len(chars) + 1)
    total = np.append(np.uint64(0), np.cumsum(chars * up[:-1]))
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (chars >> np.uint64(58)), offset[:-1]) if len(lines) else np.zeros(0, np.uint64)
    out = []

    def add(which: np.ndarray, begin: np.ndarray, length: np.ndarray, k: int, whole: np.ndarray, probe: int) -> None:
        s = offset[which] + begin
        x = np.zeros(len(which), ENTRY)
        x["key"] = mix((total[s + length] - total[s]) * down[s] + mix((whole * 64 + k).astype(np.uint64), 31), 32)
        x["line"], x["sign"], x["len"], x["probe"] = ids[which], parity[which], sizes[which], probe
        out.append(x)

    every, parts = np.arange(len(lines)), limit + 1
    for k in range(parts):
        small, longer = sizes // parts, sizes % parts
        add(every, k * small + np.maximum(0, k - (parts - longer)), small + (k >= parts - longer), k, sizes, 0)
        for shorter in range(limit + 1):
            whole = sizes - shorter
            small, longer = whole // parts, whole % parts
            p, n = k * small + np.maximum(0, k - (parts - longer)), small + (k >= parts - longer)
            lo = np.maximum(np.maximum(p - k, p + shorter - (limit - k)), 0)
            hi = np.minimum(np.minimum(p + k, p + shorter + (limit - k)), sizes - n)
            for step in range(2 * limit + 1):
                ok = np.flatnonzero((lo + step <= hi) & (n > 0))
                add(ok, (lo + step)[ok], n[ok], k, whole[ok], 1)
    return np.concatenate(out) if out else np.zeros(0, ENTRY)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def match(found: np.ndarray, limit: int, few: int = 4, block: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of lines, entries of open keys) among the entries of a share."""
    found = found[np.argsort(found["key"], kind="stable")]
    key = found["key"]
    many = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    many[1:] = same
    many[:-1] |= same
    found = found[many]
    found = np.unique(found)  # by key, line, ...: a line that several batches hold comes once
    if not len(found):
        return np.zeros((0, 2), np.int64), found
    first = np.append(True, found["key"][1:] != found["key"][:-1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(found)))
    pairs, left = [], []
    # small groups all at once: each entry with each of the next ones
    for width in range(1, 16):
        i = np.arange(len(found) - width)
        i = i[(found["key"][i] == found["key"][i + width])]
        group = np.repeat(sizes, sizes)[i]
        i = i[group <= 16]
        pairs.append(_pairs(found[i], found[i + width], limit))
    for g in np.flatnonzero(sizes > 16):
        own = found[starts[g] : starts[g] + sizes[g]]
        index, probe = own[own["probe"] == 0], own[own["probe"] == 1]
        got, n = [], 0
        for a in range(0, len(index), max(1, block // max(1, len(probe)))):
            part = index[a : a + max(1, block // max(1, len(probe)))]
            ok = (_bits(part["sign"][:, None] ^ probe["sign"][None]) <= 2 * limit) & (part["line"][:, None] != probe["line"][None])
            x, y = np.nonzero(ok)
            n += len(x)
            if n > few * len(own):
                break
            got.append(np.stack([part["line"][x], probe["line"][y]], 1))
        if n <= few * len(own):
            pairs += got
        else:
            star = own[_bits(own["sign"] ^ own["sign"][0]) <= 2 * limit]
            pairs.append(np.stack([np.full(len(star), own["line"][0]), star["line"]], 1))
            left.append(own)
    p = np.concatenate(pairs)
    p = np.unique(np.sort(p[p[:, 0] != p[:, 1]], axis=1), axis=0)
    return p, np.concatenate(left) if left else found[:0]


def _pairs(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    ok = (x["probe"] != y["probe"]) & (x["line"] != y["line"]) & (np.abs(x["len"] - y["len"]) <= limit) & (_bits(x["sign"] ^ y["sign"]) <= 2 * limit)
    return np.stack([x["line"][ok], y["line"][ok]], 1)


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, at, line: every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, line = [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for i, x in lines_of(text.as_py(), least):
                    doc.append(d)
                    at.append(i)
                    line.append(line_id(x))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(line, pa.int64())], ["doc_id", "at", "line"])

    return docs.mapInArrow(tidy(run), "doc_id long, at int, line long")


def _candidates(docs: DataFrame, least: int, limit: int) -> DataFrame:
    """a, b of candidate pairs; entries of open keys have key, line, sign, len instead."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = parts * 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = list({x: None for text in b.column(1) for _, x in lines_of(text.as_py(), least)})
            found = np.concatenate([np.zeros(0, ENTRY), *(entries(x, np.array([line_id(y) for y in x], np.int64), limit) for x in slices(lines))])
            share = ((found["key"] >> np.uint64(8)) % np.uint64(shares)).astype(np.uint16 if shares < 1 << 16 else np.int64)
            order = np.argsort(share, kind="stable")
            found, share = found[order], share[order]
            cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1])) if len(share) else []
            stops = np.append(cuts[1:], len(found)) if len(share) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(share[a]) for a in cuts], pa.int32()), pa.array([found[a:z].tobytes() for a, z in zip(cuts, stops, strict=True)], pa.binary())], ["share", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(packed: list[bytes]) -> pa.RecordBatch:
            pairs, left = match(np.frombuffer(b"".join(packed), ENTRY), limit)
            none = lambda n: [None] * n
            col = lambda x, y: pa.array([*x, *y], pa.int64())
            k, n = len(left), len(pairs)
            return pa.RecordBatch.from_arrays(
                [col(pairs[:, 0].tolist(), none(k)), col(pairs[:, 1].tolist(), none(k)), col(none(n), left["key"].astype(np.int64).tolist()), col(none(n), left["line"].tolist()), col(none(n), left["sign"].astype(np.int64).tolist()), col(none(n), left["len"].tolist())],
                ["a", "b", "key", "line", "sign", "len"],
            )

        now, packed = None, []
        for b in batches:
            for share, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if share != now and packed:
                    yield out(packed)
                    packed = []
                now = share
                packed.append(data)
        if packed:
            yield out(packed)

    dealt = docs.mapInArrow(tidy(deal), "share int, packed binary")
    return dealt.repartition(parts, "share").sortWithinPartitions("share").mapInArrow(tidy(meet), "a long, b long, key long, line long, sign long, len long")


def line_texts(wanted: DataFrame, rows: int, docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """line, words of the wanted lines (line; rows at most). Only the documents are read in which they come first."""
    place = occurrences.join(aid(wanted, rows), "line", "left_semi").groupBy("line").agg(F.min(F.struct("doc_id", "at")).alias("p"))
    place = place.groupBy("p.doc_id").agg(F.collect_list(F.struct("p.at", "line")).alias("places"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = [], []
            for text, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                lines = (text.as_py() or "").split("\n")
                for p in places:
                    x = normal(lines[p["at"]]) if p["at"] < len(lines) else ""
                    if line_id(x) == p["line"]:  # rows that share a doc_id may have other texts
                        ids.append(p["line"])
                        words.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["line", "words"])

    found = docs.join(aid(place, rows), "doc_id").select("text", "places").mapInArrow(tidy(texts), "line long, words string")
    return cut(found.groupBy("line").agg(F.min("words").alias("words")))


def _confirm(pairs: DataFrame, n_pairs: int, docs: DataFrame, occurrences: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) of lines within the limit, and how many."""
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
    found = line_texts(wanted, 2 * n_pairs, docs, occurrences)
    x, y = found.toDF("a", "x"), found.toDF("b", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [within(p, q, limit) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return counted(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long"))


def across(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """a, b: links within the limit that connect components (c) within open keys, and how many.

    rows: key, at, kind, line, sign, len, c, words. A block of a key's lines (kind 0) is held by a task, and the key's
    lines outside its largest component (kind 1) pass it one by one. A line is tried with the lines of a component until
    one is within the limit, so pairs are never listed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "at", "kind", "line", "sign", "len", "c", "words").repartition(parts, "key", "at").sortWithinPartitions("key", "at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, label = None, [], None, {}

        def root(x: int) -> int:
            while label.get(x, x) != x:
                x = label[x]
            return x

        for b in batches:
            out = []
            for key, at, kind, line, sign, length, c, words in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (key, at) != now:
                    now, held, block, label = (key, at), [], None, {}
                if kind == 0:
                    held.append((line, sign, length, c, words))
                    block = None
                    continue
                if block is None:
                    block = [np.array([h[i] for h in held], np.int64) for i in range(4)]
                near = (np.abs(block[2] - length) <= limit) & (_bits((block[1] ^ np.int64(sign)).view(np.uint64)) <= 2 * limit) & (block[3] != c)
                for j in np.flatnonzero(near):
                    x, y = root(c), root(int(block[3][j]))
                    if x != y and within(words, held[j][4], limit):
                        label[max(x, y)] = min(x, y)
                        out.append((line, held[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return counted(dealt.mapInArrow(tidy(run), "a long, b long"))


def line_links(docs: DataFrame, occurrences: DataFrame, limit: int = 2, least: int = 20, block: int = 4000) -> tuple[DataFrame, int]:
    """a, b: links between distinct lines within the limit, at least as many as connect what is connected; how many."""
    found = cut(_candidates(docs, least, limit))
    pairs, n_pairs = counted(found.where("a is not null").select("a", "b").distinct())
    left, n_left = counted(found.where("key is not null").select("key", "line", "sign", "len").distinct())
    links, n_links = _confirm(pairs, n_pairs, docs, occurrences, limit)
    if not n_left:
        return links, n_links
    label, n_label = components(links)
    member = left.join(aid(label.withColumnRenamed("id", "line"), n_label), "line", "left").select("key", "line", "sign", "len", F.coalesce("label", "line").alias("c"))
    mains = member.groupBy("key", "c").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max_by("c", F.struct("_n", "c")).alias("main"), F.count("*").alias("_several"), F.ceil(F.sum("_n") / block).cast("int").alias("blocks"))
    mains, n_mains = counted(mains.where("_several > 1").drop("_several"))
    if not n_mains:
        return links, n_links
    rest = member.join(aid(mains, n_mains), "key")
    own = rest.withColumns({"at": F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"), "kind": F.lit(0)})
    met = own.union(rest.where("c != main").withColumns({"at": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "kind": F.lit(1)})).drop("main", "blocks")
    met, n_met = counted(met)
    words = line_texts(met.select("line").distinct(), n_met, docs, occurrences)
    more, n_more = across(met.join(words, "line"), limit)
    return links.union(more), n_links + n_more


def deduplicate(docs: DataFrame, limit: int = 2, least: int = 20) -> DataFrame:
    """A row for each row of docs (doc_id, text): all its columns, kept_text, n_lines, n_removed, n_words_left.

    Lines of at least ``least`` characters, A-Z lower-cased and white space made single, belong to one class if edits of
    at most ``limit`` characters at a time lead from one to the other. Of each class the first line stays (smallest
    doc_id, then place); its other lines go from kept_text. Shorter lines always stay.

    A null text stays null and has no lines, an empty text has none that takes part. Rows with a null doc_id keep all
    lines and remove none. Rows that share a doc_id are judged as one document: equal rows don't remove each other, and
    a line number that goes in one goes in all. Columns of docs called like the results are replaced; an empty table
    gives an empty result.
    """
    tune(docs.sparkSession)
    docs = docs.drop("kept_text", "n_lines", "n_removed", "n_words_left")
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurrences = cut(_occurrences(own, least))
    links, n_links = line_links(own, occurrences, limit, least)
    lines = occurrences.groupBy("line").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    if n_links:
        label, n_label = components(links)
        label = label.withColumnRenamed("id", "line")
        heads = label.join(lines, "line").groupBy("label").agg(F.min("first").alias("_head")).join(aid(label, n_label), "label").select("line", "_head")
        lines = lines.join(aid(heads, n_label), "line", "left").select("line", F.coalesce("_head", "first").alias("first"), F.when(F.col("_head").isNull(), F.col("n")).otherwise(F.lit(2)).alias("n"))
    # a line that comes once and is like none needs no look at where it is
    gone = occurrences.join(lines.where("n > 1").select("line", "first"), "line").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    doc, at_gone = unused(docs, "_doc"), unused(docs, "_gone")
    gone = gone.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("at").alias(at_gone))
    joined = docs.join(gone, F.col("doc_id") == F.col(doc), "left").drop(doc)
    at, gone_at = joined.columns.index("text"), joined.columns.index(at_gone)
    names = [c for c in joined.columns if c != at_gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, drop in zip(b.column(at).cast(pa.string()), b.column(gone_at).to_pylist(), strict=True):
                t = text.as_py()
                lines = (t or "").split("\n") if t else []
                drop = set(drop or ())
                kept = [x for i, x in enumerate(lines) if i not in drop]
                left = t if not drop else "\n".join(kept)
                rows.append((left, len(lines), len(lines) - len(kept), len((left or "").split())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names) + 1) if i != gone_at), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64())))], [*names, "kept_text", "n_lines", "n_removed", "n_words_left"])

    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_words_left"))])
    return joined.mapInArrow(tidy(run), schema)
