"""Substring deduplication by recompression.

Rounds of recompression parse each text: a run of one word gets a name made of the word and its length, then neighbouring
symbols of which the first falls in the left half and the second in the right half of the alphabet become a pair with a
name of its own. Names are hashes of what they stand for, so equal substrings get equal interior symbols in all documents
without an exchange of dictionaries. With each symbol goes its support, the words that were looked at to form it; a
symbol whose support lies inside a window depends on the window's words only.

Each window of ``window`` words takes as anchor one symbol supported inside it, of the highest level that has one.
Windows with equal words have equal anchors, so anchors are what Spark deals windows by: neighbouring windows with one
anchor travel together as packed hashes, and the windows are compared among those of their anchor. A batch of documents
keeps only the first of equal windows before anything is dealt, so a passage that a third of all documents share comes
from each batch once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, tune
from .words import WordHashes, mix, raw

ROUNDS = 3
#: Packed with each run of windows: anchor, document, first window, number of windows; then 6 bytes a window.
RUN = np.dtype([("name", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
TAIL = np.dtype([("lo", "<u4"), ("hi", "<u2")])


#: Places left free between documents, more than the words outside that a support can reach to.
GAP = 16


def places(ends: np.ndarray) -> np.ndarray:
    """The words' places, with gaps between documents."""
    at = np.arange(len(ends), dtype=np.int64)
    at[1:] += GAP * np.cumsum(ends[:-1])
    return at


def levels(h: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, first and last place of the support) of each level's symbols, from the words' hashes.

    ends: for each word, True where its document ends. What lies beyond a document's ends counts as a word that is not
    in it, so that supports at the ends reach outside.
    """
    at = places(ends)
    names, lo, hi, last = h, at, at, ends
    out = [(names, lo, hi)]
    for k in range(rounds):
        if k == 0:  # runs of a word: a text of words in ever new order has none later, and each look costs support
            first = np.ones(len(names), bool)
            first[1:] = (names[1:] != names[:-1]) | last[:-1]
            starts = np.flatnonzero(first)
            stops = np.append(starts[1:], len(names)) - 1
            length = (stops - starts + 1).astype(np.uint64)
            names = np.where(length > 1, mix(names[starts] + length * np.uint64(0xD6E8FEB86659FD93), 77), names[starts])
            lo, hi, last = at[starts] - 1, at[stops] + 1, last[stops]
        m = len(names)
        right = (mix(names, 100 + k) >> np.uint64(17) & np.uint64(1)).astype(bool)
        pair = np.zeros(m, bool)  # this symbol and the next become one
        pair[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
        taken = np.zeros(m, bool)
        taken[1:] = pair[:-1]
        # beyond a document's end there is no symbol; its support reaches one word outside
        nlo, nhi = lo.copy(), hi.copy()
        after = np.append(hi[1:], 0)
        after = np.where(last, hi + 1, after)
        newdoc = np.append(True, last[:-1])
        before = np.append(-1, lo[:-1])
        before = np.where(newdoc, lo - 1, before)
        look = ~right & ~pair
        nhi[look] = after[look]
        nhi[pair] = after[pair]
        look = right & ~taken
        nlo[look] = before[look]
        keep = ~taken
        second = np.append(names[1:], np.uint64(0))
        names = np.where(pair, mix(names * np.uint64(3) + mix(second, 5), 200 + k), names)[keep]
        last = np.where(pair, np.append(last[1:], True), last)[keep]
        lo, hi = nlo[keep], nhi[keep]
        out.append((names, lo, hi))
    return out


def anchors(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its first word's place) the anchor's name, and a number for the anchor's occurrence."""
    name, which = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for level in range(len(found) - 1, -1, -1):
        names, lo, hi = found[level]
        if not len(todo):
            break
        s = starts[todo]
        a = np.searchsorted(lo, s, "left")
        b = np.searchsorted(hi, s + window - 1, "right") - 1
        ok = b >= a
        a, b = a[ok], b[ok]
        rank = mix(names, 300) & np.uint64(0xFFFFFFFFF0000000) if len(names) < 1 << 28 else None
        assert rank is not None, "a batch has fewer symbols"
        best = [rank | np.arange(len(names), dtype=np.uint64)]  # the least rank, of equal ones the first
        size = 1
        while 2 * size <= window:
            x = best[-1]
            y = x.copy()
            if len(x) > size:
                y[:-size] = np.minimum(x[:-size], x[size:])
            best.append(y)
            size *= 2
        k = np.log2(b - a + 1).astype(np.int64)
        got = np.zeros(len(a), np.uint64)
        for j in range(len(best)):
            own = k == j
            got[own] = np.minimum(best[j][a[own]], best[j][b[own] - (1 << j) + 1])
        at = (got & np.uint64(0xFFFFFFF)).astype(np.int64)
        name[todo[ok]] = names[at]
        which[todo[ok]] = at * len(found) + level
        todo = todo[~ok]
    return name, which


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9FB21C651E98DF25
    one = np.full(n, base, np.uint64)
    one[:1] = 1
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    return np.multiply.accumulate(one), np.multiply.accumulate(inverse)


def runs_of(docs: np.ndarray, texts: list[list[bytes]], words: WordHashes, window: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(runs, their windows' hashes, removed) of a batch of documents.

    Only the first of equal windows is in a run; the others are in removed, as (document, first window, one past the last).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(sizes >= window)
    docs, sizes = docs[long], sizes[long]
    if not len(long):
        return np.zeros(0, RUN), np.zeros(0, TAIL), []
    h = words.of([w for i in long for w in texts[i]])
    offsets = np.append(0, np.cumsum(sizes))
    ends = np.zeros(len(h), bool)
    ends[offsets[1:] - 1] = True
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    starts = np.flatnonzero(np.arange(len(h)) + window <= offsets[doc_of + 1])
    name, which = anchors(levels(h, ends), places(ends)[starts], window)
    up, down = _powers(len(h) + 1)
    total = np.append(np.uint64(0), np.cumsum(h * up[:-1]))
    content = mix((total[starts + window] - total[starts]) * down[starts], 9)
    own_doc = doc_of[starts]
    own_pos = starts - offsets[own_doc]
    removed: list[tuple[int, int, int]] = []
    # first of equal windows in the batch, by document and place
    order = np.lexsort((own_pos, docs[own_doc], content))
    c = content[order]
    again = np.zeros(len(order), bool)
    same = c[1:] == c[:-1]
    again[1:] = same
    if same.any():
        group = np.cumsum(~again) - 1
        firsts = order[~again]
        f = firsts[group]
        same_place = (docs[own_doc[order]] == docs[own_doc[f]]) & (own_pos[order] == own_pos[f])  # a repeated row is no earlier one
        gone = np.zeros(len(order), bool)
        gone[order[again & ~same_place]] = True
        drop = np.zeros(len(order), bool)
        drop[order[again]] = True
        removed = spans(docs[own_doc], own_pos, gone)
        keep = ~drop
        starts, name, which, content, own_doc, own_pos = (x[keep] for x in (starts, name, which, content, own_doc, own_pos))
    new = np.ones(len(starts), bool)
    new[1:] = (which[1:] != which[:-1]) | (own_doc[1:] != own_doc[:-1]) | (own_pos[1:] != own_pos[:-1] + 1)
    at = np.flatnonzero(new)
    runs = np.zeros(len(at), RUN)
    runs["name"], runs["doc"], runs["start"] = name[at], docs[own_doc[at]], own_pos[at]
    runs["n"] = np.diff(np.append(at, len(starts)))
    tail = np.zeros(len(starts), TAIL)
    tail["lo"], tail["hi"] = content & np.uint64(0xFFFFFFFF), content >> np.uint64(48)
    return runs, tail, removed


def spans(doc: np.ndarray, pos: np.ndarray, flag: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, first, one past the last) of the stretches of flagged neighbouring windows."""
    at = np.flatnonzero(flag)
    if not len(at):
        return []
    at = at[np.lexsort((pos[at], doc[at]))]
    d, p = doc[at], pos[at]
    new = np.ones(len(at), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(at)) - 1
    return list(zip(d[first].tolist(), p[first].tolist(), (p[stop] + 1).tolist(), strict=True))


def _expand(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = runs["n"].astype(np.int64)
    of = np.repeat(np.arange(len(runs)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return runs["name"][of], runs["doc"][of], runs["start"][of].astype(np.int64) + inside


def later_windows(docs: DataFrame, window: int) -> DataFrame:
    """_doc, _from, _to: the windows, by first word, whose words also start earlier."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = parts * 8  # a task takes one share after the other, so its memory is that of one

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            runs, tail, removed = runs_of(ids, [raw(x.as_py()) for x in b.column(1)], words, window)
            share = (mix(runs["name"], 400) % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            n = runs["n"].astype(np.int64)
            begin = np.cumsum(n) - n
            lengths = n[order]
            pick = np.repeat(begin[order] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(n.sum()))
            runs, tail, share = runs[order], tail[pick], share[order]
            cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1])) if len(share) else np.zeros(0, np.int64)
            stops, ahead = np.append(cuts[1:], len(runs)), np.append(0, np.cumsum(runs["n"].astype(np.int64)))
            rows = [(int(share[a]), runs[a:z].tobytes(), tail[ahead[a] : ahead[z]].tobytes()) for a, z in zip(cuts, stops, strict=True)]
            if removed:  # these are settled: they travel as runs without hashes, dealt evenly
                own = np.array(removed, np.int64).reshape(-1, 3)
                rows.append((int(abs(own[0, 0]) % shares), own.tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["share", "runs", "tail"])

    def settle(heads: list[bytes], tails: list[bytes]) -> list[tuple[int, int, int]]:
        runs = np.frombuffer(b"".join(heads), RUN)
        tail = np.frombuffer(b"".join(tails), TAIL)
        name, doc, pos = _expand(runs)
        key = mix(name, 500) ^ (tail["lo"].astype(np.uint64) | tail["hi"].astype(np.uint64) << np.uint64(32))
        order = np.argsort(key, kind="stable")
        k = key[order]
        many = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        many[1:] = same
        many[:-1] |= same
        order = order[many]
        if not len(order):
            return []
        k, d, p = key[order], doc[order], pos[order]
        order = np.lexsort((p, d, k))
        k, d, p = k[order], d[order], p[order]
        first = np.append(True, k[1:] != k[:-1])
        f = np.flatnonzero(first)[np.cumsum(first) - 1]
        return spans(d, p, (d != d[f]) | (p != p[f]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            x = np.array(found, np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(3)], ["_doc", "_from", "_to"])

        now, heads, tails = None, [], []
        for b in batches:
            for share, run, tail in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if tail is None:
                    yield out(np.frombuffer(run, np.int64).reshape(-1, 3))
                    continue
                if share != now and heads:
                    yield out(settle(heads, tails))
                    heads, tails = [], []
                now = share
                heads.append(run)
                tails.append(tail)
        if heads:
            yield out(settle(heads, tails))

    dealt = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(parse), "share int, runs binary, tail binary")
    return dealt.repartition(parts, "share").sortWithinPartitions("share").mapInArrow(tidy(compare), "_doc long, _from long, _to long")


def kept_words(words: list[bytes], removed: list[tuple[int, int]], window: int) -> list[bytes]:
    """The words that no window of removed ([from, to) of first words) covers."""
    if not removed:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for a, z in removed:
        gone[min(a, len(words))] += 1
        gone[min(z + window - 1, len(words))] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def deduplicate(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a smaller doc_id, or earlier
    in the same document. Null and empty texts have no words. Rows with a null doc_id are compared with nothing and keep
    all words. Rows that share a doc_id are judged as one document: equal rows don't remove each other, and a place that
    goes in one goes in all. Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    gone = later_windows(docs, window).groupBy("_doc").agg(F.collect_list(F.struct("_from", "_to")).alias("_gone"))
    joined = docs.join(gone, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "_gone")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, gone in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = raw(text.as_py())
                kept = kept_words(words, [(x["_from"], x["_to"]) for x in gone or ()], window)
                data = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "surrogatepass") if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(tidy(digest), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
