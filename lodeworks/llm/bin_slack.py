"""Best-fit packing by minimum bin slack.

Lengths are whole numbers from 1 to the capacity, so however many documents there are, the state of the packing
problem is a histogram of at most ``capacity`` counts. The driver plans on that histogram: each step fixes the longest
remaining length, finds by subset sums over bitsets the fullest feasible combination of the other available lengths, and
removes that combination as often as the counts allow. Spark then gives every piece its rank among the pieces of its
length, and a rank falls into exactly one slot of the plan.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy, tune

_ENCODERS: dict = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """A function from a text to its ids by a tokenizer.json.

    The ids are those of the library that the file is made for. Where the file is a plain byte-level BPE (no normaliser,
    the usual split, and ids that are the merge ranks) a faster library reads the same vocabulary, and only texts that
    spell a special token go to the first; any other file is read by the first alone.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        exact = Tokenizer.from_file(path)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        fast = _ranked(spec, special) if _plain(spec) else None

        def encode(text: str) -> list[int]:
            if fast is None or any(x in text for x in special):
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def _plain(spec: dict) -> bool:
    """Whether a tokenizer.json says no more than byte-level BPE by merge ranks."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"):
        return False
    if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return all(model["vocab"].get(x) == 256 + i for i, x in enumerate(merged))


def _ranked(spec: dict, special: list[str]):
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file spells as themselves
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*printable}))}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only longer ones are cut; the first piece takes the rest."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    schema = PIECES + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut_pieces(len(ids), capacity)):
                    own = ids[s : s + n]
                    rows.append((doc, k, s, n, zlib.crc32(own.tobytes()), own.tolist())[: 5 + with_ids])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5 + with_ids)], names[: 5 + with_ids])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def fullest(room: int, counts: list[tuple[int, int]]) -> list[int]:
    """Lengths, each at most as often as counted, whose sum is the largest that fits the room. counts: longest first."""
    reach, mask, items = 1, (1 << room + 1) - 1, []
    for length, count in counts:
        if length > room:
            continue
        left, chunk = min(count, room // length), 1
        while left:  # binary splitting of the multiplicity
            take = min(chunk, left)
            items.append((length, take, reach))
            reach |= reach << length * take & mask
            left, chunk = left - take, chunk * 2
        if reach >> room:
            break
    best, out = reach.bit_length() - 1, []
    for length, take, before in reversed(items):
        if not before >> best & 1:
            out += [length] * take
            best -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences), until the histogram is empty."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        seed = max(left)
        own = dict(left)
        own[seed] -= 1
        lengths = [seed, *fullest(capacity - seed, sorted(((k, v) for k, v in own.items() if v), reverse=True))]
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((lengths, times))
    return out


def slots(sequences: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Arrays sorted by key: key (length and first rank), first rank, first sequence, offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in sequences:
        at = 0
        for x in lengths:
            lo = used.get(x, 0)
            rows.append((x << 44 | lo, lo, base, at))
            used[x], at = lo + times, at + x
        base += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, capacity: int, rows_per_salt: int = 250_000) -> DataFrame:
    """Give every row of pieces (doc_id, piece, length, ...) its sequence_id and its offset there.

    The rank among the pieces of a length is counted within salted groups of some rows_per_salt rows, so that a length
    which a third of the documents share is no single task's work. Repeated rows and ties are packed each for itself.
    """
    spark = pieces.sparkSession
    salts = 1 + pieces.count() // rows_per_salt
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = cut(pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_salt")
    found = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, base, at = found.value
        for b in batches:
            rank, length = b.column("_rank").to_numpy(), b.column("length").to_numpy()
            k = np.searchsorted(keys, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(base[k] + rank - first[k]), pa.array(at[k])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack the documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone. Rows with a null doc_id or with equal doc_ids are packed each for itself;
    other columns are ignored. An empty table gives an empty result. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.
    """
    tune(docs.sparkSession)
    pieces = cut(tokenised(docs, tokenizer_path, capacity, end_id))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
