"""Quality classifier: similarity-weighted vote of the nearest labelled documents in a latent-semantic space.

The terms are pairs of neighbouring character classes, hashed words, and repeated words and word 4-grams. A truncated singular value decomposition of the
labelled documents' weighted counts gives the latent space; the labelled vectors are broadcast (their number is bounded
by ``max_labelled``) and each batch of documents takes exact cosines against all of them, block by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, tune

WORD_TERMS = 1024


def _classes() -> np.ndarray:
    """Byte -> class: kinds of letters, digits, white space, each sign of punctuation, bytes beyond ASCII."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if c in "aeiou":
            out[b] = 0
        elif "a" <= c <= "z":
            out[b] = 1
        elif "A" <= c <= "Z":
            out[b] = 2
        elif "0" <= c <= "9":
            out[b] = 3
        elif c == "\n":
            out[b] = 4
        elif b < 33:
            out[b] = 5
        elif b > 126:
            out[b] = 6
        else:
            out[b] = 7 + sum(not chr(x).isalnum() for x in range(33, b))
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
PAIRS = N_CLASSES * N_CLASSES
REPEATS = 3
TERMS = PAIRS + WORD_TERMS + REPEATS
#: (first term, end, weight) of the blocks of terms; a block's counts become shares, so texts of any length compare.
BLOCKS = ((0, PAIRS, 1.0), (PAIRS, PAIRS + WORD_TERMS, 0.3), (PAIRS + WORD_TERMS, TERMS, 1.0))


class _Words(dict):
    """Word -> its hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = zlib.crc32(word)
        return out


def counts(texts: list[str | None], words: _Words) -> np.ndarray:
    """A row of term counts for each text, whole texts read; null is empty."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        kinds = CLASSES[np.frombuffer(raw, np.uint8)]
        if len(kinds) > 1:
            out[i, :PAIRS] = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=PAIRS)
        if own := raw.lower().split():
            h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
            out[i, PAIRS : PAIRS + WORD_TERMS] = np.bincount((h % np.uint64(WORD_TERMS)).astype(np.int64), minlength=WORD_TERMS)
            adjacent = int((h[1:] == h[:-1]).sum())
            grams = h[:-3] * np.uint64(0x9E3779B97F4A7C15) + h[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:-1] * np.uint64(0x165667B19E3779F9) + h[3:]
            out[i, -REPEATS:] = adjacent, len(grams) - len(np.unique(grams)), len(h)
    return out


def weighted(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.float32(w) * np.sqrt(x[:, a:b] / np.maximum(x[:, a:b].sum(1, keepdims=True), 1)) for a, b, w in BLOCKS], 1)


@dataclass
class LatentVotes:
    idf: np.ndarray
    basis: np.ndarray  # terms x dims
    vectors: np.ndarray  # labelled x dims, of length 1
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def vectors_of(self, x: np.ndarray) -> np.ndarray:
        z = (weighted(x) * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        z, empty = self.vectors_of(x), x.sum(1) == 0
        sims = z @ self.vectors.T
        k = min(self.neighbours, sims.shape[1])
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        weight = np.where(sims >= least, np.maximum(sims, 0), 0) ** self.sharpness  # ties with the last one all vote
        total = weight.sum(1)
        score = np.where(total > 0, weight @ self.labels / np.maximum(total, 1e-12), self.prior)
        return np.clip(np.where(empty, self.prior, score), 0.0, 1.0)


def learn(x: np.ndarray, y: np.ndarray, dims: int = 48, neighbours: int = 15, sharpness: float = 4.0, seed: int = 7) -> LatentVotes:
    if not len(y):
        return LatentVotes(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours, sharpness)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    idf[-REPEATS:] = 1
    model = LatentVotes(idf, np.eye(1, dtype=np.float32), np.zeros((0, 1), np.float32), np.zeros(0), float(y.mean()), neighbours, sharpness)
    w = weighted(x) * idf
    q = np.random.default_rng(seed).standard_normal((TERMS, min(dims + 10, len(x)))).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration
        q, _ = np.linalg.qr(w.T @ (w @ q))
    _, _, vt = np.linalg.svd(w @ q, full_matrices=False)
    model.basis = np.ascontiguousarray((q @ vt.T)[:, :dims], np.float32)
    model.vectors, model.labels = model.vectors_of(x), y.astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents (text, label) that may be learned from: those whose hashed doc_id is smallest.

    Of several labels or texts of a doc_id the least counts, so rows that are repeated or in another order teach the same.
    """
    own = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min(F.struct("text", "_label")).alias("_x")).select("_x.text", "_x._label")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_labelled: int = 4096, **options) -> LatentVotes:
    """Learn from at most max_labelled labelled documents; the terms are counted on the executors."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            x = counts(b.column(0).to_pylist(), words)
            rows = [(np.flatnonzero(r).astype(np.int32).tobytes(), r[r > 0].tobytes()) for r in x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)] + [b.column(1).cast(pa.int32())], ["at", "n", "label"])

    rows = labelled_sample(docs, labels, label, usable, max_labelled).mapInArrow(tidy(run), "at binary, n binary, label int").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("at", "n", "label")), strict=True), key=lambda r: (r[0], r[1], r[2]))
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (at, n, _) in enumerate(rows):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(n, np.float32)
    return learn(x, np.array([r[2] for r in rows], np.float32), **options)


def score(docs: DataFrame, model: LatentVotes) -> DataFrame:
    """All columns of docs and ``score``, the vote for label 1 (0 to 1). doc_id, lang and source play no part.

    A null or empty text has no neighbours and takes the labelled rows' share of label 1. Repeated rows score alike, a
    column of docs that is itself called score is replaced, an empty table stays empty.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score")
    found = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: workers unpickle no class of ours
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = _Words(), LatentVotes(**found.value)
        for b in batches:
            s = own.score(counts(b.column(at).cast(pa.string()).to_pylist(), words)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(tidy(run), docs.withColumn("score", F.lit(0.0)).schema)
