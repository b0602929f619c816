"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of two of its prefixes. Filters of widths 1, 2 and
3 run over the words, each is max-pooled over the whole text, and a logistic layer reads the pooled values. A filter is
linear before pooling, so a word adds fixed amounts to it; workers compute them once per distinct word.

It learns from all labelled rows. Workers count in how many texts of each label a hash occurs, which gives the embeddings
they start with; the driver trains on a bounded number of texts to have weights to start from; then come rounds over all
rows, in which each shard of rows trains on from the same weights and the changes are averaged. Thresholds are counted
over all rows of the fifth that is kept for them. What comes to the driver besides the first texts doesn't grow with the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aid, counted, cut, tidy, tune

WIDTHS = (1, 2, 3)
SLOTS = sum(WIDTHS)
STRIP = b".,;:!?\"'()[]{}*#$%&|<>-"

#: Rows of a shard, about; steps of log odds that thresholds lie on; units of summed changes of weights and of squares.
SHARD_ROWS, GRID, UNITS, MOST = 2048, 256, (1 << 24, 1 << 16), 1 << 44


def word_ids(word: bytes, buckets: int) -> tuple[int, int, int]:
    """Hashes of a word and of its prefixes of 4 and 5 characters, lower-cased and stripped of punctuation."""
    text = word.decode("utf-8", "replace").lower()
    return tuple(zlib.crc32(f"{k}:{text[:n]}".encode("utf-8", "replace")) % buckets for k, n in ((0, None), (4, 4), (5, 5)))  # type: ignore[return-value]


def split(text: str | None) -> list[bytes]:
    return [w for x in (text or "").encode("utf-8", "replace").split() if (w := x.strip(STRIP))]


@dataclass
class ToxicCnn:
    embed: np.ndarray  # buckets x dims
    filters: np.ndarray  # slots x dims x filters: one slot for each place of each width
    bias: np.ndarray  # widths x filters
    out: np.ndarray  # widths * filters
    intercept: float
    thresholds: dict[str, float] = field(default_factory=dict)
    squares: dict[str, np.ndarray] | None = None  # Adagrad's sums while it learns

    def words(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to each slot's filters: words x slots x filters."""
        ids = np.array([word_ids(w, len(self.embed)) for w in words], np.int64).reshape(-1, 3)
        return np.einsum("nd,sdf->nsf", self.embed[ids].sum(1), self.filters).astype(np.float32)

    def pooled(self, parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """parts: words x slots x filters of texts that each end in two zero rows; starts: where they begin."""
        out, slot = [], 0
        for k, width in enumerate(WIDTHS):
            z = parts[:, slot].copy()
            for j in range(1, width):
                z[: len(z) - j] += parts[j:, slot + j]
            slot += width
            out.append(np.maximum(np.maximum.reduceat(z, starts, axis=0) + self.bias[k], 0))
        return np.concatenate(out, 1)


class Scorer:
    """Scores texts; keeps the parts of the words it has met, up to a bound."""

    def __init__(self, model: ToxicCnn, bound: int = 150_000):
        self.model, self.bound = model, bound
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((1, SLOTS, self.model.filters.shape[2]), np.float32)

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        if len(self.ids) > self.bound:
            self.clear()
        split_texts = [split(t) for t in texts]
        new = list({w for ws in split_texts for w in ws} - self.ids.keys())
        if new:
            new.sort()
            self.ids.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.words(new)])
        out = np.zeros(len(texts))
        for i, ws in enumerate(split_texts):  # text by text: a batch of long texts would take much memory at once
            at = np.fromiter((*map(self.ids.__getitem__, ws), 0, 0), np.int64, len(ws) + 2)
            out[i] = (self.model.pooled(self.table[at], np.zeros(1, np.int64)) @ self.model.out)[0]
        return np.clip(out + self.model.intercept, -30, 30)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(texts)))


class TextIds:
    """Hashes of a text's words, words x 3; keeps those of the words it has met, up to a bound."""

    def __init__(self, buckets: int, bound: int = 150_000):
        self.buckets, self.bound = buckets, bound
        self.at: dict[bytes, int] = {}
        self.table: list[tuple[int, int, int]] = []

    def of(self, text: str | None) -> np.ndarray:
        if len(self.at) > self.bound:
            self.at, self.table = {}, []
        ws = split(text)
        for w in ws:
            if w not in self.at:
                self.at[w] = len(self.table)
                self.table.append(word_ids(w, self.buckets))
        found, places = np.unique(np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)), return_inverse=True)
        return np.array([self.table[i] for i in found], np.int32).reshape(-1, 3)[places]


class Learner:
    """Adagrad over single texts; it changes the model's arrays in place."""

    def __init__(self, model: ToxicCnn, balance: float, rate: float):
        self.model, self.balance, self.rate = model, balance, rate
        if model.squares is None:
            model.squares = {k: np.full(np.shape(getattr(model, k)), 1e-2, np.float32) for k in ("embed", "filters", "bias", "out")} | {"intercept": np.array(1e-2)}

    def step(self, ids: np.ndarray, y: float) -> None:
        m, g2, rate = self.model, self.model.squares, self.rate
        n_filters = m.filters.shape[2]
        x = np.concatenate([m.embed[ids].sum(1), np.zeros((2, m.embed.shape[1]), np.float32)])
        pools, args, slot = [], [], 0
        for k, width in enumerate(WIDTHS):
            z = x @ m.filters[slot]
            for j in range(1, width):
                z[: len(z) - j] += x[j:] @ m.filters[slot + j]
            a = z.argmax(0)
            pools.append(z[a, np.arange(n_filters)] + m.bias[k])
            args.append(a)
            slot += width
        pool = np.concatenate(pools)
        act = np.maximum(pool, 0)
        d = (1 / (1 + np.exp(-np.clip(act @ m.out + m.intercept, -30, 30))) - y) * (self.balance if y else 1.0)
        if abs(d) < 1e-3:
            return
        back = (d * m.out * (pool > 0)).reshape(len(WIDTHS), n_filters)
        g = d * act
        g2["out"] += g * g
        m.out -= rate * g / np.sqrt(g2["out"])
        g2["intercept"] += d * d
        m.intercept -= float(rate * d / np.sqrt(g2["intercept"]))
        g2["bias"] += back * back
        m.bias -= rate * back / np.sqrt(g2["bias"])
        slot = 0
        for k, width in enumerate(WIDTHS):
            for j in range(width):
                at = args[k] + j
                inside = at < len(ids)
                rows = x[np.minimum(at, len(x) - 1)]
                step = rows.T * back[k]
                grad_x = (m.filters[slot + j] * back[k]).T
                g2["filters"][slot + j] += step * step
                m.filters[slot + j] -= rate * step / np.sqrt(g2["filters"][slot + j])
                for f in np.flatnonzero(inside & (back[k] != 0)):
                    own = ids[at[f]]
                    g2["embed"][own] += grad_x[f] ** 2
                    m.embed[own] -= rate * grad_x[f] / np.sqrt(g2["embed"][own])
            slot += width


def train_cnn(texts: list[str | None], labels: np.ndarray, buckets: int = 1 << 17, dims: int = 6, n_filters: int = 4, epochs: int = 6, rate: float = 0.05, seed: int = 11, counts: tuple[np.ndarray, np.ndarray] | None = None) -> ToxicCnn:
    """Adagrad over single texts. The first dimension starts as the smoothed log odds of a word's label.

    counts: of all texts to learn from, if these are only some of them: how many of each label hold a hash (2 x buckets),
    and how many there are (2).
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.02, (buckets, dims)).astype(np.float32)
    filters = rng.normal(0, 0.1, (SLOTS, dims, n_filters)).astype(np.float32)
    filters[:, 0] = np.abs(filters[:, 0]) + 0.1
    model = ToxicCnn(embed, filters, np.zeros((len(WIDTHS), n_filters), np.float32), np.full(len(WIDTHS) * n_filters, 0.3, np.float32), -2.0)
    text_ids = TextIds(buckets)
    docs = [text_ids.of(t) for t in texts]
    if counts is None:
        seen = np.zeros((2, buckets))
        for d, y in zip(docs, labels, strict=True):
            seen[int(y), np.unique(d)] += 1
        counts = seen, np.array([(labels == 0).sum(), (labels == 1).sum()])
    seen, (n0, n1) = counts
    if not n0 or not n1:
        model.out[:], model.intercept = 0, 4.0 if n1 else -4.0
        return model
    odds = np.log((seen[1] + 1) / (n1 + 2)) - np.log((seen[0] + 1) / (n0 + 2))
    odds[seen.sum(0) == 0] = np.log((n0 + 2) / (n1 + 2))
    trust = seen.sum(0) / (seen.sum(0) + 5)
    embed[:, 0] = np.clip(odds * trust, -1, 4) / 3
    own = (labels == 1).sum()
    learner = Learner(model, float((len(labels) - own) / own) ** 0.5 if own else 1.0, rate)
    for _ in range(epochs if 0 < own < len(labels) else 0):  # texts of one label would only teach that label
        for i in rng.permutation(len(docs)):
            learner.step(docs[i], labels[i])
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], beta: float = 0.5, times: np.ndarray | None = None) -> dict[str, float]:
    """For each language the threshold with the best F-beta; '' is for languages without rows of both labels.

    times: how many rows each entry stands for, if not one.
    """
    out = {}
    times = np.ones(len(labels)) if times is None else times
    for lang in ["", *sorted({x for x in langs if x})]:
        own = np.array([lang in ("", x) for x in langs], bool)
        s, y, n = scores[own], labels[own], times[own]
        if not len(y) or y.min() == y.max():
            continue
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum((y * n)[order])
        precision, recall = hit / np.cumsum(n[order]), hit / (y * n).sum()
        f = (1 + beta**2) * precision * recall / np.maximum(beta**2 * precision + recall, 1e-12)
        f[:-1][np.diff(s[order]) == 0] = -1  # equal scores are on one side
        k = int(f.argmax())
        below = s[order][k + 1] if k + 1 < len(s) else 0.0
        out[lang] = float((s[order][k] + below) / 2)
    return out | {"": out.get("", 0.5)}


def last_within(sizes: pd.DataFrame, max_bytes: int) -> int:
    """The largest hash up to which rows (_h, _n bytes) fit max_bytes in all."""
    sizes = sizes.groupby("_h")["_n"].sum().sort_index()  # rows that share a hash go together
    over = sizes.index[(sizes.cumsum() > max_bytes).to_numpy()]
    return int(over[0]) - 1 if len(over) else (1 << 63) - 1


def summed(df: DataFrame, run, columns: list[str]) -> pd.DataFrame:
    """What run yields from df, a key and numbers (long), with the numbers summed by key; keys are bounded in number."""
    made = df.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("key", *columns)))
    return made.groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()


def record(key: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(v), pa.int64()) for k, v in {"key": key, **columns}.items()})


def whole_counts(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """train_cnn's counts, of all rows (text, _label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_ids, seen = TextIds(buckets), np.zeros(2 * buckets + 2, np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y * buckets + np.unique(text_ids.of(t))] += 1
                seen[2 * buckets + y] += 1
        key = np.flatnonzero(seen)
        yield record(key, n=seen[key])

    found = summed(rows.select("text", "_label"), run, ["n"])
    out = np.zeros(2 * buckets + 2)
    out[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out[:-2].reshape(2, buckets), out[-2:]


def flat(model: ToxicCnn) -> np.ndarray:
    """All weights and Adagrad's sums side by side, keys x 2 x dims: the embeddings, then the others."""
    dims, out = model.embed.shape[1], []
    for own in (vars(model), model.squares):
        rest = np.concatenate([np.ravel(own[k]) for k in ("filters", "bias", "out", "intercept")]).astype(np.float64)
        out.append(np.concatenate([own["embed"], np.pad(rest, (0, -len(rest) % dims)).reshape(-1, dims)]))
    return np.stack(out, 1)


def put_back(model: ToxicCnn, values: np.ndarray) -> None:
    for k, own in enumerate((vars(model), model.squares)):
        own["embed"] = values[: len(model.embed), k].astype(np.float32)
        rest, at = values[len(model.embed) :, k].ravel(), 0
        for name in ("filters", "bias", "out"):
            own[name] = rest[at : at + own[name].size].reshape(own[name].shape).astype(np.float32)
            at += own[name].size
        own["intercept"] = float(rest[at]) if k == 0 else np.array(rest[at])


def learn_round(rows: DataFrame, model: ToxicCnn, balance: float, rate: float) -> None:
    """One round over all rows (_shard, text, _label), a shard's rows side by side in one partition.

    Each shard trains on from the model as it is. A weight then changes by the mean change of the shards that changed it.
    Changes are summed as whole numbers, so it makes no difference where shards lie and which ends first.
    """
    dims, sent = model.embed.shape[1], rows.sparkSession.sparkContext.broadcast(vars(model))
    columns = [f"d{i}" for i in range(2 * dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> Learner:
            own = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in sent.value.items()}
            return Learner(ToxicCnn(**own | {"squares": {k: v.copy() for k, v in own["squares"].items()}}), balance, rate)

        def close() -> None:
            change = flat(learner.model) - base
            key = np.flatnonzero(change.any((1, 2)))
            sums[key, 1:] += np.rint(np.clip(change[key] * np.array(UNITS)[:, None], -MOST, MOST)).astype(np.int64).reshape(len(key), -1)
            sums[key, 0] += 1

        learner, shard = fresh(), None
        base = flat(learner.model)
        text_ids, sums = TextIds(len(learner.model.embed)), np.zeros((len(base), 1 + 2 * dims), np.int64)
        for b in batches:
            for s, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard and shard is not None:
                    close()
                    learner = fresh()
                shard = s
                learner.step(text_ids.of(t), y)
        if shard is not None:
            close()
        key = np.flatnonzero(sums[:, 0])
        yield record(key, n=sums[key, 0], **{c: sums[key, 1 + i] for i, c in enumerate(columns)})

    found = summed(rows.select("_shard", "text", "_label"), run, ["n", *columns])
    sent.destroy()
    values = flat(model)
    mean = found[columns].to_numpy(np.float64) / found[["n"]].to_numpy(np.float64)
    values[found["key"].to_numpy(np.int64)] += mean.reshape(-1, 2, dims) / np.array(UNITS)[:, None]
    put_back(model, values)


def whole_thresholds(rows: DataFrame, model: ToxicCnn) -> dict[str, float]:
    """calibrate over all rows (text, lang, _label), with thresholds at multiples of 1 / GRID of the log odds."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ToxicCnn(**sent.value))
        for b in batches:
            place = np.floor((scorer.log_odds(b.column(0).to_pylist()) + 32) * GRID)  # above 0
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(place.astype(np.int64))], ["lang", "_label", "place"])

    found = rows.select("text", "lang", "_label").mapInArrow(tidy(run), "lang string, _label int, place long").groupBy("lang", "_label", "place").count().toPandas()
    sent.destroy()
    found = found.sort_values(["lang", "place", "_label"])
    out = calibrate(found["place"].to_numpy(np.float64), found["_label"].to_numpy(np.float64), found["lang"].tolist(), times=found["count"].to_numpy(np.float64))
    places = {k: np.ceil(v) for k, v in out.items() if v != 0.5}  # 0.5: no rows of both labels
    return {"": 0.5} | {k: float(1 / (1 + np.exp(32 - v / GRID))) for k, v in places.items()}


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_each: int = 3000, max_bytes: int = 48 << 20, rounds: int = 2, buckets: int = 1 << 17, rate: float = 0.05, **options) -> ToxicCnn:
    """Learn from all documents with a usable label: four fifths teach the model, one fifth the thresholds.

    Weights to start from are trained on the driver, from at most max_each documents of each label, those whose hashed
    doc_id is smallest, and of these, in this order, from as many as have whole texts of max_bytes / 2 in all, without
    texts over max_bytes / 64: so no more than max_bytes of texts come to the driver. The rounds then take all documents.

    Of several labels or texts of a doc_id the least counts, so rows that are repeated or in another order teach the same.
    """
    tune(docs.sparkSession)
    own = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    own, n = counted(own.where(F.col("_label").isin(0, 1)))
    text = F.col("text").cast("string").alias("text")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang") if "lang" in docs.columns else F.lit("").alias("lang")
    n_shards = max(1, -(-n // SHARD_ROWS))
    hashed = {"_h": F.xxhash64("_id"), "_kept": F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) == 0, "_shard": F.pmod(F.xxhash64("_id", F.lit(n_shards)), F.lit(n_shards)).cast("int")}
    found = docs.select("doc_id", text, lang).join(aid(own, n), F.col("doc_id") == F.col("_id")).withColumns(hashed)
    order = Window.partitionBy("_shard", "_h", "_id").orderBy("text", "lang")
    found = found.repartition("_shard").withColumn("_row", F.row_number().over(order)).where("_row = 1")
    found = cut(found.select("_shard", "text", "lang", "_label", "_h", "_kept", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_n")))
    fit = found.where(~F.col("_kept"))
    counts = whole_counts(fit, buckets)
    few = [fit.where((F.col("_n") <= max_bytes // 64) & (F.col("_label") == k)).select("_h", "_n").orderBy("_h", "_n").limit(max_each).toPandas() for k in (0, 1)]
    last = [min(last_within(x, max_bytes // 2), int(x["_h"].max())) if len(x) else -(1 << 63) for x in few]
    rows = fit.where((F.col("_n") <= max_bytes // 64) & (F.col("_h") <= F.when(F.col("_label") == 1, last[1]).otherwise(last[0]))).select("text", "lang", "_label").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("text", "lang", "_label")), strict=True), key=lambda r: (r[0] or "", r[1], r[2]))
    model = train_cnn([r[0] for r in rows], np.array([r[2] for r in rows], np.float32), buckets=buckets, rate=rate, counts=counts, **options)
    if counts[1].all():
        for _ in range(rounds):
            learn_round(fit, model, float(counts[1][0] / counts[1][1]) ** 0.5, rate)
    model.squares = None
    model.thresholds = whole_thresholds(found.where("_kept"), model)
    return model


def score(docs: DataFrame, model: ToxicCnn) -> DataFrame:
    """All columns of docs and ``score``, the probability of label 1. Only the text is read, whole.

    A null or empty text has no words and takes the score of an empty pool. Repeated rows score alike, a column that is
    itself called score is replaced, an empty table stays empty.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score")
    found = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: workers unpickle no class of ours
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ToxicCnn(**found.value))
        for b in batches:
            s = scorer.score(b.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(tidy(run), docs.withColumn("score", F.lit(0.0)).schema)


def threshold(model: ToxicCnn, lang: Column) -> Column:
    """The calibrated threshold of a language column; it decides a flag, never a score."""
    out = F.lit(model.thresholds.get("", 0.5))
    for k, v in sorted(model.thresholds.items()):
        if k:
            out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out
