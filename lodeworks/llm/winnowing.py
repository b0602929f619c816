"""Benchmark decontamination by winnowing.

A window of ``window`` consecutive words holds window - k + 1 k-grams; its fingerprint is the least of their hashes.
Equal windows have equal fingerprints, so joining the fingerprints of documents with those of benchmark items finds every
shared span of a window or more. Runs of neighbouring windows with one fingerprint are kept once; where a k-gram recurs
and makes a run longer, once in every window - k + 1 windows at least. A hit is extended to as many windows and confirmed
on the words themselves.

Everything here is DataFrame functions. Arrays that are never empty are exploded by explode_outer: explode would have
the optimizer add a filter on the array's size and push it through all projections, which inlines each array of hashes
into the lambda that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text.cast("string")), SPLIT), ""), F.array().cast("array<string>"))


def _grams(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` words, by its first word."""
    n = F.size(hashes)
    at = F.sequence(F.lit(0), n - size)
    return F.when(n >= size, F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, span: int) -> Column:
    n = F.size(grams)
    at = F.sequence(F.lit(0), n - span)
    return F.when(n >= span, F.transform(at, lambda i: F.least(*(F.get(grams, i + j) for j in range(span))))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds _minima: the fingerprint of each window of df's _words, by its first word."""
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_grams", _grams(F.col("_hashes"), k))
    return df.withColumn("_minima", _minima(F.col("_grams"), window - k + 1)).drop("_grams")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """For each document (doc_id, text) how many of its words lie in a window of an item (item_id, text).

    An item of fewer words than a window, but not none, is one window. Returns doc_id, n_words, n_hit, hits (array of the
    windows' start and length), items (array of item_ids as strings, sorted). Null and empty texts have no words; rows
    that share a doc_id, null included, are one document (n_words is the largest); other columns are ignored; an empty
    table on either side gives no hits.

    The items' windows are broadcast while they are at most broadcast_rows (some 40 MB), else joined by shuffles.
    """
    span = window - k + 1
    own = items.select(F.col("item_id").cast("string").alias("_item"), words_of(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    own = fingerprints(own, k, window)
    n = F.size("_words")
    whole = F.array(F.struct(n.alias("len"), F.xxhash64("_hashes").alias("print"), F.concat_ws(" ", "_words").alias("words")))
    parts = F.transform("_minima", lambda m, i: F.struct(F.lit(window).alias("len"), m.alias("print"), F.concat_ws(" ", F.slice("_words", i + 1, window)).alias("words")))
    windows = own.select("_item", F.explode_outer(F.when(n < window, whole).otherwise(parts)).alias("w")).select("_item", "w.*")
    windows = windows.groupBy("len", "print", "words").agg(F.collect_set("_item").alias("_items"))
    spark = docs.sparkSession
    one = spark.range(1).select(F.lit(0).alias("len"), F.lit(0).cast("long").alias("print"), F.lit("").alias("words"), F.array().cast("array<string>").alias("_items"))
    windows = windows.union(one)  # what a document's own first row meets: each document stays
    facts = windows.agg(F.count("*").alias("n"), F.collect_set(F.when((F.col("len") > 0) & (F.col("len") < window), F.col("len"))).alias("short")).first()
    small, short = facts["n"] <= broadcast_rows, sorted(facts["short"])
    aid = F.broadcast if small else (lambda df: df)

    texts = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    prints = fingerprints(texts, k, window)
    entry = lambda size, m, i: F.struct(F.lit(size).alias("len"), m.alias("print"), i.alias("at"))
    before = lambda i, j: F.get("_minima", i - j)
    # an entry stands for span windows: a longer run is entered again at its window span, then wherever span divides i
    again = lambda m, i: (m == before(i, span)) & ((i % span == 0) | (before(i, 1) != before(i, span + 1)))
    runs = F.filter(F.transform("_minima", lambda m, i: F.when((i == 0) | (m != before(i, 1)) | again(m, i), entry(window, m, i))), lambda x: x.isNotNull())

    def whole_items(size: int) -> Column:  # a lambda's second parameter would be the index
        return F.transform(F.sequence(F.lit(0), F.size("_hashes") - size), lambda i: entry(size, F.xxhash64(F.slice("_hashes", i + 1, size)), i))

    brief = [whole_items(s) for s in short]
    brief = [F.when(F.size("_hashes") >= s, b).otherwise(F.array().cast("array<struct<len:int,print:bigint,at:int>>")) for s, b in zip(short, brief, strict=True)]
    first = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).cast("long").alias("print"), F.lit(0).alias("at")))
    prints = prints.select("doc_id", "_words", F.concat(first, runs, *brief).alias("_prints"))
    known = windows.select("len", "print").distinct()
    found = prints.select("doc_id", *(["_words"] if small else []), F.explode_outer("_prints").alias("_p")).select("*", F.col("_p.len").alias("len"), F.col("_p.print").alias("print"), F.col("_p.at").alias("at")).drop("_p")
    found = found.join(aid(known), ["len", "print"]).drop("print")
    if not small:  # words don't travel with the fingerprints: the hits go back to their documents
        hits = found.groupBy("doc_id").agg(F.collect_set(F.struct("len", "at")).alias("_hits"))
        found = hits.join(texts.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "_words", F.explode_outer("_hits").alias("_h")).select("doc_id", "_words", "_h.len", "_h.at")
    last = F.least(F.col("at") + span - 1, F.size("_words") - window)
    starts = F.when(F.col("len") == window, F.sequence(F.col("at"), last)).otherwise(F.array("at"))
    found = found.select("doc_id", F.size("_words").alias("n_words"), "len", F.explode_outer(F.transform(starts, lambda s: F.struct(s.alias("start"), F.concat_ws(" ", F.slice("_words", s + 1, F.col("len"))).alias("words")))).alias("s")).select("doc_id", "n_words", "len", "s.*")
    met = found.join(aid(windows.select("len", "words", "_items")), ["len", "words"])
    spot = F.struct(F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("length"))
    out = met.groupBy("doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("len") > 0, spot))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["length"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end")),
    )["n"]
    return out.select("doc_id", "n_words", covered.alias("n_hit"), "hits", "items")
