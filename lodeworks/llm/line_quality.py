"""Quality rules from the frequency of lines across documents.

Normalised lines are hashed with their host; lines that more documents of one host hold than a limit allows are taken
for boilerplate and removed; a document that keeps too little is rejected. Simple rules on each text come first.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aid, counted

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, BLANK), ""), F.array().cast("array<string>"))


def base_figures(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row; a null text has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("_text"), words_of(text).alias("_words"))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    grams = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(window))))
    df = df.withColumn("_g", F.when(n >= window, grams).otherwise(F.array().cast("array<bigint>")))
    # only texts in which a window comes twice are sorted to find where
    twice = F.size(F.array_distinct("_g")) < F.size("_g")
    df = df.withColumn("_s", F.when(twice, F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i, j: F.coalesce(F.get(F.col("_s"), j)["g"] == x["g"], F.lit(False))
    df = df.withColumn("_at", F.when(twice, F.array_sort(F.transform(F.filter("_s", lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_at", i + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, _row, _key (host and normalised line, hashed), _words, for each line with a word; a null host is a host."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.coalesce(F.concat(F.lit("h:"), F.col(host).cast("string")), F.lit("")).alias("_host"), lines.alias("_lines"))
    df = df.select("doc_id", "_row", "_host", F.explode_outer("_lines").alias("_line"))  # rows are numbered before they are exploded
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower("_line"), BLANK, " "), "[0-9]+", "0"))
    df = df.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "_row", "_host", line.alias("_line"))
    return df.select("doc_id", "_row", F.xxhash64("_host", "_line").alias("_key"), F.size(F.split("_line", " ")).cast("long").alias("_words"))


def judged(docs: DataFrame, host: str = "source", max_docs: int = 10, keep_share: float = 0.5, min_words: int = 20) -> DataFrame:
    """A row for each document (doc_id): its base figures, base_failed, removed_words, kept.

    A line is boilerplate on a host if more than max_docs of its documents hold it, however many the host has. A
    document is kept if it doesn't fail the base rules (n_words under min_words, or more than 30 % of the words in
    repeated 8-word windows), and of its words at least min_words and keep_share are left without boilerplate lines.
    Rows that share a doc_id, null included, are one document: its figures are the largest of the rows'. Null and empty
    texts fail; other columns are ignored; an empty table gives an empty result.

    The boilerplate lines' hashes are broadcast while they are few enough, else joined by shuffles.
    """
    lines = host_lines(docs, host)
    per_doc = lines.select("_key", "doc_id").distinct()
    frequent, n_frequent = counted(per_doc.groupBy("_key").agg(F.count("*").alias("_docs")).where(F.col("_docs") > max_docs).select("_key"))
    removed = lines.join(aid(frequent, n_frequent), "_key").groupBy("doc_id", "_row").agg(F.sum("_words").alias("removed_words"))
    figures = base_figures(docs)
    zero = F.lit(0).cast("long")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = figures.select("doc_id", *names, zero.alias("removed_words")).unionByName(removed.select("doc_id", *(zero.alias(c) for c in names), "removed_words"))
    out = rows.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in [*names, "removed_words"]))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (left >= min_words) & (left >= F.col("n_words") * keep_share))
