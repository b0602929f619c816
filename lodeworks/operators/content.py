"""Content-based recommendation: TF-IDF word profiles and binary cosine scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, clean, tokens


def tfidf_profile(df: DataFrame, business: str, text: str, stopwords: list[str] | None = None, rare_max: int = 35, top: int = 200) -> DataFrame:
    """business_id, word, tf, weight, rank: the ``top`` words of each business by weight, ties by word, descending.

    Words on the stop list and words that occur rare_max times or fewer overall are left out; a word's count is divided
    by the business's largest count.
    """
    words = df.select(F.col(business).alias("business_id"), F.explode(tokens(clean(F.col(text)))).alias("word")).where(F.col("business_id").isNotNull() & ~F.col("word").isin(list(stopwords or STOPWORDS)))
    counts = words.groupBy("business_id", "word").agg(F.count("*").alias("tf"))
    per_word = counts.groupBy("word").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).where(F.col("all") > rare_max)
    n = df.select(business).where(F.col(business).isNotNull()).distinct().agg(F.count("*").alias("n"))
    own = Window.partitionBy("business_id")
    rows = counts.join(per_word, "word").withColumn("m", F.max("tf").over(own)).join(F.broadcast(n))  # one row
    rows = rows.withColumn("weight", F.round(F.log2(F.col("n") / F.col("df")) * F.col("tf") / F.col("m"), 9))
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("weight"), F.desc("word"))))
    return ranked.where(F.col("rank") <= top).select("business_id", "word", "tf", "weight", "rank")


def content_scores(reviews: DataFrame, profile: DataFrame, test: DataFrame, min_reviews: int = 3, threshold: float = 0.01) -> DataFrame:
    """user_id, business_id, sim of the test pairs with sim >= threshold; repeated test rows stay.

    A user's words are those of all businesses they reviewed, if they wrote at least min_reviews reviews.
    """
    users = reviews.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_reviews).select("user_id")
    seen = reviews.select("user_id", "business_id").distinct().join(users, "user_id", "left_semi")
    words = profile.select("business_id", "word")
    of_user = seen.join(words, "business_id").select("user_id", "word").distinct()
    n_user = of_user.groupBy("user_id").agg(F.count("*").alias("nu"))
    n_business = words.groupBy("business_id").agg(F.count("*").alias("nb"))
    pairs = test.select("user_id", "business_id").distinct()
    common = pairs.join(words, "business_id").join(of_user, ["user_id", "word"]).groupBy("user_id", "business_id").agg(F.count("*").alias("k"))
    sim = common.join(n_user, "user_id").join(n_business, "business_id").select("user_id", "business_id", F.round(F.col("k") / (F.sqrt("nu") * F.sqrt("nb")), 9).alias("sim"))
    return test.select("user_id", "business_id").join(sim.where(F.col("sim") >= threshold), ["user_id", "business_id"])
