"""Comment samples of a post: profile, sentiment, its course over snapshots, and the discussion's quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _weighted(score: str = "compound") -> Column:
    """Mean of the scores known, weighted by upvotes (1 at least)."""
    weight = F.greatest(F.lit(1.0), F.coalesce(F.col("upvotes").cast("double"), F.lit(1.0)))
    known = F.col(score).isNotNull()
    return F.try_divide(F.sum(F.when(known, F.col(score) * weight)), F.sum(F.when(known, weight)))


def comment_profile(comments: DataFrame, authors: DataFrame, keys: list[str]) -> DataFrame:
    """Measures of the comments sampled at each (snapshot, post): counts, shares, upvotes, words, ages, sentiment (null compound: not scored).

    authors: post_id, post_author. Shares of sentiment and the population variance are null without (two) scored comments."""
    c = comments.join(authors, "post_id", "left")
    who, body = F.lower(F.trim(F.coalesce("author", F.lit("")))), F.coalesce("body", F.lit(""))
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    words = F.regexp_count(body, F.lit(r"[^ \t\n\r\f]+")).cast("double")
    top = F.coalesce(F.col("is_top_level"), F.lit(False))
    s, age = F.col("compound"), F.col("age_minutes")
    return c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_comments"),
        F.count_if(top).alias("n_top_level"),
        F.count_if(~top).alias("n_replies"),
        share(top).alias("top_level_share"),
        F.count_distinct(F.nullif(who, F.lit(""))).alias("n_commenters"),
        share(who == "[deleted]").alias("deleted_share"),
        share(body.contains("?")).alias("question_share"),
        F.max(F.coalesce((who == F.lower("post_author")) & (who != ""), F.lit(False)).cast("int")).alias("op_replied"),
        F.avg("upvotes").alias("avg_upvotes"),
        F.max("upvotes").alias("max_upvotes"),
        F.avg(words).alias("avg_words"),
        F.max(words).alias("max_words"),
        F.min(age).alias("newest_age"),
        F.max(age).alias("oldest_age"),
        F.when(F.count(age) >= 2, F.max(age) - F.min(age)).alias("age_span"),
        F.avg(s).alias("sentiment_mean"),
        _weighted().alias("sentiment_weighted"),
        F.avg((s >= 0.05).cast("double")).alias("positive_share"),
        F.avg((s <= -0.05).cast("double")).alias("negative_share"),
        F.when(F.count(s) >= 2, F.var_pop(s)).alias("sentiment_variance"),
    )


def snapshot_sentiment(comments: DataFrame, keys: list[str]) -> DataFrame:
    """Scored comments of each (snapshot, post): count, mean and weighted sentiment, shares beyond 0.05 (strictly), sample variance (0 for one)."""
    s = F.col("compound")
    return comments.where(s.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), _weighted().alias("weighted"), F.avg((s > 0.05).cast("double")).alias("pos_share"), F.avg((s < -0.05).cast("double")).alias("neg_share"), F.coalesce(F.var_samp(s), F.lit(0.0)).alias("variance"))


def sentiment_trajectory(snapshots: DataFrame, order: str, key: str = "post_id") -> DataFrame:
    """Per post with two scored snapshots or more: weighted sentiment at the first, middle (place n / 2) and last one, changes, slope per snapshot, flip, peak, trough, volatility."""
    w = Window.partitionBy(key)
    r = snapshots.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2")
    at = lambda c, place: F.max(F.when(F.col("_i") == place, F.col(c)))
    first, last, mid = F.lit(0), F.col("_n") - 1, F.floor(F.col("_n") / 2)
    g = r.groupBy(key).agg(
        F.max("_n").alias("n_snapshots"), at("weighted", first).alias("first_sentiment"), at("weighted", mid).alias("mid_sentiment"), at("weighted", last).alias("last_sentiment"),
        (at("variance", last) - at("variance", first)).alias("variance_change"), (at("neg_share", last) - at("neg_share", first)).alias("neg_share_change"),
        F.max("weighted").alias("peak"), F.min("weighted").alias("trough"), at("n", first).alias("first_count"), at("n", last).alias("last_count"),
    )
    a, b = F.col("first_sentiment"), F.col("last_sentiment")
    flip = F.when((a > 0.05) & (b < -0.05), "pos_to_neg").when((a < -0.05) & (b > 0.05), "neg_to_pos").when((a > 0.05) & (b > 0.05), "stayed_positive").when((a < -0.05) & (b < -0.05), "stayed_negative").otherwise("neutral")
    return g.withColumn("sentiment_change", b - a).withColumn("sentiment_slope", (b - a) / F.col("n_snapshots")).withColumn("volatility", F.col("peak") - F.col("trough")).withColumn("flip", flip)


def discussion_quality(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Score from 0 to 100 of each group: four means (questions, upvotes, commenters, words), each worth 25 at most; and its label."""
    part = lambda c, scale: F.least(F.avg(c) * scale, F.lit(25.0))
    g = profiles.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (part("question_share", 100.0) + part("avg_upvotes", 0.5) + part("n_commenters", 0.25) + part("avg_words", 1 / 6)).alias("_s"))
    label = F.when(F.col("_s") >= 75, "deep & engaged").when(F.col("_s") >= 55, "good discussion").when(F.col("_s") >= 35, "moderate").otherwise("shallow / low engagement")
    return g.select(*by, "n", F.bround("_s", 0).alias("score"), label.alias("label"))


def sentiment_signal(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Multiplier (0.7 to 1.3) and label of each group's mean sentiment, weighted where known; groups without any: 1, "insufficient sentiment data"."""
    g = profiles.groupBy(*by).agg(F.avg(F.coalesce("sentiment_weighted", "sentiment_mean")).alias("avg_sentiment"))
    s = F.col("avg_sentiment")
    pick = lambda values: F.when(s.isNull(), values[0]).when(s > 0.15, values[1]).when(s > 0.05, values[2]).when(s < -0.15, values[3]).when(s < -0.05, values[4]).otherwise(values[5])
    return g.select(*by, "avg_sentiment", pick([1.0, 1.3, 1.1, 0.7, 0.9, 1.0]).alias("multiplier"), pick(["insufficient sentiment data", "strongly positive", "mildly positive", "strongly negative", "mildly negative", "neutral"]).alias("label"))
