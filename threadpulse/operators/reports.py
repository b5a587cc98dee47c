"""Reports: forecasts against what came, domains, pairs by community, discussions' moods, sentiment bands, keyword lifts of growth, declines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import lookup, recommendation, safe_ratio, STATE_MULTIPLIER, zero
from .groups import alive, gini
from .topics import pair_rows

SURGE, ACTIVE, DIE = ("surge_watch",), ("surge_watch", "active_watch"), ("cooling_watch", "dying_watch", "stop_watch")


def forecast_text(score: Column, upvote_slope: Column, comment_slope: Column) -> Column:
    """What a health score lets expect, with the signs of both slopes (unknown: neither)."""
    up, down = (zero(upvote_slope) > 0) & (zero(comment_slope) > 0), (zero(upvote_slope) < 0) & (zero(comment_slope) < 0)
    return F.when(score < 25, "at risk of dying").when(score < 50, F.when(up, "recovering").otherwise("at risk")).when(score < 75, F.when(down, "declining").otherwise("stable")).otherwise(F.when(up, "growing").otherwise("stable"))


def forecast_labels(rows: DataFrame) -> DataFrame:
    """State rows that the next snapshot has too (next_state, next_upvote_delta, next_comment_delta): predicted and actual growth, never negative, and both recommendations."""
    m = lookup(STATE_MULTIPLIER, F.col("state"), 0.5)
    pos = lambda c: F.greatest(zero(c), F.lit(0.0))
    p = {"predicted_upvotes": pos("upvote_velocity") * m, "predicted_comments": pos("comment_velocity") * m, "actual_upvotes": pos("next_upvote_delta"), "actual_comments": pos("next_comment_delta")}
    r = rows.withColumns(p)
    return r.withColumns({"predicted": recommendation(F.col("state"), F.col("predicted_upvotes"), F.col("predicted_comments")), "actual": recommendation(F.col("next_state"), F.col("actual_upvotes"), F.col("actual_comments"))})


def recommendation_report(labels: DataFrame, by: str = "community") -> DataFrame:
    """Per group and (group null) overall: rows, mean errors of both measures, share of equal recommendations, and how many were predicted to surge, to be active and to die, with the share that did."""
    hit = lambda kinds: (F.col("predicted").isin(*kinds), F.col("predicted").isin(*kinds) & F.col("actual").isin(*kinds))
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in ("upvotes", "comments"):
        e = F.col(f"predicted_{m}") - F.col(f"actual_{m}")
        aggs += [F.avg(F.abs(e)).alias(f"{m}_mae"), F.sqrt(F.avg(e * e)).alias(f"{m}_rmse")]
    aggs.append(F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("exact_match"))
    for name, kinds in (("surge", SURGE), ("active", ACTIVE), ("die", DIE)):
        a, b = hit(kinds)
        aggs += [F.count_if(a).alias(f"predicted_{name}"), F.try_divide(F.count_if(b), F.nullif(F.count_if(a), F.lit(0))).alias(f"{name}_precision")]
    return labels.groupingSets([[by], []], by).agg(*aggs)


def domain_report(posts: DataFrame, least: int = 5) -> DataFrame:
    """Per link domain with `least` posts or more whose state is known: posts, median and mean upvotes, share of living (surging, alive) and of dead or dying ones, communities."""
    known = posts.where((F.coalesce("domain", F.lit("")) != "") & F.col("state").isNotNull() & (F.col("state") != "unknown"))
    g = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n_posts"), F.percentile(F.coalesce("upvotes", F.lit(0)), 0.5).alias("median_upvotes"), F.avg(F.coalesce("upvotes", F.lit(0))).alias("avg_upvotes"), F.avg(alive().cast("double")).alias("alive_rate"), F.avg(F.col("state").isin("dead", "dying").cast("double")).alias("dead_rate"), F.count_distinct("community").alias("n_communities"))
    return g.where(F.col("n_posts") >= least)


def pair_community_days(posts: DataFrame, words: str) -> DataFrame:
    """Per (day, pair of a title's words, community): posts, upvotes, best and mean comments, best and mean velocity (unknown: 0)."""
    s = posts.select("day_no", "community", "upvotes", zero("comments").alias("comments"), zero("velocity").alias("velocity"), words)
    long = pair_rows(s, words, ["day_no", "community", "upvotes", "comments", "velocity"])
    per = long.groupBy("day_no", "_a", "_b", "community").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("upvotes").alias("total_upvotes"), F.max("comments").alias("best_comments"), F.avg("comments").alias("avg_comments"), F.max("velocity").alias("best_velocity"), F.avg("velocity").alias("avg_velocity"))
    return per.select("day_no", F.concat("_a", F.lit("+"), "_b").alias("pair"), "community", "n_posts", "total_upvotes", "best_comments", "avg_comments", "best_velocity", "avg_velocity")


def discussion_moods(comments: DataFrame) -> DataFrame:
    """Per post with scored comments: upvotes' sum, maximum, mean, median, gini and top share, and mean sentiment of all, weighted, of the 3 most upvoted, the lower half, their gap, the earliest and latest third by age, top-level comments and replies (0 where a part is empty).

    Order among equal upvotes or ages is by comment_id."""
    c = comments.where(F.col("compound").isNotNull()).withColumn("_u", F.coalesce(F.col("upvotes").cast("double"), F.lit(0.0)))
    w = Window.partitionBy("post_id")
    r = c.withColumns({"_n": F.count(F.lit(1)).over(w), "_by_up": F.row_number().over(w.orderBy(F.desc("_u"), "comment_id")) - 1, "_by_age": F.row_number().over(w.orderBy("age_minutes", "comment_id")) - 1})
    n, s = F.col("_n"), F.col("compound")
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, s)), F.lit(0.0))
    weight = F.greatest(F.lit(1.0), F.col("_u"))
    top = F.coalesce(F.col("is_top_level"), F.lit(False))
    per = r.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum("_u").alias("total_upvotes"), F.max("_u").alias("max_upvotes"), F.avg("_u").alias("mean_upvotes"), F.percentile("_u", 0.5).alias("median_upvotes"), F.coalesce(safe_ratio(F.max("_u"), F.sum("_u")), F.lit(0.0)).alias("top_share"),
        mean(F.col("_by_up") < 3).alias("top3_sentiment"), mean(F.col("_by_up") >= F.floor(n / 2)).alias("bottom_sentiment"), mean(F.col("_by_age") < F.greatest(F.floor(n / 3), F.lit(1))).alias("early_sentiment"), mean(F.col("_by_age") >= F.floor(n * 2 / 3)).alias("late_sentiment"),
        F.avg(s).alias("all_sentiment"), (F.sum(s * weight) / F.sum(weight)).alias("weighted_sentiment"), mean(top).alias("top_level_sentiment"), mean(~top).alias("reply_sentiment"),
    )
    g = gini(c.select("post_id", "_u"), "post_id", "_u").select("post_id", "gini")
    return per.join(g, "post_id").withColumn("sentiment_gap", F.col("top3_sentiment") - F.col("bottom_sentiment"))


#: Sentiment bands and where each begins
SENTIMENT_BANDS = ((-1.0, "Very negative"), (-0.3, "Mildly negative"), (-0.05, "Neutral"), (0.05, "Mildly positive"), (0.3, "Very positive"))


def sentiment_bands(posts: DataFrame) -> DataFrame:
    """Per band of title sentiment (compound): posts, share of living ones, median and mean upvotes."""
    band = F.lit(None).cast("string")
    for low, name in SENTIMENT_BANDS:
        band = F.when(F.col("compound") >= low, name).otherwise(band)
    return posts.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(alive().cast("double")).alias("alive_rate"), F.percentile("upvotes", 0.5).alias("median_upvotes"), F.avg("upvotes").alias("avg_upvotes"))


def growth_lift(rows: DataFrame, keys: str, least: int = 25) -> DataFrame:
    """Per keyword of `least` snapshot rows or more: means of next upvote and comment deltas and of velocities (unknown: 0), their difference and ratio to all rows', and the share of rows above all rows' mean delta. The all-rows means are one row."""
    names = ("next_upvote_delta", "next_comment_delta", "upvote_velocity", "comment_velocity")
    base = rows.select(keys, *[zero(c).cast("double").alias(c) for c in names])
    every = base.agg(*[F.avg(c).alias(f"all_{c}") for c in names])
    both = base.crossJoin(F.broadcast(every)).select(F.explode(keys).alias("keyword"), *names, *[f"all_{c}" for c in names])
    strong = lambda c: F.avg((F.col(c) > F.col(f"all_{c}")).cast("double"))
    per = both.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names], *[F.first(f"all_{c}").alias(f"all_{c}") for c in names[:2]], strong(names[0]).alias("strong_upvote_share"), strong(names[1]).alias("strong_comment_share")).where(F.col("n") >= least)
    return per.select("keyword", "n", *names, *[(F.col(c) - F.col(f"all_{c}")).alias(f"{c}_lift") for c in names[:2]], *[safe_ratio(F.col(c), F.col(f"all_{c}")).alias(f"{c}_ratio") for c in names[:2]], "strong_upvote_share", "strong_comment_share")


def declines(states: DataFrame) -> DataFrame:
    """(day, topic) rows that surge, grow or are stable and whose next day is an observed one: whether they cool, die or are dead then."""
    return states.where(F.col("state").isin("surging", "growing", "stable") & F.col("next_state").isNotNull()).select("day_no", "topic", "n_posts", "yesterday", "state", F.col("next_state").isin("cooling", "dying", "dead").cast("int").alias("declines"))
