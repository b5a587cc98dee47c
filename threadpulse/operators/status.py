"""Posts as they stand: comment aggregates, lifecycle with scores, boards, watchlists, snapshot catalog, subreddit summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.states import decayed_total, die_soon_score, lookup, predicted_state, recommendation, STATE_DECAY, STATE_MULTIPLIER, THRESHOLDS, zero

POST = ["community", "post_id"]


def comment_aggregates(comments: DataFrame) -> DataFrame:
    """One row per post of comments as snapshots saw them (community, post_id, snapshot_no, author, upvotes, replies, is_top_level): what the latest snapshot
    had, sums over all and the greatest of any. First per snapshot, then per post, both with partial aggregation."""
    author = F.nullif(F.lower(F.trim("author")), F.lit(""))
    per = comments.groupBy(*POST, "snapshot_no").agg(
        F.count(F.lit(1)).alias("comments"), F.count_if(F.col("is_top_level") == 1).alias("top_level"), F.count_distinct(author).alias("commenters"), F.coalesce(F.sum("upvotes"), F.lit(0.0)).alias("upvotes"), F.coalesce(F.sum("replies"), F.lit(0)).cast("double").alias("replies"),
        F.avg("upvotes").alias("avg_upvotes"), F.max("upvotes").alias("max_upvotes"), F.max("replies").cast("double").alias("max_replies"),
    )
    last = lambda c: F.max_by(c, "snapshot_no")
    return per.groupBy(*POST).agg(
        F.count(F.lit(1)).alias("comment_snapshots"), F.max("snapshot_no").alias("latest_comment_snapshot"), last("comments").alias("latest_comments"), last("top_level").alias("latest_top_level"), last(F.col("comments") - F.col("top_level")).alias("latest_reply_comments"),
        last("commenters").alias("latest_commenters"), last("upvotes").alias("latest_upvotes"), last("replies").alias("latest_replies"), last("avg_upvotes").alias("latest_avg_upvotes"), last("max_upvotes").alias("latest_max_upvotes"), last("max_replies").alias("latest_max_replies"),
        F.sum("upvotes").alias("total_upvotes"), F.sum("replies").alias("total_replies"), F.max("max_upvotes").alias("max_upvotes_seen"), F.max("max_replies").alias("max_replies_seen"), F.max("comments").alias("max_comments_seen"), F.max("upvotes").alias("most_upvotes_in_snapshot"), F.max("replies").alias("most_replies_in_snapshot"),
    )


def post_status(rows: DataFrame, aggregates: DataFrame) -> DataFrame:
    """One row per post of state rows (with listing and rank): lifecycle, settled state, priority and the three scores. Posts without comments have null aggregates."""
    order = F.struct("hours", "snapshot_no", "rank")
    first, last = lambda c: F.min_by(c, order), lambda c: F.max_by(c, order)
    in_order = lambda c: F.concat_ws("|", F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct("hours", "snapshot_no", c))), lambda x: x[c])))
    per = rows.groupBy(*POST).agg(
        F.count(F.lit(1)).alias("snapshot_count"), (F.max("hours") - F.min("hours")).alias("observed_hours"), last("age_minutes").alias("age_minutes"), first("listing").alias("first_listing"), last("listing").alias("last_listing"), in_order("listing").alias("listings_seen"),
        F.min("rank").alias("best_rank"), last("rank").alias("latest_rank"), last("state").alias("raw_state"), F.max("upvotes").alias("max_upvotes"), F.max("comments").alias("max_comments"), (last("upvotes") - first("upvotes")).alias("upvote_growth"), (last("comments") - first("comments")).alias("comment_growth"),
        last("upvote_velocity").alias("last_upvote_velocity"), last("comment_velocity").alias("last_comment_velocity"), F.count_if(F.col("still_visible_next") == 1).alias("visible_next_count"), F.min("snapshot_no").alias("first_snapshot"), F.max("snapshot_no").alias("last_snapshot"), *[last(k).alias(k) for k in THRESHOLDS],
    )
    moves = (zero("last_upvote_velocity") > F.col("dead_upvotes")) | (zero("last_comment_velocity") > F.col("dead_comments"))
    both = per.join(aggregates.drop("total_upvotes", "total_replies"), POST, "left").withColumn("latest_state", scores.settled_state(F.col("raw_state"), F.col("snapshot_count"), F.col("age_minutes"), moves))
    both = both.withColumn("engagement", scores.engagement_score())
    return both.withColumns({"popularity": scores.popularity_score(F.col("engagement")), "attention": scores.attention_score(F.col("latest_state"), F.col("last_listing"), F.col("age_minutes"), F.col("latest_rank")), "priority": scores.analysis_priority(F.col("latest_state"), F.col("age_minutes"))})


def ranked_in(df: DataFrame, group: str, name: str, *by: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*by)))


def falling(*names: str) -> list[Column]:
    """Orders by numbers from large to small; null counts as 0."""
    return [F.desc(zero(F.col(n).cast("double"))) for n in names]


def top_posts(status: DataFrame) -> DataFrame:
    """popularity_rank in each community."""
    return ranked_in(status, "community", "popularity_rank", *falling("popularity", "engagement", "max_upvotes", "max_comments", "upvote_growth"), F.col("first_snapshot"), F.col("post_id"))


def latest_status(status: DataFrame, states: tuple[str, ...] | None = None, priorities: tuple[str, ...] | None = None) -> DataFrame:
    """Posts of the given states and priorities, with their place in the community: by priority, then attention, motion, engagement, popularity."""
    kept = status
    if states is not None:
        kept = kept.where(F.col("latest_state").isin(*states))
    if priorities is not None:
        kept = kept.where(F.col("priority").isin(*priorities))
    return ranked_in(kept, "community", "status_rank", scores.priority_rank(F.col("priority")), *falling("attention", "last_comment_velocity", "last_upvote_velocity", "engagement", "popularity", "max_upvotes"), F.col("post_id"))


def alive_focus(status: DataFrame) -> DataFrame:
    return latest_status(status, ("surging", "alive", "emerging"), ("highest", "high"))


def top_risers(status: DataFrame, most: int) -> DataFrame:
    """The `most` posts of the alive focus with most attention, motion and growth (a top-k report)."""
    return alive_focus(status).orderBy(*falling("attention", "last_comment_velocity", "last_upvote_velocity", "engagement", "comment_growth", "upvote_growth"), "community", "post_id").limit(most)


def attention_summary(status: DataFrame) -> DataFrame:
    """Per community: posts by state, totals, means and maxima of attention and popularity, and the post with most attention."""
    n = lambda *states: F.count_if(F.col("latest_state").isin(*states))
    best = F.struct(zero("attention"), zero("popularity"), -F.col("post_id"))
    top = lambda c: F.max_by(c, best)
    return status.groupBy("community").agg(
        F.count(F.lit(1)).alias("n_posts"), n("surging", "alive", "emerging").alias("n_alive"), n("cooling", "dying").alias("n_cooling"), n("dying").alias("n_dying"), n("dead").alias("n_dead"), F.sum("attention").alias("total_attention"), F.avg("attention").alias("avg_attention"), F.max("attention").alias("max_attention"),
        F.sum("popularity").alias("total_popularity"), F.avg("popularity").alias("avg_popularity"), F.max("popularity").alias("max_popularity"), top("post_id").alias("top_post"), top("latest_state").alias("top_state"), top("last_listing").alias("top_listing"),
    )


def forecast(status: DataFrame) -> DataFrame:
    """Naive forecast of each post from its status: next hour, 3 and 6 hours, die-soon score, state, recommendation and priority."""
    state = F.col("latest_state")
    up, com = (F.greatest(zero(f"last_{m}_velocity"), F.lit(0.0)) for m in ("upvote", "comment"))
    m = lookup(STATE_MULTIPLIER, state, 0.5)
    f = status.withColumns({"next_upvotes": up * m, "next_comments": com * m, "die_soon": die_soon_score(state, up, com, zero("attention"), zero("popularity"), zero("observed_hours"))})
    u, c = F.col("next_upvotes"), F.col("next_comments")
    more = {f"{n}_{h}h": decayed_total(F.col(f"next_{n}"), state, h) for n in ("upvotes", "comments") for h in (3, 6)}
    return f.withColumns(more).withColumns({
        "state_decay": lookup(STATE_DECAY, state, 0.5), "die_soon_label": F.when(F.col("die_soon") >= 0.65, "likely_to_die_soon").otherwise("likely_to_continue"), "predicted_state": predicted_state(state, u, c, F.col("die_soon")), "recommendation": recommendation(state, u, c),
        "forecast_priority": scores.forecast_priority(u, c, zero("attention"), zero("popularity"), F.col("die_soon")),
    })


def watchlist(forecasts: DataFrame, per_community: int = 20) -> DataFrame:
    """Of each community the posts to watch, at most `per_community`, by forecast priority (a top-k report)."""
    watched = forecasts.where(F.col("recommendation").isin("surge_watch", "active_watch", "cooling_watch", "dying_watch"))
    ranked = ranked_in(watched, "community", "watch_rank", *falling("forecast_priority", "next_upvotes", "next_comments"), F.col("post_id"))
    return ranked.where(F.col("watch_rank") <= per_community)


def snapshot_catalog(posts: DataFrame) -> DataFrame:
    """Per (snapshot_no, community) of posts (upvotes, comments, link, domain, place): counts, means, medians, shares, the most frequent domain (ties: the first seen)."""
    key = ["snapshot_no", "community"]
    domain = F.nullif(F.col("domain"), F.lit(""))
    per = posts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_distinct(domain).alias("n_domains"), F.avg("upvotes").alias("avg_upvotes"), F.median("upvotes").alias("median_upvotes"), F.avg("comments").alias("avg_comments"), F.median("comments").alias("median_comments"),
        F.avg((F.coalesce(F.col("comments"), F.lit(0)) > 0).cast("double")).alias("share_with_comments"), F.avg((F.coalesce("link", F.lit("")) != "").cast("double")).alias("share_with_links"),
    )
    by_domain = posts.where(domain.isNotNull()).groupBy(*key, "domain").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at"))
    top = by_domain.groupBy(*key).agg(F.max_by("domain", F.struct("n", -F.col("at"))).alias("top_domain"), F.max("n").alias("_top"))
    return per.join(top, key, "left").withColumn("top_domain_share", F.col("_top") / F.col("n_posts")).drop("_top")


def latest_per_community(series: DataFrame, time: str, *keep: str) -> DataFrame:
    """The last row of each community; of equal times the first by the kept columns."""
    return series.groupBy("community").agg(F.max_by(F.struct(time, *keep), F.struct(time)).alias("x")).select("community", "x.*")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row: snapshots, post snapshots, posts and communities."""
    return rows.agg(F.count_distinct("community", "snapshot_no").alias("n_snapshots"), F.count(F.lit(1)).alias("n_post_snapshots"), F.count_distinct("community", "post_id").alias("n_posts"), F.count_distinct("community").alias("n_communities"))
