"""Posts looked at with their discussions: moods, sentiment summaries, single-run features, case studies, keyword days with quality."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import safe_ratio
from .groups import gini, thread_depth
from .labels import listing_paths

#: states' moods, and bands of sentiment (over, text) in their order
MOODS = {"surging": "positive", "alive": "positive", "emerging": "neutral", "cooling": "negative", "dying": "negative", "dead": "negative", "unknown": "neutral"}
ABOVE = ((0.15, "STRONGLY POSITIVE - likely to keep surging"), (0.05, "MILDLY POSITIVE - should stay alive"))
BELOW = ((-0.15, "STRONGLY NEGATIVE - may die fast or go viral (controversial)"), (-0.05, "MILDLY NEGATIVE - could cool down"))


def mood_of(state: Column) -> Column:
    """positive, neutral or negative; states that aren't known are neutral."""
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*MOODS.items())])[state], F.lit("neutral"))


def mood_outlook(score: Column) -> Column:
    """What a weighted sentiment lets expect; an unknown one is neutral."""
    out = F.when(score > ABOVE[0][0], ABOVE[0][1]).when(score > ABOVE[1][0], ABOVE[1][1])
    for bound, text in BELOW:
        out = out.when(score < bound, text)
    return out.otherwise("NEUTRAL - standard trajectory")


def controversy(variance: Column) -> Column:
    return F.when(variance > 0.3, "HIGH CONTROVERSY").when(variance > 0.15, "moderate debate").otherwise("")


def post_sentiment(comments: DataFrame) -> DataFrame:
    """Per post with scored comments (compound): count, mean, mean weighted by upvotes (1 at least), shares over 0.05 and under -0.05, sample variance (0 for one), mean length of bodies."""
    c, w = F.col("compound"), F.greatest(F.lit(1.0), F.coalesce(F.col("upvotes").cast("double"), F.lit(1.0)))
    return comments.where(c.isNotNull()).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("comment_count"), F.avg(c).alias("sentiment_mean"), (F.sum(c * w) / F.sum(w)).alias("sentiment_weighted"), F.avg((c > 0.05).cast("double")).alias("positive_share"), F.avg((c < -0.05).cast("double")).alias("negative_share"),
        F.coalesce(F.var_samp(c), F.lit(0.0)).alias("sentiment_variance"), F.avg(F.length("body").cast("double")).alias("avg_body_len"),
    )


def mood_table(sentiments: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Posts with a state and scored comments: both sides' columns and the state's mood."""
    return lifecycles.where(F.coalesce("state", F.lit("")) != "").join(sentiments, "post_id").withColumn("mood", mood_of(F.col("state")))


_SIX = ("sentiment_mean", "sentiment_weighted", "positive_share", "negative_share", "sentiment_variance")


def mood_by_state(table: DataFrame) -> DataFrame:
    """Means of the sentiment measures by state, and those of living (surging, alive) less those of dying and dead posts (state `alive - dead`)."""
    side = F.when(F.col("state").isin("surging", "alive"), "alive").when(F.col("state").isin("dying", "dead"), "dead")
    by_state = table.groupBy("state").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in _SIX])
    of = lambda c, s: F.avg(F.when(side == s, F.col(c)))
    diff = table.agg(F.count(side).alias("n"), *[(of(c, "alive") - of(c, "dead")).alias(c) for c in _SIX]).where("sentiment_mean IS NOT NULL")
    return by_state.unionByName(diff.select(F.lit("alive - dead").alias("state"), "n", *_SIX))


def mood_shortlist(table: DataFrame, k: int = 20) -> DataFrame:
    """The `k` fastest active posts (a top-k report; ties by id) with what their comments' mood lets expect."""
    active = table.where(F.col("state").isin("surging", "alive", "emerging"))
    top = active.orderBy(F.desc(F.coalesce("upvote_velocity", F.lit(0.0))), "post_id").limit(k)
    return top.select("post_id", "community", "state", "upvote_velocity", "sentiment_weighted", mood_outlook(F.col("sentiment_weighted")).alias("outlook"), controversy(F.col("sentiment_variance")).alias("controversy"))


def sentiment_by_community(comments: DataFrame, titles: DataFrame) -> DataFrame:
    """Per community: number, mean (4 places) and percentage of negative compounds (1 place), of comments and of titles; a side without any has no mean and 0 percent. Both inputs: community, compound."""

    def side(df: DataFrame, name: str) -> DataFrame:
        c = F.col("compound")
        return df.where(c.isNotNull()).groupBy("community").agg(F.count(F.lit(1)).alias(f"{name}_count"), F.avg(c).alias(f"{name}_avg_sentiment"), (F.avg((c <= -0.05).cast("double")) * 100).alias(f"{name}_negative_pct"))

    j = side(comments, "comment").join(side(titles, "title"), "community", "full")
    zero = {f"{n}_{c}": F.coalesce(F.col(f"{n}_{c}"), F.lit(0)) for n in ("comment", "title") for c in ("count", "negative_pct")}
    return j.withColumns(zero).select("community", *[f"{n}_{c}" for n in ("comment", "title") for c in ("count", "avg_sentiment", "negative_pct")])


def single_run_features(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Features of posts scraped once, with their comments: coverage, reply split, commenters, comment scores, depth, delays.

    posts: post_id, author, created, scraped (seconds), number_of_comments; comments: post_id, comment_id, parent_id (null: the post), author, upvotes, created. The depth of the tree is
    found first; all measures of a post are then one aggregate beside it. Delays under 0 don't count."""
    deep = comments.join(thread_depth(comments), ["post_id", "comment_id"], "left").join(posts.select("post_id", F.col("author").alias("_by"), F.col("created").alias("_at")), "post_id")
    delay = F.col("created") - F.col("_at")
    known, top, author = F.when(delay >= 0, delay), F.col("parent_id").isNull(), F.nullif(F.col("author"), F.lit(""))
    per = deep.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("scraped_comment_count"), F.count_if(top).alias("top_level_comment_count"), F.count_if(~top).alias("reply_comment_count"), F.count_if(F.col("author") == F.col("_by")).alias("author_reply_count"), F.count_distinct(author).alias("unique_commenter_count"),
        F.avg("upvotes").alias("avg_comment_upvotes"), F.percentile("upvotes", 0.5).alias("median_comment_upvotes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_comment_depth"), F.min(known).alias("first_comment_delay"), F.count_if(known <= 3600).alias("first_hour_comment_count"), F.count_if(known <= 86400).alias("first_day_comment_count"),
    )
    none = ("scraped_comment_count", "top_level_comment_count", "reply_comment_count", "author_reply_count", "unique_commenter_count", "max_comment_depth", "first_hour_comment_count", "first_day_comment_count")
    out = posts.join(per, "post_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in none})
    return out.withColumn("hours_until_scrape", (F.col("scraped") - F.col("created")) / 3600).withColumn("scraped_comment_coverage", safe_ratio(F.col("scraped_comment_count"), F.col("number_of_comments"))).drop("created", "scraped")


def case_studies(cases: DataFrame, timeline: DataFrame, comments: DataFrame, key: list[str], points: int = 3, best: int = 2) -> DataFrame:
    """The cases with their history and their best comments: listing path, first and last row, the last `points` rows, comments of the post's latest comment snapshot and the ids of its `best` ones.

    Only the cases' rows are read on (semi joins). A post's latest comment snapshot comes from an aggregate, so no window sorts
    all comments; comments go by upvotes, replies and id. timeline: snapshot_no, hours, upvotes, comments, state, listing; comments: snapshot_no, comment_id, upvotes, replies."""
    few = cases.select(*key).distinct()
    rows = timeline.join(few, key, "left_semi")
    at = lambda f, c: f(c, "snapshot_no")
    point = F.struct("snapshot_no", F.concat(F.lit("u="), F.coalesce(F.col("upvotes"), F.lit(0)).cast("long"), F.lit(" c="), F.coalesce(F.col("comments"), F.lit(0)).cast("long"), F.lit(" state="), F.col("state")).alias("t"))
    per = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_snapshots"), *[at(f, c).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("upvotes", "comments")], F.sort_array(F.collect_list(point)).alias("_p"))
    recent = F.transform(F.slice("_p", F.greatest(F.size("_p") - points + 1, F.lit(1)), points), lambda x: x["t"])
    per = per.withColumn("recent", F.concat_ws(" | ", recent)).drop("_p")
    paths = listing_paths(rows).select(*key, F.regexp_replace("path", ">", " -> ").alias("listing_path"))
    mine = comments.join(few, key, "left_semi")
    newest = mine.groupBy(*key).agg(F.max("snapshot_no").alias("snapshot_no"))
    order = F.struct(-F.coalesce(F.col("upvotes"), F.lit(0)).cast("double"), -F.coalesce(F.col("replies"), F.lit(0)).cast("double"), F.col("comment_id"))
    top = mine.join(newest, [*key, "snapshot_no"]).groupBy(*key).agg(F.count(F.lit(1)).alias("n_latest_comments"), F.slice(F.sort_array(F.collect_list(order.alias("o"))), 1, best).alias("o"))
    top = top.select(*key, "n_latest_comments", F.transform("o", lambda x: x["comment_id"]).alias("_ids"))
    top = top.select(*key, "n_latest_comments", *[F.get("_ids", i).alias(f"top_comment_{i + 1}") for i in range(best)])
    out = cases.join(per, key, "left").join(paths, key, "left").join(top, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_snapshots", "n_latest_comments")})


def comment_quality(comments: DataFrame) -> DataFrame:
    """Per post with comments (upvotes, compound): gini of upvotes, sentiment weighted by them (1 at least), share under -0.05."""
    w = F.greatest(F.lit(1.0), F.coalesce(F.col("upvotes").cast("double"), F.lit(0.0)))
    c = F.coalesce("compound", F.lit(0.0))
    per = comments.groupBy("post_id").agg((F.sum(c * w) / F.greatest(F.lit(1.0), F.sum(w))).alias("sentiment"), F.avg((c < -0.05).cast("double")).alias("neg_share"))
    return per.join(gini(comments, "post_id", "upvotes").select("post_id", "gini"), "post_id")


def keyword_quality_days(posts: DataFrame, keys: str, quality: DataFrame, least: int = 3, least_days: int = 5) -> DataFrame:
    """Per (day, keyword) with `least` posts or more, of keywords with `least_days` such days or more: posts, upvotes, rates of surging, of surging or alive, and of dead or dying, means of gini, sentiment, velocity (of posts that have one) and negative share (0 without).

    Quality is joined to the posts before their words are exploded: a row a post, not one a word."""
    q = posts.join(quality.select("post_id", "gini", "sentiment", "neg_share"), "post_id", "left")
    long = q.select("day_no", "upvotes", "state", "velocity", "gini", "sentiment", "neg_share", F.explode(keys).alias("topic"))
    rate = lambda *s: F.avg(F.col("state").isin(*s).cast("double"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    per = long.groupBy("day_no", "topic").agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum(F.coalesce("upvotes", F.lit(0))).alias("total_upvotes"), rate("surging").alias("surge_rate"), rate("surging", "alive").alias("alive_rate"), rate("dead", "dying").alias("dead_rate"),
        mean("gini").alias("avg_gini"), mean("sentiment").alias("avg_sentiment"), mean(F.nullif(F.col("velocity"), F.lit(0))).alias("avg_velocity"), mean("neg_share").alias("avg_neg_share"),
    )
    per = per.where(F.col("n_posts") >= least).withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy("topic")))  # a row a day at most
    return per.where(F.col("_days") >= least_days).drop("_days")


def comment_feature_rows(table: DataFrame, least: int = 3) -> DataFrame:
    """Rows for a mood classifier: posts with `least` comments or more whose mood isn't neutral, y = 1 where it is positive."""
    return table.where((F.col("comment_count") >= least) & (F.col("mood") != "neutral")).withColumn("y", (F.col("mood") == "positive").cast("int"))
