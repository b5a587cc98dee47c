"""Labels and profiles of topics over their days: growth targets, death, peaks, revival, spread, history, windows; posts' launches and accelerations.

A topic's own days are those on which it has posts; day_idx is the dense number of observed days. Every window is within one topic or post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .topics import day_index

#: The order of states from dead on
STATE_RANK = {"dead": 0, "dying": 1, "cooling": 2, "alive": 3, "surging": 4}


def of_topic() -> WindowSpec:
    return Window.partitionBy("topic")


def own_order() -> WindowSpec:
    """A topic's own days in order."""
    return of_topic().orderBy("day_idx")


def of_post() -> WindowSpec:
    return Window.partitionBy("community", "post_id")


def at_least_1(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def growth_targets(days: DataFrame, low: int = 1, high: int = 3, ahead: int = 3, targets: tuple[int, ...] = (3, 5, 8, 10), factors: tuple[float, ...] = (1.5, 2.0, 3.0, 5.0), fail_below: int = 3) -> DataFrame:
    """Per (day, topic) with `low` to `high` posts and `ahead` days to come: the most posts in those days, whether each target and each multiple of today's is met,
    whether it fails (stays below `fail_below`), and momentum (more posts than on the observed day before)."""
    d = day_index(days)
    last = d.agg(F.max("day_idx").alias("last_idx"))
    before = F.when(F.lag("day_idx").over(own_order()) == F.col("day_idx") - 1, F.lag("n_posts").over(own_order()))
    seen = d.withColumn("future_peak", F.coalesce(F.max("n_posts").over(own_order().rangeBetween(1, ahead)), F.lit(0))).withColumn("yesterday", F.coalesce(before, F.lit(0)))
    use = seen.crossJoin(F.broadcast(last)).where(F.col("n_posts").between(low, high) & (F.col("day_idx") + ahead <= F.col("last_idx")))
    met = [(F.col("future_peak") >= t).alias(f"reaches_{t}") for t in targets] + [(F.col("future_peak") >= F.col("n_posts") * f).alias(f"times_{f:g}".replace(".", "_")) for f in factors]
    return use.select("day_no", "topic", "n_posts", "future_peak", *met, (F.col("future_peak") < fail_below).alias("fails"), ((F.col("yesterday") > 0) & (F.col("n_posts") > F.col("yesterday"))).alias("momentum"))


def own_days(days: DataFrame, least_days: int, least_posts: int) -> DataFrame:
    """day_index's rows of topics with so many own days and posts, with place (from 0) and number of own days."""
    d = day_index(days).withColumn("n_days", F.count(F.lit(1)).over(of_topic())).withColumn("total_posts", F.sum("n_posts").over(of_topic()))
    return d.where((F.col("n_days") >= least_days) & (F.col("total_posts") >= least_posts)).withColumn("place", F.row_number().over(own_order()) - 1)


def dies_tomorrow(days: DataFrame, least_posts: int = 5, live: int = 2) -> DataFrame:
    """Each own day but a topic's last: dies where the next observed day is not its own or has under `live` posts; with trends against the own day before and its age."""
    d = own_days(days, 2, least_posts)
    nxt, at = F.lead("n_posts").over(own_order()), F.lead("day_idx").over(own_order())
    trend = lambda c: F.when(F.col("place") > 0, F.col(c) / at_least_1(F.lag(c).over(own_order()))).otherwise(F.lit(1.0))
    out = d.select("topic", "day_idx", "n_posts", F.col("place").cast("int").alias("age"), ((at != F.col("day_idx") + 1) | (nxt < live)).cast("int").alias("dies"), trend("n_posts").alias("post_trend"), trend("total_upvotes").alias("upvote_trend"))
    return out.where("dies IS NOT NULL")


def peak_profiles(days: DataFrame, least_days: int = 3, least_posts: int = 5) -> DataFrame:
    """Per topic: its peak among own days (the first), own days until then, growth of the second day on the first, and when the peak is first followed by under 2 posts (else the days left)."""
    d = own_days(days, least_days, least_posts)
    peak = F.max_by("place", F.struct("n_posts", -F.col("place"))).over(of_topic())
    d = d.withColumn("peak_place", peak)
    nth = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    quiet = F.min(F.when((F.col("place") > F.col("peak_place")) & (F.col("n_posts") < 2), F.col("place") - F.col("peak_place")))
    per = d.groupBy("topic").agg(F.max("n_days").alias("n_days"), F.max("total_posts").alias("total_posts"), F.max("n_posts").alias("peak_posts"), F.max("peak_place").alias("days_to_peak"), F.max(F.when(F.col("place") == F.col("peak_place"), F.col("day_idx"))).alias("peak_idx"), nth("n_posts", 0).alias("first_posts"), nth("total_upvotes", 0).alias("first_upvotes"), nth("n_posts", 1).alias("_p"), nth("total_upvotes", 1).alias("_u"), quiet.alias("_q"))
    return per.select(
        "topic", "n_days", "total_posts", "peak_posts", F.col("peak_idx").cast("int").alias("peak_idx"), F.col("days_to_peak").cast("int").alias("days_to_peak"), (F.col("days_to_peak") == 0).alias("peaks_first"), (F.col("days_to_peak") <= 1).alias("peaks_by_second"), "first_posts", "first_upvotes",
        (F.col("_p") / at_least_1(F.col("first_posts"))).alias("post_growth"), (F.col("_u") / at_least_1(F.col("first_upvotes"))).alias("upvote_growth"), F.coalesce("_q", F.col("n_days") - F.col("days_to_peak")).cast("int").alias("days_to_quiet"),
    )


def reviver_profiles(grid: DataFrame, observed: int = 5, live: int = 2, ahead: int = 3, least: int = 3) -> DataFrame:
    """Per topic of a dense grid: drops below `live` posts and revivals within `ahead` days, and of the first `observed` days the peak, live days, posts, consistency, volatility (population deviation)
    and number of peaks; topics with under `least` posts in those days are left out."""
    n = F.count(F.lit(1)).over(of_topic())
    before, after = F.lag("n_posts").over(own_order()), F.lead("n_posts").over(own_order())
    drop = (F.col("day_idx") > 0) & after.isNotNull() & (F.col("n_posts") < live) & (before >= live)
    g = grid.withColumn("drop", F.coalesce(drop, F.lit(False))).withColumn("again", F.coalesce(F.max("n_posts").over(own_order().rowsBetween(1, ahead)) >= live, F.lit(False))).withColumn("seen", F.col("day_idx") < observed).withColumn("n", n)
    inside = F.col("seen") & (F.col("day_idx") > 0) & (F.col("day_idx") < F.least(F.lit(observed), F.col("n")) - 1)
    g = g.withColumn("top", F.coalesce(inside & (F.col("n_posts") > before) & (F.col("n_posts") > after), F.lit(False)))
    seen = lambda c: F.when(F.col("seen"), c)
    per = g.groupBy("topic").agg(F.count_if("drop").alias("drops"), F.count_if(F.col("drop") & F.col("again")).alias("revivals"), F.max(seen(F.col("n_posts"))).alias("peak"), F.count_if(F.col("seen") & (F.col("n_posts") >= live)).alias("active_days"), F.sum(seen(F.col("n_posts"))).alias("posts"), F.stddev_pop(seen(F.col("n_posts"))).alias("_v"), F.count_if("top").alias("_t"), F.count_if("seen").alias("_n")).where(F.col("posts") >= least)
    two = F.col("active_days") >= 2
    return per.select("topic", "drops", "revivals", (F.col("revivals") > 0).alias("is_reviver"), "peak", "active_days", "posts", F.when(two, F.col("active_days") / F.col("_n")).otherwise(0.0).alias("consistency"), F.when(two, F.col("_v")).otherwise(0.0).alias("volatility"), F.when(two, F.col("_t")).otherwise(0).alias("peaks"))


def community_days(posts: DataFrame, keys: str) -> DataFrame:
    """Per (day, topic, community): posts, upvotes, best upvotes."""
    long = posts.select("day_no", "community", "upvotes", F.explode(keys).alias("topic"))
    return long.groupBy("day_no", "topic", "community").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("upvotes").alias("total_upvotes"), F.max("upvotes").alias("best_upvotes"))


def spread_labels(by_community: DataFrame, target: str, most: int = 3) -> DataFrame:
    """Per (day, topic) in at most `most` communities: those that are new on the next observed day, whether there is any, and whether the target is reached."""
    order = by_community.select("day_no").distinct()
    order = order.withColumn("day_idx", (F.row_number().over(Window.orderBy("day_no")) - 1).cast("int"))  # one row per day
    sets = by_community.join(F.broadcast(order), "day_no").groupBy("topic", "day_no", "day_idx").agg(F.sum("n_posts").alias("n_posts"), F.sort_array(F.collect_set("community")).alias("today"))
    last = order.agg(F.max("day_idx").alias("last_idx"))
    ahead = F.when(F.lead("day_idx").over(own_order()) == F.col("day_idx") + 1, F.lead("today").over(own_order()))
    new = F.array_except(F.coalesce(ahead, F.array().cast("array<string>")), F.col("today"))
    out = sets.withColumn("new", new).crossJoin(F.broadcast(last)).where((F.size("today") <= most) & (F.col("day_idx") < F.col("last_idx")))
    return out.select("day_no", "topic", "n_posts", F.size("today").alias("n_communities"), F.concat_ws(",", F.sort_array("new")).alias("new_communities"), (F.size("new") > 0).alias("spreads"), F.array_contains("new", target).alias("reaches_target"), F.array_contains("today", target).alias("is_in_target"))


def cumulative_history(posts: DataFrame, keys: str, least_days: int = 2, low: int = 3, high: int = 15, ahead: int = 3) -> DataFrame:
    """Per (day, topic) seen on `least_days` own days or more with `low` to `high` posts so far and `ahead` days to come: expanding sums, rates, distinct communities, recent growth and the most posts to come."""
    long = posts.select("day_no", "community", "upvotes", "state", F.explode(keys).alias("topic"))
    d = long.groupBy("day_no", "topic").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("upvotes").alias("up"), F.count_if(F.col("state").isin("surging", "alive")).alias("n_alive"), F.count_if(F.col("state") == "surging").alias("n_surging"))
    # a community counts from its first day on: its rows of later days need not be looked at again
    first = long.groupBy("topic", "community").agg(F.min("day_no").alias("day_no")).groupBy("day_no", "topic").agg(F.count(F.lit(1)).alias("n_first"))
    d = day_index(d.join(first, ["day_no", "topic"], "left").withColumn("n_first", F.coalesce("n_first", F.lit(0))))
    last = d.agg(F.max("day_idx").alias("last_idx"))
    so_far = own_order().rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"cum_{c}": F.sum(c).over(so_far) for c in ("n_posts", "up", "n_alive", "n_surging")}
    before = F.lag("n_posts").over(own_order())
    w = d.withColumns({**sums, "days_seen": F.row_number().over(own_order()), "cum_communities": F.sum("n_first").over(so_far).cast("int"), "recent_growth": (F.col("n_posts") - before) / at_least_1(before), "future_peak": F.coalesce(F.max("n_posts").over(own_order().rangeBetween(1, ahead)), F.lit(0))})
    use = w.crossJoin(F.broadcast(last)).where((F.col("days_seen") >= least_days) & F.col("cum_n_posts").between(low, high) & (F.col("day_idx") + ahead <= F.col("last_idx")))
    return use.select("day_no", "topic", "days_seen", F.col("cum_n_posts").alias("posts"), F.col("cum_up").alias("upvotes"), F.col("cum_communities").alias("n_communities"), (F.col("cum_n_alive") / F.col("cum_n_posts")).alias("alive_rate"), (F.col("cum_n_surging") / F.col("cum_n_posts")).alias("surging_rate"), "recent_growth", "future_peak")


def day_windows(days: DataFrame, value: str = "total_upvotes") -> DataFrame:
    """Over a topic's own rows: the value 1 to 3 rows before, growth on the last, mean and maximum of the three, trend over them, and the value 1 to 3 rows on with its relative change; rows with three before."""
    d = day_index(days)
    lag, lead = (lambda k: F.lag(value, k).over(own_order())), (lambda k: F.lead(value, k).over(own_order()))
    three = own_order().rowsBetween(-3, -1)
    w = d.select("topic", "day_no", F.col(value).alias("value"), *[lag(k).alias(f"lag_{k}") for k in (1, 2, 3)], (F.col(value) / at_least_1(lag(1))).alias("growth"), F.avg(value).over(three).alias("mean_3"), F.max(value).over(three).alias("max_3"), ((lag(1) - lag(3)) / 2).alias("trend_3"), *[lead(k).alias(f"next_{k}") for k in (1, 2, 3)], ((lead(1) - F.col(value)) / at_least_1(F.col(value))).alias("next_change"))
    return w.where("lag_3 IS NOT NULL")


def emerging_keywords(grid: DataFrame, start: int = 5, target: int = 10) -> DataFrame:
    """Topics that first appear with at most `start` posts and reach `target` later: growth, days to the peak and the timeline."""
    first = F.min(F.when(F.col("n_posts") >= 1, F.col("day_idx"))).over(of_topic())
    g = grid.withColumn("first_idx", first)
    later = F.when(F.col("day_idx") >= F.col("first_idx"), F.struct("n_posts", -F.col("day_idx")))
    per = g.groupBy("topic").agg(F.max("first_idx").alias("first_idx"), F.max(F.when(F.col("day_idx") == F.col("first_idx"), F.col("n_posts"))).alias("first_posts"), F.max("n_posts").alias("peak_posts"), F.max_by("day_idx", later).alias("peak_idx"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("day_idx", "n_posts"))), lambda x: x["n_posts"].cast("string"))).alias("timeline"))
    return per.where((F.col("first_posts") <= start) & (F.col("peak_posts") >= target)).select("topic", "first_idx", "first_posts", "peak_idx", "peak_posts", (F.col("peak_posts") / at_least_1(F.col("first_posts"))).alias("growth"), (F.col("peak_idx") - F.col("first_idx")).alias("days_to_peak"), "timeline")


def state_rank(state: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in STATE_RANK.items() for x in p])[state], F.lit(0))


def accelerating_posts(rows: DataFrame, most_upvotes: float = 500.0) -> DataFrame:
    """Posts with two snapshots or more and at most `most_upvotes`: the last against the one before in velocity, upvotes per hour and state."""
    back = rows.withColumn("_r", F.row_number().over(of_post().orderBy(F.desc("hours"), F.desc("snapshot_no"))))
    pair = back.where("_r <= 2").withColumn("_v", F.coalesce("upvote_velocity", F.lit(0.0))).groupBy("community", "post_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("_r") == k, F.col(c))).alias(f"{c}{k}") for c in ("upvotes", "_v", "hours", "state") for k in (1, 2)])
    improved = state_rank(F.col("state1")) > state_rank(F.col("state2"))
    use = pair.where((F.col("n") >= 2) & (F.col("upvotes1") <= most_upvotes))
    return use.select("community", "post_id", F.col("upvotes1").alias("upvotes"), F.col("state1").alias("state"), (F.col("_v1") - F.col("_v2")).alias("velocity_increase"), ((F.col("upvotes1") - F.col("upvotes2")) / F.greatest(F.lit(1.0), F.col("hours1") - F.col("hours2"))).alias("upvotes_per_hour"), improved.alias("state_improved"), ((F.col("_v1") > F.col("_v2")) | improved).alias("accelerates"))


def launch_speed(rows: DataFrame) -> DataFrame:
    """Posts with two snapshots or more: speed at the first, and how it changes to the second."""
    first = rows.withColumn("_r", F.row_number().over(of_post().orderBy("hours", "snapshot_no"))).where("_r <= 2").withColumn("_v", F.coalesce("upvote_velocity", F.lit(0.0)))
    two = first.groupBy("community", "post_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("_r") == k, F.col(c))).alias(f"{c}{k}") for c in ("upvotes", "comments", "age_minutes", "_v") for k in (1, 2)]).where("n >= 2")
    age, dt = F.greatest(F.lit(0.1), F.col("age_minutes1") / 60), F.greatest(F.lit(0.1), (F.col("age_minutes2") - F.col("age_minutes1")) / 60)
    return two.select("community", "post_id", (F.col("upvotes1") / age).alias("upvote_speed"), (F.col("comments1") / age).alias("comment_speed"), ((F.col("upvotes2") - F.col("upvotes1")) / dt - F.col("upvotes1") / age).alias("upvote_acceleration"), ((F.col("comments2") - F.col("comments1")) / dt - F.col("comments1") / age).alias("comment_acceleration"), (F.col("_v2") - F.col("_v1")).alias("velocity_acceleration"))


def rank_changes(rows: DataFrame) -> DataFrame:
    """Each snapshot of a post with the change of its rank since the one before (up is positive), direction flags, and whether its state rises."""
    o = of_post().orderBy("hours", "snapshot_no")
    change = F.lag("rank").over(o) - F.col("rank")
    rises = state_rank(F.col("state")) > state_rank(F.lag("state").over(o))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.select("community", "post_id", "snapshot_no", change.alias("rank_change"), flag(change > 0).alias("moved_up"), flag(change < 0).alias("moved_down"), F.when(F.lag("state").over(o).isNotNull(), rises.cast("int")).alias("state_rises"))


def listing_paths(rows: DataFrame) -> DataFrame:
    """Per post: the listings it went through without repeats in a row, the last three of them, and hours in the last run (between its rows)."""
    o = of_post().orderBy("hours", "snapshot_no")
    turn = F.coalesce(F.lag("listing").over(o) != F.col("listing"), F.lit(True))
    marked = rows.withColumn("turn", turn).withColumn("_run", F.sum(F.col("turn").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("community", "post_id", "_run").agg(F.first("listing").alias("listing"), F.count(F.lit(1)).alias("n"), (F.max("hours") - F.min("hours")).alias("span"))
    per = runs.groupBy("community", "post_id").agg(F.sort_array(F.collect_list(F.struct("_run", "listing", "n", "span"))).alias("r"))
    names = F.transform("r", lambda x: x["listing"])
    return per.select("community", "post_id", F.size("r").cast("long").alias("n_runs"), F.concat_ws(">", names).alias("path"), F.concat_ws(">", F.slice(names, F.greatest(F.size(names) - 2, F.lit(1)), 3)).alias("last_three"), F.element_at("r", -1)["n"].alias("run_length"), F.element_at("r", -1)["span"].alias("hours_in_run"))
