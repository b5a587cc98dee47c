"""Topics, keywords and word pairs, followed over days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import topic_day_state
from ..functions.text import tokens
from .groups import alive


def topic_days(posts: DataFrame, keys: str) -> DataFrame:
    """Per (day, key): posts, total and best upvotes, communities, alive, surging and dead rates. `keys` is an array column of distinct words or pairs."""
    long = posts.select("day_no", "post_id", "community", "upvotes", "state", F.explode(keys).alias("topic"))
    return _by_day(long)


def _by_day(long: DataFrame, *topic: str) -> DataFrame:
    return long.groupBy("day_no", *(topic or ("topic",))).agg(F.count(F.lit(1)).alias("n_posts"), F.sum("upvotes").alias("total_upvotes"), F.max("upvotes").alias("best_upvotes"), F.count_distinct("community").alias("n_communities"), F.avg(alive().cast("double")).alias("alive_rate"), F.avg((F.col("state") == "surging").cast("double")).alias("surging_rate"), F.avg((F.col("state") == "dead").cast("double")).alias("dead_rate"))


#: Pairs that a task gets on average, so that its groups fit its memory
PAIRS_A_TASK = 300_000


def pair_rows(rows: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """The columns to keep (day_no among them) with _a and _b: unordered pairs (a < b) of an array of distinct words, dealt by day and _a.

    A word goes to its task once, with the words behind it, and the pairs are made there; groups by day_no, _a, _b and more need no other shuffle. No row holds all pairs of a long text."""
    s = rows.select(*keep, F.array_sort(words).alias("_w"))
    n = F.size("_w").cast("long")
    pairs = s.agg(F.sum(F.when(n > 1, n * (n - 1) / 2))).first()[0] or 0
    s = s.select("*", F.posexplode("_w").alias("_i", "_a")).where(F.col("_i") < F.size("_w") - 1)
    # a text needs fewer bytes than an array; no word holds the control character
    s = s.select(*keep, "_a", F.concat_ws("\x01", F.slice("_w", F.col("_i") + 2, F.size("_w") - F.col("_i") - 1)).alias("_rest"))
    return s.repartition(max(8, int(pairs / PAIRS_A_TASK) + 1), "day_no", "_a").select(*keep, "_a", F.explode(F.split("_rest", "\x01")).alias("_b"))


def pair_days(posts: DataFrame, title: str, body: str) -> DataFrame:
    """topic_days of pairs a+b of words that share a sentence of the body or the title; a post counts once for each pair."""
    lines = posts.withColumn("_title", tokens(F.col(title))).select("day_no", "post_id", "community", "upvotes", "state", "_title", F.posexplode(F.concat(F.array(title), F.split(body, "[.!?\n]+"))).alias("_no", "_line"))
    # a sentence whose words are all in the title, as those of a text's first line are, has no pair that the title hasn't
    lines = lines.withColumn("_words", tokens(F.col("_line"))).where((F.size("_words") > 1) & ((F.col("_no") == 0) | (F.size(F.array_except("_words", "_title")) > 0)))
    once = pair_rows(lines, "_words", ["day_no", "post_id", "community", "upvotes", "state"]).distinct()
    return _by_day(once, "_a", "_b").withColumn("topic", F.concat("_a", F.lit("+"), "_b")).drop("_a", "_b")


def keyword_trend(days: DataFrame, least: int = 5) -> DataFrame:
    """Posts a day in the first and second half of the observed days and their relative change; new keywords change by 10."""
    order = days.select("day_no").distinct().withColumn("day_idx", F.row_number().over(Window.orderBy("day_no")) - 1)  # one row per day
    n = order.agg(F.count(F.lit(1)).alias("n_days"))
    d = days.join(F.broadcast(order), "day_no").crossJoin(F.broadcast(n)).withColumn("half", F.floor(F.col("n_days") / 2))
    first = F.sum(F.when(F.col("day_idx") < F.col("half"), F.col("n_posts")).otherwise(0)) / F.max("half")
    second = F.sum(F.when(F.col("day_idx") >= F.col("half"), F.col("n_posts")).otherwise(0)) / (F.max("n_days") - F.max("half"))
    per = d.groupBy("topic").agg(F.sum("n_posts").alias("n_posts"), first.alias("first_rate"), second.alias("second_rate")).where(F.col("n_posts") >= least)
    change = F.when(F.col("first_rate") == 0, F.lit(10.0)).otherwise((F.col("second_rate") - F.col("first_rate")) / F.col("first_rate"))
    return per.withColumn("change", change).withColumn("trend", F.when(F.col("change") > 0.3, "rising").when(F.col("change") < -0.3, "falling").otherwise("stable"))


def keyword_lift(posts: DataFrame, keys: str, least: int = 25) -> DataFrame:
    """Per keyword with at least `least` posts: mean upvotes, difference and ratio to the mean of all posts, alive rate."""
    every = posts.agg(F.avg("upvotes").alias("all_mean"))
    long = posts.select("upvotes", alive().cast("double").alias("is_alive"), F.explode(keys).alias("topic"))
    per = long.groupBy("topic").agg(F.count(F.lit(1)).alias("n_posts"), F.avg("upvotes").alias("mean_upvotes"), F.avg("is_alive").alias("alive_rate")).where(F.col("n_posts") >= least)
    return per.crossJoin(F.broadcast(every)).select("topic", "n_posts", "mean_upvotes", "alive_rate", (F.col("mean_upvotes") - F.col("all_mean")).alias("lift"), (F.col("mean_upvotes") / F.col("all_mean")).alias("ratio"))


def day_index(days: DataFrame) -> DataFrame:
    """days with day_idx, the dense number of observed days."""
    order = days.select("day_no").distinct().withColumn("day_idx", (F.row_number().over(Window.orderBy("day_no")) - 1).cast("int"))  # one row per day
    return days.join(F.broadcast(order), "day_no")


def future_peak(days: DataFrame, low: int = 1, high: int = 3, target: int = 5, ahead: int = 3) -> DataFrame:
    """Per (day, topic) with `low` to `high` posts and `ahead` observed days to come: the most posts in those days (absent: 0) and whether the target is met."""
    d = day_index(days)
    last = d.agg(F.max("day_idx").alias("last_idx"))
    w = Window.partitionBy("topic").orderBy("day_idx").rangeBetween(1, ahead)
    peak = F.coalesce(F.max("n_posts").over(w), F.lit(0))
    return d.withColumn("future_peak", peak).crossJoin(F.broadcast(last)).where(F.col("n_posts").between(low, high) & (F.col("day_idx") + ahead <= F.col("last_idx"))).select("day_no", "topic", "n_posts", "n_communities", "alive_rate", "future_peak", (F.col("future_peak") >= target).alias("grows"))


def topic_states(days: DataFrame) -> DataFrame:
    """State of each (day, topic) from its posts and those of the observed day before (0 if absent), with the next day's state where it is consecutive."""
    d = day_index(days)
    w = Window.partitionBy("topic").orderBy("day_idx")
    near = lambda f, c, k: F.when(f("day_idx").over(w) == F.col("day_idx") + k, f(c).over(w))
    s = d.withColumn("yesterday", F.coalesce(near(F.lag, "n_posts", -1), F.lit(0))).withColumn("state", topic_day_state(F.col("n_posts"), F.col("yesterday")))
    return s.withColumn("next_state", near(F.lead, "state", 1)).select("day_no", "day_idx", "topic", "n_posts", "yesterday", "state", "next_state")


def state_transitions(states: DataFrame) -> DataFrame:
    """Counts and probabilities of state pairs on consecutive days."""
    n = states.where("next_state IS NOT NULL").groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def dense_grid(days: DataFrame, least: int = 5) -> DataFrame:
    """(topic, day_idx, n_posts) for every observed day of topics with at least `least` posts in all; absent days are 0. Topics are filtered before the grid is built."""
    d = day_index(days)
    keep = d.groupBy("topic").agg(F.sum("n_posts").alias("total")).where(F.col("total") >= least).select("topic")
    last = d.agg(F.max("day_idx").alias("m"))
    grid = keep.crossJoin(F.broadcast(last)).select("topic", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("day_idx"))
    return grid.join(d.select("topic", "day_idx", "n_posts"), ["topic", "day_idx"], "left").select("topic", "day_idx", F.coalesce("n_posts", F.lit(0)).cast("long").alias("n_posts"))


def confirmed_death(grid: DataFrame, live: int = 2) -> DataFrame:
    """Per topic: peak day (the first), the first day from the peak on that begins two days below `live` posts, days between; quick if at most 1."""
    w = Window.partitionBy("topic").orderBy("day_idx")
    g = grid.withColumn("next_posts", F.lead("n_posts").over(w)).withColumn("peak_idx", F.max_by("day_idx", F.struct("n_posts", -F.col("day_idx"))).over(Window.partitionBy("topic")))
    dies = (F.col("day_idx") >= F.col("peak_idx")) & (F.col("n_posts") < live) & (F.col("next_posts") < live)
    per = g.groupBy("topic").agg(F.max("n_posts").alias("peak_posts"), F.max("peak_idx").alias("peak_idx"), F.min(F.when(dies, F.col("day_idx"))).alias("death_idx"))
    return per.withColumn("days_to_death", F.col("death_idx") - F.col("peak_idx")).withColumn("quick", F.col("days_to_death") <= 1)


def false_deaths(grid: DataFrame, live: int = 2, ahead: int = 3, lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each run length: days that end a run of exactly so many quiet days after a live one, how many live again within `ahead` days, and the share."""
    w = Window.partitionBy("topic").orderBy("day_idx")
    flags = []
    for k in lengths:
        dead = F.lag("n_posts", k).over(w) >= live
        for i in range(k):
            dead = dead & ((F.lag("n_posts", i).over(w) if i else F.col("n_posts")) < live)
        flags.append(dead.alias(f"d{k}"))
    f = grid.select("topic", "day_idx", *flags, (F.max("n_posts").over(w.rowsBetween(1, ahead)) >= live).alias("again"))
    long = f.select("again", F.explode(F.array(*[F.struct(F.lit(k).alias("run_length"), F.col(f"d{k}").alias("dead")) for k in lengths])).alias("x")).where("x.dead")
    return long.groupBy(F.col("x.run_length").alias("run_length")).agg(F.count(F.lit(1)).alias("deaths"), F.count_if("again").alias("revivals"), F.avg(F.coalesce("again", F.lit(False)).cast("double")).alias("false_rate"))


def drops_and_revivals(grid: DataFrame, live: int = 2, ahead: int = 3) -> DataFrame:
    """Days on which a topic falls below `live` posts: its greatest posts and drops so far, and whether it revives."""
    w = Window.partitionBy("topic").orderBy("day_idx")
    g = grid.withColumn("dropped", (F.lag("n_posts").over(w) >= live) & (F.col("n_posts") < live))
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("max_before", F.max("n_posts").over(prior)).withColumn("drops_before", F.coalesce(F.sum(F.col("dropped").cast("long")).over(prior), F.lit(0))).withColumn("revives", F.coalesce(F.max("n_posts").over(w.rowsBetween(1, ahead)) >= live, F.lit(False)))
    return g.where("dropped").select("topic", "day_idx", "max_before", "drops_before", "revives")


def spread_routes(posts: DataFrame, keys: str, least: int = 2) -> DataFrame:
    """Routes first community -> later community of topics with at least `least` posts, with mean days to arrive; ties of the first day go by name."""
    long = posts.select("day_no", "community", F.explode(keys).alias("topic"))
    arrive = long.groupBy("topic", "community").agg(F.min("day_no").alias("d"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("topic")
    o = w.orderBy("d", "community")
    a = arrive.withColumn("total", F.sum("n").over(w)).where(F.col("total") >= least).withColumn("first", F.first("community").over(o)).withColumn("d0", F.first("d").over(o))
    return a.where("community != first").groupBy("first", "community").agg(F.count(F.lit(1)).alias("n_topics"), F.avg(F.col("d") - F.col("d0")).alias("mean_days"))
