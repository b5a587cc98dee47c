"""Curves of posts, profiles of sequences, keywords and communities, training rows and splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.states import safe_ratio
from .groups import alive
from .topics import day_index

POST = ["community", "post_id"]
#: Upper bounds in hours (inclusive) of the curve's age buckets and their names
AGE_BUCKETS = ((0.5, "0-30m"), (1, "30m-1h"), (2, "1-2h"), (3, "2-3h"), (4, "3-4h"), (6, "4-6h"), (8, "6-8h"), (12, "8-12h"), (18, "12-18h"), (24, "18-24h"), (36, "24-36h"), (48, "36-48h"), (72, "48-72h"))
GROWTH_BANDS = ((500, "500+"), (100, "100-500"), (50, "50-100"), (10, "10-50"))
LENGTH_BANDS = ((50, "Short (<50 chars)"), (80, "Medium (50-80)"), (120, "Long (80-120)"), (300, "Very long (120+)"))


def curve_bucket(age_minutes: Column) -> Column:
    out = None
    for upper, name in AGE_BUCKETS:
        out = (F if out is None else out).when(age_minutes / 60 <= upper, name)
    return out


def upvote_curve(rows: DataFrame, by: str) -> DataFrame:
    """Median and mean upvotes and number of snapshots per (by, age bucket); older snapshots than the last bucket are left out."""
    b = rows.withColumn("age_bucket", curve_bucket(F.col("age_minutes"))).where("age_bucket IS NOT NULL")
    return b.groupBy(by, "age_bucket").agg(F.count(F.lit(1)).alias("n"), F.median("upvotes").alias("median_upvotes"), F.avg("upvotes").alias("avg_upvotes"))


def span_velocities(rows: DataFrame, least_hours: float = 0.1) -> DataFrame:
    """Per post with two snapshots or more over `least_hours`: growth per hour from the first to the last, and the row in the middle (n / 2) of its sequence."""
    o = F.struct("age_minutes", "snapshot_no")
    w = Window.partitionBy(*POST).orderBy("age_minutes", "snapshot_no")
    mid = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*POST)))
    at = F.col("_k") == F.floor(F.col("_n") / 2)
    per = mid.groupBy(*POST).agg(F.count(F.lit(1)).alias("n"), ((F.max("age_minutes") - F.min("age_minutes")) / 60).alias("span"), (F.max_by("upvotes", o) - F.min_by("upvotes", o)).alias("_g"), F.max(F.when(at, F.col("snapshot_no"))).alias("midpoint"), F.max(F.when(at, F.col("upvotes"))).alias("midpoint_upvotes"))
    return per.where((F.col("n") >= 2) & (F.col("span") >= least_hours)).select(*POST, "n", (F.col("_g") / F.col("span")).alias("velocity"), "midpoint", "midpoint_upvotes")


def early_growth(rows: DataFrame, minutes: float = 30.0) -> DataFrame:
    """Per (band of growth until the first snapshot at `minutes` of age, last state): number of posts."""
    o = F.struct("hours", "snapshot_no")
    reached = F.when(F.col("age_minutes") >= minutes, o)
    per = rows.groupBy(*POST).agg(F.min_by("upvotes", o).alias("first"), F.min_by("upvotes", reached).alias("then"), F.max_by("state", o).alias("state"))
    growth, band = F.col("then") - F.col("first"), None
    for least, name in GROWTH_BANDS:
        band = (F if band is None else band).when(growth >= least, name)
    return per.where("then IS NOT NULL").groupBy(band.otherwise("0-10").alias("band"), "state").agg(F.count(F.lit(1)).alias("n"))


def community_direction(series: DataFrame, value: str) -> DataFrame:
    """Per community of one row a snapshot: slope of the value over its places (0 with under 3), and momentum: the mean of the last 5 against all (0 with under 7)."""
    w = Window.partitionBy("community")
    s = series.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy("snapshot_no")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    late = F.avg(F.when(F.col("_i") >= F.col("_n") - 5, F.col(value)))
    per = s.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, "_i").alias("_s"), F.avg(value).alias("mean"), late.alias("_l"))
    momentum = F.when((F.col("n") >= 7) & (F.col("mean") != 0), (F.col("_l") - F.col("mean")) / F.abs("mean")).otherwise(0.0)
    return per.select("community", "n", F.when(F.col("n") >= 3, F.col("_s")).otherwise(0.0).alias("slope"), "mean", momentum.alias("momentum"))


def sequence_profiles(rows: DataFrame, low: float = 0.75, high: float = 1.5, large: float = 2.5) -> DataFrame:
    """Per post of rows (hours since an UTC midnight): length, span, night snapshots (0 to 5 o'clock) and carry-over between night and day, gaps between its group's snapshots, maxima."""
    o = F.struct("hours", "snapshot_no")
    night = (F.col("hours") % 24) < 6
    first = Window.partitionBy(*POST).orderBy("hours", "snapshot_no")
    r = rows.withColumn("_night", night).withColumn("_first", F.row_number().over(first) == 1)
    gap = F.when(~F.col("_first") & (F.col("hours_since_previous") != 0), F.col("hours_since_previous"))
    odd = (gap < low) | (gap > high)
    per = r.groupBy(*POST).agg(
        F.count(F.lit(1)).alias("length"), (F.max("hours") - F.min("hours")).alias("span"), F.min_by("_night", o).alias("_fn"), F.count_if("_night").alias("night_snapshots"), F.count_if(~F.col("_night")).alias("day_snapshots"), F.count_if(F.col("_night") & ~F.col("_first")).alias("_late_nights"),
        F.median(gap).alias("median_gap"), F.max(gap).alias("max_gap"), F.count(gap).alias("_gaps"), F.count_if(odd).alias("irregular_gaps"), F.count_if(gap > large).alias("large_gaps"), F.max("upvotes").alias("max_upvotes"), F.max("comments").alias("max_comments"), F.max("upvote_velocity").alias("max_upvote_velocity"), F.max("comment_velocity").alias("max_comment_velocity"),
    )
    return per.select(
        *POST, "length", "span", "night_snapshots", "day_snapshots", (F.col("night_snapshots") / F.col("length")).alias("night_share"), (F.col("_fn") & (F.col("day_snapshots") > 0)).cast("int").alias("carried_to_day"), (~F.col("_fn") & (F.col("_late_nights") > 0)).cast("int").alias("carried_to_night"),
        "median_gap", "max_gap", "irregular_gaps", "large_gaps", safe_ratio(F.col("_gaps") - F.col("irregular_gaps"), F.col("_gaps")).alias("regular_gap_share"), "max_upvotes", "max_comments", "max_upvote_velocity", "max_comment_velocity",
    )


def prediction_rows(rows: DataFrame) -> DataFrame:
    """The wide training frame: each snapshot with its state, sequence, rank and gap features, and seven labels of the post in its community's next snapshot.

    One window over the post serves features and labels: the next row of the post is the next snapshot's where the numbers agree."""
    o = Window.partitionBy(*POST).orderBy("hours", "snapshot_no")
    p = Window.partitionBy(*POST)
    is_next = F.lead("snapshot_no").over(o) == F.col("next_no")
    nxt = lambda c: F.when(is_next, F.lead(c).over(o))
    per_hour = lambda c: safe_ratio(nxt(c) - F.col(c), F.col("hours_to_next"))
    v, before = F.col("upvote_velocity"), F.lag("upvote_velocity").over(o)
    place, n = F.row_number().over(o), F.count(F.lit(1)).over(p)
    in_set = lambda c, *s: F.when(c.isNotNull(), c.isin(*s).cast("int"))
    return rows.select(
        *POST, "snapshot_no", "hours", "age_minutes", "upvotes", "comments", "rank", "listing", "state", "hours_since_previous", "hours_to_next", "upvote_delta", "comment_delta", "upvote_velocity", "comment_velocity",
        place.alias("position"), (place / n).alias("progress"), (F.col("hours") - F.min("hours").over(p)).alias("hours_since_first"), before.alias("previous_velocity"), (v - before).alias("velocity_change"), safe_ratio(v, F.max("upvote_velocity").over(o.rowsBetween(Window.unboundedPreceding, -1))).alias("ratio_to_prior_peak"),
        (F.lag("rank").over(o) - F.col("rank")).alias("rank_change"), (F.coalesce(F.lag("listing").over(o), F.col("listing")) != F.col("listing")).cast("int").alias("listing_changed"), F.lag("state").over(o).alias("previous_state"), (F.pmod(F.col("hours").cast("int"), F.lit(24)) < 6).cast("int").alias("is_night"),
        nxt("state").alias("next_state"), per_hour("upvotes").alias("next_upvotes_per_hour"), per_hour("comments").alias("next_comments_per_hour"), in_set(nxt("state"), "surging", "alive", "emerging").alias("next_is_alive"), in_set(nxt("state"), "surging").alias("next_is_surging"), in_set(nxt("state"), "dying", "dead").alias("next_is_dying"), F.col("still_visible_next").alias("next_is_visible"),
    )


def chronological_split(rows: DataFrame, order: str, tie: str, share: float = 0.8) -> DataFrame:
    """rows with split: train for the first `share` of rows by (order, tie), else test. Counts per value of the order place all but the rows of the one value that
    the cut falls in, and only these are ranked."""
    per = rows.groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(order)  # one row per time
    marks = per.withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    cut = rows.agg(F.floor(F.count(F.lit(1)) * share).alias("_cut"))
    both = rows.join(marks, order).crossJoin(F.broadcast(cut))
    inside = (F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_n") > F.col("_cut"))
    edge = both.where(inside).withColumn("_r", F.row_number().over(Window.partitionBy(order).orderBy(tie)))
    edge = edge.withColumn("split", F.when(F.col("_before") + F.col("_r") <= F.col("_cut"), "train").otherwise("test")).drop("_r")
    rest = both.where(~inside).withColumn("split", F.when(F.col("_before") + F.col("_n") <= F.col("_cut"), "train").otherwise("test"))
    return rest.unionByName(edge).drop("_n", "_before", "_cut")


def standard_spec(rows: DataFrame, numbers: list[str], labels: list[str], most: int = 12) -> DataFrame:
    """feature, kind, mean, deviation (population; 1 where 0) of numbers (null is 0), and each label column's `most` frequent values with their place (ties by name); others are rare."""
    m = rows.agg(*[F.array(F.avg(F.coalesce(c, F.lit(0.0))), F.stddev_pop(F.coalesce(c, F.lit(0.0)))).alias(c) for c in numbers])
    num = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)[0].alias("mean"), F.when(F.col(c)[1] == 0, 1.0).otherwise(F.col(c)[1]).alias("deviation")) for c in numbers])).alias("x")).select("x.feature", F.lit("number").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("place"), "x.mean", "x.deviation")
    out = num
    for c in labels:
        seen = rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("__none__")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)
        top = seen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # `most` rows
        out = out.unionByName(top.select(F.lit(c).alias("feature"), F.lit("category").alias("kind"), "value", "place", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("deviation")))
    return out


def mean_by(rows: DataFrame, by: str, measures: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in measures])


def group_ratios(rows: DataFrame, flag: str, features: list[str]) -> DataFrame:
    """Per feature: its mean where the flag holds, where not, and their ratio."""
    agg = rows.agg(*[F.struct(F.avg(F.when(F.col(flag), F.col(c))).alias("yes"), F.avg(F.when(~F.col(flag), F.col(c))).alias("no")).alias(c) for c in features])
    x = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["yes"].alias("mean_yes"), F.col(c)["no"].alias("mean_no")) for c in features])).alias("x")).select("x.*")
    return x.withColumn("ratio", safe_ratio(F.col("mean_yes"), F.col("mean_no")))


def length_bands(posts: DataFrame) -> DataFrame:
    """Per band of title length: posts, share of living ones, median and mean upvotes."""
    n, band = F.length("title"), None
    for upper, name in LENGTH_BANDS:
        band = (F if band is None else band).when(n < upper, name)
    return posts.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(alive().cast("double")).alias("alive_rate"), F.median("upvotes").alias("median_upvotes"), F.avg("upvotes").alias("avg_upvotes"))


def keyword_profiles(posts: DataFrame, keys: str, measures: DataFrame, low: int, high: int, ahead: int = 3) -> DataFrame:
    """Per (day, keyword) with `low` to `high` posts and `ahead` days to come: shares of the best posts, spread, states, authors, hours, discussion of its posts.

    measures: post_id, gini, n_comments of posts with comments. Counts decide first which (day, keyword) are small enough, so no list of a frequent word's posts is ever
    built; days on which the keyword was seen before are counted by a window over its own days."""
    long = posts.select("day_no", "community", "post_id", "upvotes", "state", "author", "created_hour", F.explode(keys).alias("topic"))
    d = day_index(long.groupBy("day_no", "topic").agg(F.count(F.lit(1)).alias("n")))
    last = d.agg(F.max("day_idx").alias("last_idx"))
    o = Window.partitionBy("topic").orderBy("day_idx")
    d = d.withColumn("days_before", F.row_number().over(o) - 1).withColumn("future_peak", F.coalesce(F.max("n").over(o.rangeBetween(1, ahead)), F.lit(0)))
    small = d.crossJoin(F.broadcast(last)).where(F.col("n").between(low, high) & (F.col("day_idx") + ahead <= F.col("last_idx"))).select("day_no", "topic", "n", "days_before", "future_peak")
    has = F.col("n_comments") > 0
    use = long.join(small, ["day_no", "topic"]).join(measures, "post_id", "left").groupBy("day_no", "topic").agg(
        F.first("n").alias("n"), F.first("days_before").alias("days_before"), F.first("future_peak").alias("future_peak"), F.sum("upvotes").alias("total"), F.count_distinct("community").alias("n_communities"), F.avg((F.col("state") == "surging").cast("double")).alias("surging_rate"), F.avg(alive().cast("double")).alias("alive_rate"),
        F.avg(F.col("state").isin("dead", "dying").cast("double")).alias("dead_rate"), F.sort_array(F.collect_list("upvotes"), asc=False).alias("ups"), F.count_distinct("author").alias("n_authors"), (F.max("created_hour") - F.min("created_hour")).alias("hour_spread"), F.coalesce(F.max("n_comments"), F.lit(0)).alias("best_comments"),
        F.max(F.coalesce("gini", F.lit(0.0))).alias("best_gini"), F.max((F.col("state") == "surging").cast("int")).alias("any_surging"), F.coalesce(F.avg(F.when(has, (F.col("gini") > 0.5).cast("double"))), F.lit(0.0)).alias("high_gini_share"), F.coalesce(F.avg(F.when(has, F.col("gini"))), F.lit(0.0)).alias("avg_gini"),
    )
    top, bottom = F.element_at("ups", 1), F.element_at("ups", -1)
    sum3 = F.aggregate(F.slice("ups", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x)
    least1 = F.greatest(F.col("total"), F.lit(1))
    return use.select(
        "day_no", "topic", F.col("n").alias("n_posts"), F.col("total").alias("total_upvotes"), "n_communities", "days_before", "surging_rate", "alive_rate", "dead_rate", (top / least1).alias("top_share"), F.when(F.col("n") >= 3, sum3 / least1).otherwise(1.0).alias("top3_share"), F.when(bottom > 0, top / F.greatest(bottom, F.lit(1))).otherwise(top).cast("double").alias("best_to_worst"),
        top.alias("best_upvotes"), "best_comments", "best_gini", "any_surging", "high_gini_share", "avg_gini", "n_authors", (F.col("n_authors") / F.col("n")).alias("author_ratio"), F.col("hour_spread"), ((F.col("hour_spread") <= 2) & (F.col("n") >= 2)).cast("int").alias("concentrated"), "future_peak", (F.col("future_peak") > F.col("n") * 1.5).alias("grows"),
    )


#: Posts of a day that are a block; the posts of two blocks are compared in one group
TITLES_A_BLOCK = 8192


def title_diversity(posts: DataFrame, keys: str, words: str, most: int | None = None) -> DataFrame:
    """Per (day, keyword) with 2 posts or more (and `most` at most, if given): mean Jaccard distance of its titles' word sets over all pairs in which a word occurs; 0 without such pairs.

    A day's posts are dealt into blocks and compared block by block, each with all others that share a keyword; a distance is taken once, whatever keywords the two share. So titles
    don't go along with each keyword, no pair is a row, and a task holds two blocks, however many posts a keyword has."""
    # a title's words are one text with a control character between them, which needs fewer bytes than an array
    rows = posts.select("day_no", "post_id", F.concat_ws("\x01", F.array_distinct(words)).alias("w"), F.col(keys).alias("k"))
    blocks = posts.groupBy("day_no").agg(F.ceil(F.count(F.lit(1)) / TITLES_A_BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(blocks), "day_no").withColumn("mine", F.pmod(F.xxhash64("post_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("day_no", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list(F.struct("mine", "w", "k")).alias("s"))
    schema = T.StructType([groups.schema["day_no"], T.StructField("topic", T.StringType()), *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("pairs", T.LongType()), ("total", T.DoubleType()))]])
    per = groups.mapInArrow(_distances, schema).groupBy("day_no", "topic").agg(F.sum("n").alias("n_posts"), F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))
    enough = F.col("n_posts") > 1 if most is None else F.col("n_posts").between(2, most)
    return per.where(enough).select("day_no", "topic", "n_posts", (F.col("total") / F.greatest("pairs", F.lit(1))).alias("diversity"))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each day, keyword and two blocks (i, j): the posts (where i = j), the pairs in which a word occurs and the sum of their distances."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows, i, j = batch["s"].slice(k, 1).flatten(), batch["i"][k].as_py(), batch["j"][k].as_py()
            mine = rows.field("mine").to_numpy()
            of_key, key, keys = _numbered(rows.field("k"))
            of_word, word, _ = _numbered(pc.split_pattern(pc.fill_null(rows.field("w"), ""), "\x01"))
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            n, pairs, total = _compared(left, right, i == j, of_key, key, of_word, word, len(keys))
            some = np.flatnonzero((n > 0) | (pairs > 0))
            day = pa.array([batch["day_no"][k].as_py()], batch["day_no"].type).take(pa.array(np.zeros(len(some), np.int64)))
            yield pa.RecordBatch.from_arrays([day, keys.take(pa.array(some)), pa.array(n[some]), pa.array(pairs[some]), pa.array(total[some])], names=["day_no", "topic", "n", "pairs", "total"])


def _numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each row's values begin (and the last ones end), the values as numbers, and what the numbers stand for. A list of one empty text has none."""
    ends, values = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    ends = ends - ends[0]
    keep = pc.not_equal(values, "").to_numpy(zero_copy_only=False).astype(bool)
    values = values.filter(pa.array(keep)).dictionary_encode()
    return np.r_[0, np.cumsum(keep)][ends], values.indices.to_numpy().astype(np.int64), values.dictionary


def _places(rows: np.ndarray, upto: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each value's rows (as places in `rows`, rising) begin, and these rows."""
    size = upto[rows + 1] - upto[rows]
    row, own = np.repeat(np.arange(len(rows)), size), np.concatenate([value[upto[r] : upto[r + 1]] for r in rows.tolist()] or [value[:0]])
    return np.r_[0, np.cumsum(np.bincount(own, minlength=n))], row[np.argsort(own, kind="stable")]


def _compared(left: np.ndarray, right: np.ndarray, same: bool, of_key: np.ndarray, key: np.ndarray, of_word: np.ndarray, word: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per keyword the posts (if `same`), the pairs and their distances: each post of the left with those of the right (behind it, if `same`) that have the keyword."""
    n, pairs, total = np.zeros(n_keys, np.int64), np.zeros(n_keys, np.int64), np.zeros(n_keys)
    key_at, key_rows = _places(right, of_key, key, n_keys)
    word_at, word_rows = _places(right, of_word, word, int(word.max()) + 1 if len(word) else 0)
    size, begin, end = (of_word[1:] - of_word[:-1])[right], key_at[:-1].copy(), key_at[1:]
    for at, a in enumerate(left.tolist()):
        mine, words = key[of_key[a] : of_key[a + 1]], word[of_word[a] : of_word[a + 1]]
        if same:
            n[mine] += 1
            begin[mine] += 1  # the post itself comes first among those that are left
        b, e = begin[mine], end[mine]
        mine, b, e = mine[b < e], b[b < e], e[b < e]
        if not len(mine):
            continue
        at_words = [word_rows[x:y] for x, y in zip(word_at[words].tolist(), word_at[words + 1].tolist())]
        both = np.bincount(np.concatenate(at_words), minlength=len(right)) if at_words else np.zeros(len(right), np.int64)
        union = size + len(words) - both
        distance, counts = np.where(union > 0, 1 - both / np.maximum(union, 1), 0.0), union > 0
        others = np.concatenate([key_rows[x:y] for x, y in zip(b.tolist(), e.tolist())])
        first = np.r_[0, np.cumsum(e - b)[:-1]]
        total[mine] += np.add.reduceat(distance[others], first)
        pairs[mine] += e - b if len(words) else np.add.reduceat(counts[others].astype(np.int64), first)
    return n, pairs, total


def comment_keyword_lift(comments: DataFrame, status: DataFrame, words: Column, least: int) -> DataFrame:
    """Per word of at least `least` comments whose post is known: means of the comments' upvotes and the posts', share of living posts, and the lift of each on all such comments."""
    j = comments.where(~F.trim(F.coalesce("body", F.lit(""))).isin("", "[deleted]", "[removed]")).join(status.select("post_id", F.col("upvotes").alias("parent_upvotes"), alive().cast("double").alias("parent_alive")), "post_id")
    measures = ["upvotes", "parent_upvotes", "parent_alive"]
    every = j.agg(*[F.avg(c).alias(f"all_{c}") for c in measures])
    per = j.select(*measures, F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in measures]).where(F.col("n") >= least)
    return per.crossJoin(F.broadcast(every)).select("word", "n", *measures, *[(F.col(c) - F.col(f"all_{c}")).alias(f"lift_{c}") for c in measures])


def best_and_worst(df: DataFrame, name: str, measure: str, n: int) -> DataFrame:
    """The `n` rows with most and with least of a measure (a top-k report); ties by name."""
    side = lambda label, order: df.orderBy(order, name).limit(n).select(F.lit(label).alias("side"), name, measure)
    return side("best", F.desc(measure)).unionByName(side("worst", F.asc(measure)))


def first_topic(posts: DataFrame, keys: str) -> DataFrame:
    """Each post that has a topic with its first one, by name."""
    return posts.where(F.size(keys) > 0).select("post_id", "community", "state", F.array_min(keys).alias("topic"))


def bucketed_transitions(rows: DataFrame, age: Column, velocity: Column) -> DataFrame:
    """Counts of (community, age bucket, velocity bucket, state, next state) over posts that are in their community's next snapshot, with the support of each origin."""
    o = Window.partitionBy(*POST).orderBy("hours", "snapshot_no")
    nxt = F.when(F.lead("snapshot_no").over(o) == F.col("next_no"), F.lead("state").over(o))
    t = rows.select("community", age.alias("age_bucket"), velocity.alias("velocity_bucket"), "state", nxt.alias("next_state")).where("next_state IS NOT NULL")
    n = t.groupBy("community", "age_bucket", "velocity_bucket", "state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("support", F.sum("n").over(Window.partitionBy("community", "age_bucket", "velocity_bucket", "state")))


def initial_states(rows: DataFrame, minutes: float, least: int) -> DataFrame:
    """Per community: distribution of states among rows of at most `minutes` of age; communities with under `least` such rows take all communities'."""
    early = rows.where(F.col("age_minutes") <= minutes)
    n = early.groupBy("community", "state").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.groupBy("state").agg(F.sum("n").alias("n"))
    whole = all_.agg(F.sum("n").alias("t"))
    every = all_.crossJoin(F.broadcast(whole)).select("state", (F.col("n") / F.col("t")).alias("p0"))
    own = n.withColumn("t", F.sum("n").over(Window.partitionBy("community")))
    enough = own.where(F.col("t") >= least).select("community", "state", (F.col("n") / F.col("t")).alias("p"), F.lit("community").alias("source"))
    poor = rows.select("community").distinct().join(enough.select("community").distinct(), "community", "left_anti")
    return enough.unionByName(poor.crossJoin(F.broadcast(every)).select("community", "state", F.col("p0").alias("p"), F.lit("all").alias("source")))
