"""Post timelines: neighbour snapshots, velocities, empirical thresholds, states, lifecycles and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import THRESHOLDS, activity_state, safe_ratio
from . import quantiles

#: Thresholds without any data, floors, and the least samples of a community
DEFAULTS = {"alive_upvotes": 20.0, "alive_comments": 2.0, "surging_upvotes": 100.0, "surging_comments": 10.0, "dead_upvotes": 5.0, "dead_comments": 0.5}
ALIVE_FLOOR, DEAD_FLOOR = {"upvotes": 1.0, "comments": 0.25}, {"upvotes": 0.1, "comments": 0.05}
#: what tells posts apart
POST = ("community", "post_id")
LEAST = {"rows": 30, "upvotes": 15, "comments": 10}


def neighbour_snapshots(rows: DataFrame, group: tuple[str, ...] = ("community",)) -> DataFrame:
    """rows (snapshot_no, post_id, hours, upvotes, comments and the group's columns; one row of a post in a snapshot of its group) with the group's previous and next
    snapshot, 0/1 flags whether the post is there (null at the ends of the group), deltas and velocities per hour.

    Snapshots are ordered once per group over distinct snapshots only, a small table. One window over the post then has the rows beside each: they are the
    neighbour snapshots' where the numbers agree. Later windows over the post need no other shuffle."""
    g = list(group)
    w = Window.partitionBy(*g).orderBy(F.col("hours").asc_nulls_first(), "snapshot_no")
    snaps = rows.select(*g, "snapshot_no", "hours").distinct()
    snaps = snaps.select(*g, "snapshot_no", F.lag("snapshot_no").over(w).alias("previous_no"), F.lead("snapshot_no").over(w).alias("next_no"), (F.col("hours") - F.lag("hours").over(w)).alias("hours_since_previous"), (F.lead("hours").over(w) - F.col("hours")).alias("hours_to_next"))
    o = Window.partitionBy(*g, "post_id").orderBy(F.col("hours").asc_nulls_first(), "snapshot_no")
    both = rows.join(snaps, [*g, "snapshot_no"])
    before = F.lag("snapshot_no").over(o) == F.col("previous_no")
    after = F.lead("snapshot_no").over(o) == F.col("next_no")
    flag = lambda side, there: F.when(F.col(side).isNotNull(), F.coalesce(there, F.lit(False)).cast("int"))
    delta = lambda c: F.when(before, F.col(c) - F.lag(c).over(o))
    seen = both.select(*rows.columns, "previous_no", "next_no", "hours_since_previous", "hours_to_next", flag("previous_no", before).alias("seen_in_previous"), flag("next_no", after).alias("still_visible_next"), delta("upvotes").alias("upvote_delta"), delta("comments").alias("comment_delta"))
    rate = lambda c: F.when(F.col("hours_since_previous") > 0, F.col(c) / F.col("hours_since_previous"))
    return seen.withColumns({"upvote_velocity": rate("upvote_delta"), "comment_velocity": rate("comment_delta")})


def _derive(quantile, base) -> dict[str, Column]:
    """The six thresholds from quantiles (35, 80, 10 %) of positive velocities, with floors and couplings."""
    out = {}
    for m in ("upvotes", "comments"):
        alive = F.greatest(F.lit(ALIVE_FLOOR[m]), F.coalesce(quantile(m, 0), base(f"alive_{m}")))
        out[f"alive_{m}"] = alive
        out[f"surging_{m}"] = F.greatest(alive * 3, F.coalesce(quantile(m, 1), base(f"surging_{m}")))
        out[f"dead_{m}"] = F.greatest(F.lit(DEAD_FLOOR[m]), F.least(alive * 0.5, F.coalesce(quantile(m, 2), base(f"dead_{m}"))))
    return out


def activity_thresholds(rows: DataFrame) -> DataFrame:
    """community (null: all), source, six thresholds, sample counts. Communities with too few samples take the global row's values; without any sample the defaults hold.

    rows are read several times, so the caller writes them once; the join with the global row is one to few."""
    use = rows.where(F.col("seen_in_previous") == 1)
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    counted = use.rollup("community").agg(F.grouping("community").alias("is_global"), F.count("upvote_velocity").alias("sample_count"), F.count(pos("upvote_velocity")).alias("positive_upvotes"), F.count(pos("comment_velocity")).alias("positive_comments"))
    positive = use.select("community", pos("upvote_velocity").alias("q_upvotes"), pos("comment_velocity").alias("q_comments"))
    wanted = {"q_upvotes": [0.35, 0.8, 0.1], "q_comments": [0.35, 0.8, 0.1]}
    own_q = quantiles.by_group(positive, "community", wanted).withColumnRenamed("community", "_c")
    agg = counted.where("is_global = 0").join(own_q, F.col("community").eqNullSafe(F.col("_c")), "left").drop("_c").unionByName(counted.where("is_global = 1").crossJoin(quantiles.by_group(positive, None, wanted)))  # one row each
    q = lambda m, i: F.get(F.col(f"q_{m}"), i)
    whole = agg.where("is_global = 1").select("*", *[c.alias(f"g_{k}") for k, c in _derive(q, lambda k: F.lit(DEFAULTS[k])).items()])
    g = F.broadcast(whole.select(*[f"g_{k}" for k in THRESHOLDS]))
    own = agg.where("is_global = 0").crossJoin(g)  # the other side is the one global row
    enough = (F.col("sample_count") >= LEAST["rows"]) & (F.col("positive_upvotes") >= LEAST["upvotes"]) & (F.col("positive_comments") >= LEAST["comments"])
    mine = _derive(q, lambda k: F.col(f"g_{k}"))
    counts = ["sample_count", "positive_upvotes", "positive_comments"]
    own = own.select("community", F.when(enough, "community").otherwise("global_fallback").alias("source"), *counts, *[F.when(enough, mine[k]).otherwise(F.col(f"g_{k}")).alias(k) for k in THRESHOLDS])
    return own.unionByName(whole.select(F.lit(None).cast(dict(agg.dtypes)["community"]).alias("community"), F.when(F.col("sample_count") > 0, "global").otherwise("default").alias("source"), *counts, *[F.col(f"g_{k}").alias(k) for k in THRESHOLDS]))


def with_states(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows of neighbour_snapshots with age_minutes (from the post's first snapshot where absent), thresholds and state. Communities without a row take the global one."""
    own = thresholds.where("community IS NOT NULL").select("community", *THRESHOLDS)
    g = thresholds.where("community IS NULL").select(*[F.col(k).alias(f"g_{k}") for k in THRESHOLDS])
    if "age_minutes" not in rows.columns:
        rows = rows.withColumn("age_minutes", (F.col("hours") - F.min("hours").over(Window.partitionBy(*POST))) * 60)
    both = rows.join(own, "community", "left").crossJoin(F.broadcast(g))
    return both.select(*rows.columns, *[F.coalesce(k, f"g_{k}").alias(k) for k in THRESHOLDS]).withColumn("state", activity_state())


def new_and_persisting(rows: DataFrame) -> DataFrame:
    """Per (community, snapshot): posts, those new since the previous snapshot and those that persist (null in the first)."""
    return neighbour_snapshots(rows).groupBy("community", "snapshot_no").agg(F.count(F.lit(1)).alias("n_posts"), F.count_if(F.col("seen_in_previous") == 0).alias("n_new"), F.count_if(F.col("seen_in_previous") == 1).alias("n_persisting"))


def lifecycles(rows: DataFrame) -> DataFrame:
    """One row per post of with_states' rows: span, growth, extremes, last state, states and their order, visible-next count."""
    first = lambda c: F.min_by(c, F.struct("hours", "snapshot_no"))
    last = lambda c: F.max_by(c, F.struct("hours", "snapshot_no"))
    seen = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("hours", "snapshot_no", "state"))), lambda x: x["state"]))
    return rows.groupBy("community", "post_id").agg(
        F.count(F.lit(1)).alias("snapshot_count"), (F.max("hours") - F.min("hours")).alias("observed_hours"), (last("upvotes") - first("upvotes")).alias("upvote_growth"), (last("comments") - first("comments")).alias("comment_growth"),
        F.max("upvotes").alias("max_upvotes"), F.max("upvote_velocity").alias("max_upvote_velocity"), last("upvote_velocity").alias("last_upvote_velocity"), last("comment_velocity").alias("last_comment_velocity"),
        last("state").alias("latest_state"), F.concat_ws("|", seen).alias("states_seen"), F.count_if(F.col("still_visible_next") == 1).alias("visible_next_count"), *[last(k).alias(k) for k in THRESHOLDS],
    )


def sequence_features(rows: DataFrame) -> DataFrame:
    """Position, progress, lags, accelerations and ratios of each snapshot within its post's sequence."""
    p = Window.partitionBy(*POST)
    o = p.orderBy("hours", "snapshot_no")
    prior = o.rowsBetween(Window.unboundedPreceding, -1)
    v, before = F.col("upvote_velocity"), F.lag("upvote_velocity").over(o)
    gap = F.col("hours") - F.lag("hours").over(o)
    pos, n = F.row_number().over(o), F.count(F.lit(1)).over(p)
    return rows.select(
        *POST, "snapshot_no", pos.alias("position"), (n - pos).alias("remaining"), (pos / n).alias("progress"), (F.col("hours") - F.min("hours").over(p)).alias("hours_since_first"), (F.max("hours").over(p) - F.col("hours")).alias("hours_until_last"),
        before.alias("previous_velocity"), (v - before).alias("velocity_change"), F.when(gap > 0, (v - before) / gap).alias("acceleration"), safe_ratio(v, before).alias("ratio_to_previous"),
        safe_ratio(v, F.max("upvote_velocity").over(prior)).alias("ratio_to_prior_peak"), safe_ratio(v, F.avg("upvote_velocity").over(o.rowsBetween(-2, -1))).alias("ratio_to_mean_2"),
    )


def run_lengths(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: run number, place in the run, previous value and a change flag of `value` along `order` within `key`."""
    o = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((F.lag(value).over(o) != F.col(value)).cast("int"), F.lit(1))
    marked = rows.withColumn("changed", change).withColumn("previous_value", F.lag(value).over(o)).withColumn("run_no", F.sum("changed").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("run_length", F.row_number().over(Window.partitionBy(key, "run_no").orderBy(order)))


def prior_repeats(rows: DataFrame, key: list[str], who: str, seconds: str, span: int = 86400) -> DataFrame:
    """rows with prior_repeats: other `who`s of the same key whose first time lies in [t - span, t).

    First times are aggregated first and counted, not joined: those before t less those before t - span, each as the sum of whole spans before and a running count within one, so a row costs the same however
    many first times lie in its span."""
    first = rows.where(F.col(who).isNotNull() & F.col(seconds).isNotNull()).groupBy(*key, who).agg(F.min(seconds).alias("_first"))
    at = lambda t, kind, n: [*key, t.alias("_t"), F.floor(t / span).alias("_bucket"), F.lit(kind).alias("_kind"), n.cast("long").alias("_n")]
    times = rows.where(F.col(seconds).isNotNull()).select(*key, seconds).distinct()
    counted = first.groupBy(*key, "_first").agg(F.count(F.lit(1)).alias("_n"))
    points = counted.select(*at(F.col("_first"), 1, F.col("_n")))
    for back in (0, span):  # at equal times those that look come before what is counted
        points = points.unionByName(times.select(*at(F.col(seconds) - back, 0 if back else -1, F.lit(0))))
    inside = Window.partitionBy(*key, "_bucket").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("_c", F.sum("_n").over(inside)).where("_kind < 1")
    whole = counted.groupBy(*key, F.floor(F.col("_first") / span).alias("_bucket")).agg(F.sum("_n").alias("_n"))
    whole = whole.select(*key, "_bucket", F.sum("_n").over(Window.partitionBy(*key).orderBy("_bucket")).alias("_upto"), (F.lead("_bucket").over(Window.partitionBy(*key).orderBy("_bucket"))).alias("_next"))  # a row for each span that has any
    # what stands before a span is what the last one with first times before it has in all
    later = whole.select(*key, F.explode(F.sequence(F.col("_bucket") + 1, F.coalesce("_next", F.col("_bucket") + 1))).alias("_bucket"), "_upto")
    last = whole.where("_next IS NULL").select(*key, F.col("_bucket").alias("_end"), F.col("_upto").alias("_all"))
    points = points.drop("_n").join(later, [*key, "_bucket"], "left").join(last, key, "left")
    points = points.withColumn("_c", F.col("_c") + F.when(F.col("_bucket") > F.col("_end"), F.col("_all")).otherwise(F.coalesce("_upto", F.lit(0))))
    n = points.groupBy(*key, (F.col("_t") + F.when(F.col("_kind") == 0, F.lit(span)).otherwise(F.lit(0))).alias(seconds)).agg(F.sum(F.when(F.col("_kind") == 0, -F.col("_c")).otherwise(F.col("_c"))).alias("_n"))
    out = rows.join(n, [*key, seconds], "left").join(first, [*key, who], "left")
    own = F.coalesce(((F.col("_first") < F.col(seconds)) & (F.col("_first") >= F.col(seconds) - span)).cast("long"), F.lit(0))
    return out.select(*[F.col(c) for c in rows.columns], F.when(F.col(who).isNull(), F.lit(0)).otherwise(F.coalesce(F.col("_n") - own, F.lit(0))).cast("long").alias("prior_repeats"))


def next_labels(rows: DataFrame, *keep: str) -> DataFrame:
    """Each state row with the post's state and growth per hour in its group's next snapshot, and eligibility by the gap."""
    o = Window.partitionBy(*POST).orderBy("hours", "snapshot_no")
    is_next = F.lead("snapshot_no").over(o) == F.col("next_no")
    nxt = lambda c: F.when(is_next, F.lead(c).over(o))
    growth = safe_ratio(nxt("upvotes") - F.col("upvotes"), F.col("hours_to_next"))
    return rows.select(*POST, "snapshot_no", "state", nxt("state").alias("next_state"), growth.alias("next_growth_per_hour"), F.col("hours_to_next").between(0.5, 2.5).alias("eligible_broad"), F.col("hours_to_next").between(0.75, 1.5).alias("eligible_strict"), *keep)


def variance_collapse(rows: DataFrame, value: str = "upvote_velocity", window: int = 4, high: float = 15.0, low: float = 8.0, mean: float = 40.0) -> DataFrame:
    """community, post_id, n, collapse_index: the first place where the sample deviation of the `window` values before is above `high`, that of the `window` from it
    on below `low`, their mean below `mean` and the last not above the first. Zeros beside a value over 10 are collection gaps and left out first."""
    o = Window.partitionBy(*POST).orderBy("hours", "snapshot_no")
    v = F.coalesce(F.col(value), F.lit(0.0))
    kept = rows.withColumn("v", v).withColumn("_near", F.greatest(F.coalesce(F.lag("v").over(o), F.lit(0.0)), F.coalesce(F.lead("v").over(o), F.lit(0.0)))).where(~((F.col("v") == 0) & (F.col("_near") > 10)))
    idx, n = F.row_number().over(o) - 1, F.count(F.lit(1)).over(Window.partitionBy(*POST))
    ahead = o.rowsBetween(0, window - 1)
    seen = kept.select(*POST, idx.alias("i"), n.alias("n"), F.stddev_samp("v").over(o.rowsBetween(-window, -1)).alias("before"), F.stddev_samp("v").over(ahead).alias("after"), F.avg("v").over(ahead).alias("m"), F.last("v").over(ahead).alias("z"), F.col("v").alias("a"))
    hit = (F.col("n") >= 2 * window + 1) & (F.col("i") >= window) & (F.col("i") < F.col("n") - window) & (F.col("before") > high) & (F.col("after") < low) & (F.col("m") < mean) & (F.col("z") <= F.col("a"))
    return seen.groupBy(*POST).agg(F.max("n").alias("n"), F.min(F.when(hit, F.col("i"))).cast("int").alias("collapse_index"))


def pools(rows: DataFrame, least: int = 5, old_hours: float = 24.0) -> DataFrame:
    """Active, dormant or dropped pool of each post, from its state rows (written once by the caller; they are read twice).

    Active with fewer than `least` snapshots, with a revival signal (of the last 3 of at least 4 snapshots two fast ones, or one in a `rising` listing where
    there is a listing column) or before its variance collapses; then dropped where the last 3 are quiet and dead and the post is `old_hours` old, else dormant."""
    o = Window.partitionBy(*POST)
    back = rows.withColumn("_r", F.row_number().over(o.orderBy(F.desc("hours"), F.desc("snapshot_no")))).withColumn("_n", F.count(F.lit(1)).over(o)).where("_r <= 3")
    v, c = F.coalesce("upvote_velocity", F.lit(0.0)), F.coalesce("comment_velocity", F.lit(0.0))
    rising = F.count_if(F.col("listing") == "rising") if "listing" in rows.columns else F.lit(0)
    per = back.groupBy(*POST).agg(
        F.max("_n").alias("n"), F.max(v).alias("max_v"), F.max(c).alias("max_c"), F.count_if(F.col("state").isin("dead", "dying")).alias("n_dead"), F.count_if(v > 20).alias("v_spikes"), F.count_if(c > 5).alias("c_spikes"), rising.alias("n_rising"),
        F.min_by("state", "_r").alias("state"), (F.min_by("age_minutes", "_r") / 60).alias("age_hours"),
    )
    both = per.join(variance_collapse(rows).select(*POST, "collapse_index"), list(POST), "left")
    dead = (F.col("n") >= 3) & (F.col("max_v") <= 5) & (F.col("max_c") <= 0.5) & (F.col("n_dead") >= 2)
    revival = (F.col("n") >= 4) & ((F.col("v_spikes") >= 2) | (F.col("c_spikes") >= 2) | (F.col("n_rising") >= 1))
    pool = F.when((F.col("n") < least) | revival | F.col("collapse_index").isNull(), "active").when(dead & (F.coalesce("age_hours", F.lit(0.0)) >= old_hours), "dropped").otherwise("dormant")
    return both.select(*POST, "state", pool.alias("pool"), revival.alias("revival"), dead.alias("confirmed_dead"), "collapse_index")


def pool_summary(of_posts: DataFrame) -> DataFrame:
    """Per community: posts in each pool, all of them and the active ones' percentage."""
    n = {p: F.count_if(F.col("pool") == p) for p in ("active", "dormant", "dropped")}
    per = of_posts.groupBy("community").agg(*[c.alias(p) for p, c in n.items()], F.count(F.lit(1)).alias("total"))
    return per.withColumn("pct_active", 100.0 * F.col("active") / F.col("total"))


def gap_patch(rows: DataFrame, small: float = 3.0) -> DataFrame:
    """rows with the velocity mended by the gap since the snapshot before, and flags: is_collection_gap (`small` hours or more: the velocity is the delta over
    the gap), velocity_interpolated, is_fuzzing (the same count shown twice). In a small gap only a velocity of 0 of a post over 20 upvotes is mended."""
    gap, delta, v = F.col("hours_since_previous"), F.col("upvote_delta"), F.coalesce("upvote_velocity", F.lit(0.0))
    known, wide = F.coalesce(gap > 0, F.lit(False)), F.coalesce(gap >= small, F.lit(False))
    still = known & ~wide & (v == 0) & F.coalesce(F.col("upvotes") > 20, F.lit(False))
    mend = (still & F.coalesce(delta > 0, F.lit(False))) | (known & wide & delta.isNotNull())
    flag = lambda c: c.cast("int")
    return rows.withColumn("is_collection_gap", flag(known & wide)).withColumn("velocity_interpolated", flag(mend)).withColumn("is_fuzzing", flag(still & F.coalesce(delta == 0, F.lit(False)))).withColumn("patched_velocity", F.when(mend, F.round(delta / gap, 4)).otherwise(F.col("upvote_velocity")))


def rolling_trend(series: DataFrame, key: str, order: str, value: str, length: int = 5) -> DataFrame:
    """Least-squares slope and mean of the last `length` values on a dense index, nulls left out."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(length - 1), 0)
    seq = F.filter(F.collect_list(value).over(w), lambda x: x.isNotNull())
    n = F.size("_v")
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    sy = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    sxy = F.aggregate(F.transform("_v", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return series.withColumn("_v", seq).withColumn("slope", F.when(n >= 2, (n * sxy - sx * sy) / (n * sxx - sx * sx))).withColumn("mean", F.when(n > 0, sy / n)).drop("_v")


def ranked(df: DataFrame, by: list[Column], group: str | None, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over((Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*by)))


def overall_rank(df: DataFrame, by: str, name: str, tie: str) -> DataFrame:
    """Rank over all rows, descending by a number (null as 0), without one window over everything: rows are sorted by ranges, ranked in their range, and offset by the rows of the ranges before (one count per range)."""
    key = F.coalesce(F.col(by).cast("double"), F.lit(0.0))
    spread = df.withColumn("_k", -key).repartitionByRange("_k", tie).withColumn("_p", F.spark_partition_id())
    from ..sources.tables import materialize

    spread = materialize(spread)
    sizes = spread.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    inner = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_k", tie)))
    return inner.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_before")).drop("_k", "_p", "_r", "_before")
