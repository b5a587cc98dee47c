"""What is happening now against what is usual: heat, live pulse, deviation timeline, time to death."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import index_quantile
from .markov import STATES


def deviation_kind(surge: Column, active: Column, dead: Column, threshold: float = 1.4) -> Column:
    """(kind, magnitude) of the ratios of surge, active and dead rates to their baselines; the first rule that holds counts."""
    rule = lambda kind, size: F.struct(F.lit(kind).alias("kind"), size.alias("magnitude"))
    quiet = F.lit(1.0) / F.greatest(active, F.lit(0.01))
    return (
        F.when(surge >= threshold * 1.5, rule("SURGE SPIKE", surge))
        .when(surge >= threshold, rule("elevated activity", surge))
        .when(active <= 1 / threshold, rule("unusually quiet", quiet))
        .when(dead >= threshold * 1.5, rule("mass die-off", dead))
        .otherwise(rule("normal", F.lit(1.0)))
    )


def _counts(where: Column, suffix: str) -> list[Column]:
    state = F.col("state")
    return [F.count_if(where & cond).alias(f"{name}_{suffix}") for name, cond in (("total", F.lit(True)), ("active", state.isin("surging", "alive")), ("surge", state == "surging"), ("dead", state == "dead"))]


def _compare(df: DataFrame) -> DataFrame:
    """Rates now and before, their ratios (baselines of 0.01 at least) and the kind of deviation."""
    rate = lambda name, when: F.try_divide(F.col(f"{name}_{when}"), F.col(f"total_{when}"))
    ratio = {n: rate(n, "now") / F.greatest(rate(n, "base"), F.lit(0.01)) for n in ("surge", "active", "dead")}
    out = df.withColumn("x", deviation_kind(ratio["surge"], ratio["active"], ratio["dead"])).withColumn("active_rate", rate("active", "now"))
    for n, c in ratio.items():
        out = out.withColumn(f"{n}_ratio", c)
    return out.withColumn("kind", F.col("x.kind")).withColumn("magnitude", F.col("x.magnitude"))


def live_pulse(rows: DataFrame, at: str, by: list[str], least_base: int = 10, least_now: int = 3, most: int = 10) -> DataFrame:
    """The `most` strongest deviations of groups at the newest point of time from all points before the third newest (before the newest where there are fewer than four).

    One aggregation reads both spans; the points' edge is a single row. Ties go by the groups' names."""
    rows = rows.where(F.col("state").isin(*STATES) & F.col(at).isNotNull())
    newest = rows.select(at).distinct().orderBy(F.desc(at)).limit(4).agg(F.sort_array(F.collect_list(at)).alias("p"))
    edge = newest.select(F.element_at("p", -1).alias("_last"), F.when(F.size("p") >= 4, F.element_at("p", -3)).otherwise(F.element_at("p", -1)).alias("_cut"))
    now, base = F.col(at) == F.col("_last"), F.col(at) < F.col("_cut")
    both = rows.crossJoin(F.broadcast(edge)).where(now | base).groupBy(*by).agg(*_counts(now, "now"), *_counts(base, "base"))
    out = _compare(both.where((F.col("total_base") >= least_base) & (F.col("total_now") >= least_now)))
    return out.orderBy(F.desc("magnitude"), F.desc("active_rate"), *by).limit(most).select(*by, "total_now", "total_base", "active_rate", "surge_ratio", "active_ratio", "dead_ratio", "kind", "magnitude")


def deviation_timeline(rows: DataFrame, at: str, by: list[str], least_base: int = 10, least_now: int = 3, warm_up: int = 3, cap: float = 6.0) -> DataFrame:
    """For each point of time the strongest deviation of a group from its own history up to `warm_up` points before.

    Points before the warm-up and those without a group of `least_now` rows are "warming up", those where no group has a baseline "normal", both with magnitude 1.
    Points are numbered by one window over their distinct values (one row an hour, however many posts)."""
    rows = rows.where(F.col("state").isin(*STATES) & F.col(at).isNotNull())
    cells = rows.groupBy(at, *by).agg(*_counts(F.lit(True), "now"))
    points = rows.select(at).distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at)) - 1)
    past = Window.partitionBy(*by).orderBy("idx").rangeBetween(Window.unboundedPreceding, -warm_up)
    dated = cells.join(points, at)
    for n in ("total", "active", "surge", "dead"):
        dated = dated.withColumn(f"{n}_base", F.coalesce(F.sum(f"{n}_now").over(past), F.lit(0)))
    seen = dated.where((F.col("idx") >= warm_up) & (F.col("total_now") >= least_now))
    # the least of (-magnitude, -rate, names) is the strongest; a plain aggregate, so hours with many groups are combined before the shuffle
    strong = F.min(F.when(F.col("total_base") >= least_base, F.struct((-F.col("magnitude")).alias("m"), (-F.col("active_rate")).alias("r"), *by, "kind")))
    best = _compare(seen).groupBy(at).agg(strong.alias("b"))
    full = points.join(best.withColumn("_seen", F.lit(True)), at, "left")
    label = F.when(F.col("_seen").isNull(), "warming up").when(F.col("b").isNull(), "normal").otherwise(F.concat_ws(" | ", *[F.col(f"b.{c}").cast("string") for c in by]))
    return full.select(at, F.coalesce(F.least(-F.col("b.m"), F.lit(cap)), F.lit(1.0)).alias("max_magnitude"), label.alias("top_label"), F.coalesce("b.kind", F.lit("normal")).alias("kind"))


def live_heat(rows: DataFrame, at: str, by: list[str], least: int = 3, usual: float = 0.6) -> DataFrame:
    """Active rate at the newest point of time over the group's rate in all rows; fewer than `least` rows now: 1, "insufficient data"."""
    active = F.col("state").isin("surging", "alive").cast("double")
    now = F.col(at) == F.col("_last")
    x = rows.crossJoin(F.broadcast(rows.agg(F.max(at).alias("_last"))))
    g = x.groupBy(*by).agg(F.count_if(now).alias("n_now"), F.avg(F.when(now, active)).alias("_rate"), F.coalesce(F.avg(active), F.lit(usual)).alias("usual_rate"))
    enough = F.col("n_now") >= least
    g = g.withColumn("heat", F.when(enough & (F.col("usual_rate") > 0), F.col("_rate") / F.col("usual_rate")).otherwise(F.lit(1.0))).withColumn("current_rate", F.when(enough, F.col("_rate")).otherwise(F.lit(0.0)))
    label = F.when(~enough, "insufficient data").when(F.col("heat") >= 2.0, "VERY HOT").when(F.col("heat") >= 1.3, "hot").when(F.col("heat") >= 0.7, "normal").when(F.col("heat") >= 0.4, "cool").otherwise("cold")
    return g.select(*by, "n_now", "current_rate", "usual_rate", "heat", label.alias("label"))


def time_to_death(rows: DataFrame) -> DataFrame:
    """Hours from a snapshot to its post's last one, by state: count, median, mean and the quartiles by place; posts with two snapshots or more."""
    w = Window.partitionBy("post_id")
    left = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("hours_left", (F.max("age_minutes").over(w) - F.col("age_minutes")) / 60).where("_n >= 2").select("state", "hours_left")
    agg = left.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.median("hours_left").alias("median_hours"), F.avg("hours_left").alias("avg_hours"))
    for name, p in (("p25", 0.25), ("p75", 0.75)):
        agg = agg.join(index_quantile(left, ["state"], "hours_left", p, name), "state")
    return agg
