"""Flows of states: chains whose matrix changes with age, from starts that heat, scenarios and observations move; fixed-matrix trajectories of all posts.

A chain is a small array of numbers in one row (7 ages x 3 velocities x 5 states x 5 states), and a distribution is one of five. So all
(topic, community) pairs are rolled out at once by a fold over arrays, without a join for each step.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markov import STATES

AGES = ("under_30m", "30m_to_1h", "1h_to_3h", "3h_to_6h", "6h_to_12h", "12h_to_24h", "over_24h")
VELOCITIES = ("low", "med", "high")
#: scenarios' multipliers, the start of topics without history, what an observed state starts with and how performance shifts it
SCENARIOS = {"normal": 1.0, "moderate": 2.0, "major": 4.0, "breaking": 7.0, "quiet": 0.4}
UNKNOWN_START = {"surging": 0.15, "alive": 0.60, "cooling": 0.15, "dying": 0.07, "dead": 0.03}
ANCHORED, OTHERWISE = 0.80, 0.02
ABOVE = {"surging": 0.15, "alive": 0.05, "dying": -0.01, "dead": -0.01}
BELOW = {"dying": 0.10, "dead": 0.05, "surging": -0.01, "alive": -0.01}
#: State transitions a step, growth by community and early upvotes (up to a bound), hours alive and to the peak
TRANSITIONS = {
    "surging": {"surging": 0.75, "alive": 0.13, "cooling": 0.08, "dying": 0.02, "dead": 0.01},
    "alive": {"surging": 0.03, "alive": 0.63, "cooling": 0.11, "dying": 0.11, "dead": 0.13},
    "cooling": {"surging": 0.12, "alive": 0.39, "cooling": 0.34, "dying": 0.06, "dead": 0.07},
    "dying": {"surging": 0.02, "alive": 0.44, "cooling": 0.08, "dying": 0.44, "dead": 0.02},
    "dead": {"surging": 0.01, "alive": 0.42, "cooling": 0.09, "dying": 0.00, "dead": 0.48},
}
GROWTH = {
    "Games": {5: 7.2, 30: 4.7, 100: 1.1, 500: 1.0},
    "news": {5: 111.2, 30: 29.5, 100: 8.0, 500: 1.1},
    "politics": {5: 6.3, 30: 4.0, 100: 5.9, 500: 1.3},
    "technology": {5: 19.0, 30: 6.4, 100: 6.9, 500: 1.0},
    "worldnews": {5: 17.4, 30: 6.3, 100: 7.1, 500: 1.0},
}
ALIVE_HOURS = {"Games": 49, "news": 42, "politics": 11, "technology": 28, "worldnews": 22}
PEAK_HOURS = {"Games": 70, "news": 96, "politics": 13, "technology": 34, "worldnews": 25}
ELSEWHERE, ELSEWHERE_HOURS = "news", 24


def _names(values) -> Column:
    return F.array(*map(F.lit, values))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _zeros() -> Column:
    return F.array(*[F.lit(0.0)] * len(STATES))


def _counts(c: str) -> Column:
    """Numbers of rows with each state."""
    return F.array(*[F.count_if(F.col(c) == x).cast("double") for x in STATES])


def _added(column: str) -> Column:
    return F.array(*[F.sum(F.get(column, i)) for i in range(len(STATES))])


def share(v: Column) -> Column:
    """The numbers by their sum; without any, all alike."""
    return F.when(_sum(v) > 0, F.transform(v, lambda x: x / _sum(v))).otherwise(F.array(*[F.lit(1.0 / len(STATES))] * len(STATES)))


def moves(rows: DataFrame, age: Column, velocity: Column) -> DataFrame:
    """State rows with their age and velocity buckets and the same post's state in its community's next snapshot (null if it isn't there, or either state isn't one of the five)."""
    w = Window.partitionBy("community", "post_id").orderBy("hours", "snapshot_no")
    known = lambda c: F.when(c.isin(*STATES), c)
    nxt = F.when(F.lead("snapshot_no").over(w) == F.col("next_no"), F.lead("state").over(w))
    return rows.withColumns({"age_bucket": age, "velocity_bucket": velocity, "next_state": known(nxt)}).where(F.col("state").isin(*STATES))


def age_matrices(moved: DataFrame, by: list[str], velocities: tuple[str, ...] = VELOCITIES, support: int = 10) -> DataFrame:
    """For each group one array: by age, velocity and state the distribution of the next state.

    A row of the matrix with under `support` moves is taken over all velocities, one still under it from all groups, one without
    any is uniform. All levels come from one aggregation: a group has at most 105 rows of counts, all groups' sum has 35."""
    t = moved.where("next_state IS NOT NULL")
    own = t.groupBy(*by, "age_bucket", "velocity_bucket", "state").agg(_counts("next_state").alias("n"))
    key = lambda *c: F.concat_ws("|", *c)
    own = own.withColumn("n", F.struct(key("age_bucket", "velocity_bucket", "state").alias("k"), "n"))
    every = moved.select(*by).distinct().join(own.groupBy(*by).agg(F.map_from_entries(F.collect_list("n")).alias("own")), by, "left")
    whole = t.groupBy("age_bucket", "state").agg(_counts("next_state").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(key("age_bucket", "state").alias("k"), "n"))).alias("whole"))
    ages, speeds, states = _names(AGES), _names(velocities), _names(STATES)

    def look(m: str, *parts: Column) -> Column:
        return F.coalesce(F.col(m)[F.concat_ws("|", *parts)], _zeros())

    def row(age: Column, speed: Column, state: Column) -> Column:
        mine = look("own", age, speed, state)
        pooled = F.aggregate(speeds, _zeros(), lambda acc, v: F.zip_with(acc, look("own", age, v, state), lambda x, y: x + y))
        return F.when(_sum(mine) >= support, share(mine)).when(_sum(pooled) >= support, share(pooled)).otherwise(share(look("whole", age, state)))

    m = F.flatten(F.transform(ages, lambda a: F.flatten(F.transform(speeds, lambda v: F.flatten(F.transform(states, lambda s: row(a, v, s)))))))
    return every.crossJoin(F.broadcast(whole)).select(*by, m.alias("m"))  # one row of all groups' counts


def starts(moved: DataFrame, by: list[str], velocity: str = "comment_velocity", least: int = 5, least_tier: int = 3) -> DataFrame:
    """Per group the distribution of states within the first hour (`base`, a fixed one with under `least` rows) and that by the tier of comment velocity (`tier`: map of low, med, high; base with under `least_tier` rows)."""
    early = F.col("age_bucket").isin(*AGES[:2])
    tier = F.when(F.coalesce(velocity, F.lit(0.0)) >= 5, "high").when(F.coalesce(velocity, F.lit(0.0)) > 0, "med").otherwise("low")
    n = moved.groupBy(*by, tier.alias("t")).agg(F.array(*[F.count_if(early & (F.col("state") == x)).cast("double") for x in STATES]).alias("n"))
    g = n.groupBy(*by).agg(_added("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("by_tier"))
    base = F.when(_sum(F.col("n")) >= least, share(F.col("n"))).otherwise(F.array(*[F.lit(UNKNOWN_START[s]) for s in STATES]))
    g = g.withColumn("base", base)
    of = lambda t: F.when(_sum(F.coalesce(F.col("by_tier")[t], _zeros())) >= least_tier, share(F.col("by_tier")[t])).otherwise(F.col("base"))
    return g.select(*by, "base", F.create_map(*chain(*[(F.lit(t), of(t)) for t in VELOCITIES])).alias("tier"))


def shifted(v: Column, multiplier: Column) -> Column:
    """The distribution with surging and alive times the multiplier, the others divided by it (0.1 at least); 1 leaves it."""
    up = F.transform(v, lambda x, i: F.when(i < 2, x * multiplier).otherwise(x / F.greatest(multiplier, F.lit(0.1))))
    return F.when(multiplier == 1.0, v).otherwise(F.transform(up, lambda x: x / _sum(up)))


def anchored(state: Column, performance: Column) -> Column:
    """The start of a post whose state and performance (its upvotes and comments against the topic's means) were seen."""
    known = F.when(state.isin(*STATES), state).otherwise("alive")

    def number(s: str) -> Column:
        at = F.when(known == s, F.lit(ANCHORED)).otherwise(F.lit(OTHERWISE))
        return F.when(performance >= 2.0, at + ABOVE.get(s, 0.0)).when(performance <= 0.5, at + BELOW.get(s, 0.0)).otherwise(at)

    v = F.array(*map(number, STATES))
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)) / _sum(v))


def aged_path(v: Column, m: Column, speed: Column, velocities: int = len(VELOCITIES)) -> Column:
    """Distributions after each age: the start pushed through the matrix of each age, of the velocity bucket `speed` (its place). high (2) becomes med (1) behind 3 to 6 hours."""
    n = len(STATES)
    over = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda age: F.when((speed == 2) & (age > 3), F.lit(1)).otherwise(speed)

    def push(last: Column, age: Column) -> Column:
        row = (age * velocities + at(age)) * n
        return share(F.transform(over, lambda j: F.aggregate(over, F.lit(0.0), lambda acc, i: acc + F.get(last, i) * F.get(m, (row + i) * n + j))))

    return F.slice(F.aggregate(F.sequence(F.lit(0), F.lit(len(AGES) - 1)), F.array(v), lambda acc, age: F.concat(acc, F.array(push(F.element_at(acc, -1), age)))), 2, len(AGES))


def long_form(df: DataFrame, by: list[str], path: str) -> DataFrame:
    """A row for each age and state."""
    steps = df.select(*by, F.posexplode(path).alias("age_no", "v"))
    return steps.select(*by, F.col("age_no").alias("step"), F.get(_names(AGES), F.col("age_no")).alias("age_bucket"), F.posexplode("v").alias("k", "p")).select(*by, "step", "age_bucket", F.get(_names(STATES), F.col("k")).alias("state"), "p")


def flow_forecast(moved: DataFrame, heat: DataFrame, sentiment: DataFrame, scenarios: dict[str, float] = SCENARIOS) -> DataFrame:
    """topic, community, scenario, step, age_bucket, state, p: every pair's start, moved by its heat, each scenario and its sentiment (topic, community, multiplier; unknown: 1), rolled out over the ages."""
    by = ["topic", "community"]
    s = starts(moved, by).join(heat.select(*by, "heat"), by, "left").join(sentiment.select(*by, F.col("multiplier").alias("mood")), by, "left")
    s = s.withColumn("scenario", F.explode(_names(scenarios)))
    times = F.create_map(*[F.lit(x) for x in chain(*scenarios.items())])
    v = shifted(F.col("base"), F.coalesce("heat", F.lit(1.0)))
    s = s.withColumn("v", v).withColumn("v", shifted(F.col("v"), times[F.col("scenario")])).withColumn("v", shifted(F.col("v"), F.coalesce("mood", F.lit(1.0))))
    out = s.join(age_matrices(moved, ["community"]), "community").withColumn("path", aged_path(F.col("v"), F.col("m"), F.lit(1)))
    return long_form(out, [*by, "scenario"], "path")


def anchored_forecast(moved: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, topic, community, anchor_state, performance, outlook (the likeliest state at each age), p_active (at the last age) of posts (post_id, topic, community, state, upvotes, comment_velocity) seen once.

    Topics' means are 100 upvotes and a comment velocity of 2 where unknown. A community has at most 15 different starts (state and band of performance), so
    each is rolled out once and joined to the posts."""
    by = ["topic", "community"]
    means = moved.groupBy(*by).agg(F.coalesce(F.avg(F.coalesce("upvotes", F.lit(0.0))), F.lit(100.0)).alias("_u"), F.coalesce(F.avg(F.coalesce("comment_velocity", F.lit(0.0))), F.lit(2.0)).alias("_c"))
    part = lambda x, mean: F.when(F.coalesce(mean, F.lit(0.0)) > 0, F.coalesce(F.nullif(x, F.lit(0.0)), mean) / mean).otherwise(1.0)
    j = posts.join(means, by, "left").withColumn("performance", (part(F.col("upvotes"), F.col("_u")) + part(F.col("comment_velocity"), F.col("_c"))) / 2)
    j = j.withColumn("band", F.when(F.col("performance") >= 2.0, 2).when(F.col("performance") <= 0.5, 0).otherwise(1))
    kinds = j.select("community", "state", "band").distinct().join(age_matrices(moved, ["community"]), "community")
    typical = F.when(F.col("band") == 2, 2.0).when(F.col("band") == 0, 0.5).otherwise(1.0)
    kinds = kinds.withColumn("path", aged_path(anchored(F.col("state"), typical), F.col("m"), F.col("band")))
    likely = F.transform("path", lambda v: F.get(_names(STATES), F.array_position(v, F.array_max(v)).cast("int") - 1))
    last = F.element_at("path", -1)
    kinds = kinds.select("community", "state", "band", F.concat_ws(">", likely).alias("outlook"), (F.get(last, 0) + F.get(last, 1)).alias("p_active"))
    return j.join(kinds, ["community", "state", "band"]).select("post_id", "topic", "community", F.col("state").alias("anchor_state"), "performance", "outlook", "p_active")


def busiest_flows(moved: DataFrame, support: int = 10) -> DataFrame:
    """community, topic, step, age_bucket, state, p: the topic with most moves of each community (ties: the first by name), its early states (all, without any) rolled out by its own moves or, under `support`, those of all."""
    counts = moved.where("next_state IS NOT NULL").groupBy("community", "topic").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("community").agg(F.min_by("topic", F.struct(-F.col("n"), F.col("topic"))).alias("topic"))
    own = moved.join(top, ["community", "topic"], "left_semi")
    early = F.col("age_bucket").isin(*AGES[:2])
    n = own.groupBy("community", "topic").agg(F.array(*[F.count_if(early & (F.col("state") == x)).cast("double") for x in STATES]).alias("e"), _counts("state").alias("n"))
    n = n.withColumn("v", share(F.when(_sum(F.col("e")) > 0, F.col("e")).otherwise(F.col("n"))))
    m = age_matrices(moved.withColumn("velocity_bucket", F.lit("any")), ["community", "topic"], ("any",), support)
    out = n.join(m, ["community", "topic"]).withColumn("path", aged_path(F.col("v"), F.col("m"), F.lit(0), 1))
    return long_form(out, ["community", "topic"], "path")


def fixed_trajectories(spark, steps: int = 12, transitions: dict[str, dict[str, float]] = TRANSITIONS, least: float = 0.001) -> DataFrame:
    """start_state, step (0 to `steps`), probabilities: five rows of a start each, rolled through a fixed matrix; shares under `least` aren't carried on."""
    n = len(STATES)
    over = F.sequence(F.lit(0), F.lit(n - 1))
    m = F.array(*[F.lit(float(transitions[a][b])) for a in STATES for b in STATES])
    push = lambda v: F.transform(over, lambda j: F.aggregate(over, F.lit(0.0), lambda acc, i: acc + F.when(F.get(v, i) < least, 0.0).otherwise(F.get(v, i) * F.get(F.col("m"), i * n + j))))
    start = spark.range(n).select(F.get(_names(STATES), F.col("id").cast("int")).alias("start_state"), F.transform(over, lambda i: (i == F.col("id")).cast("double")).alias("v"), m.alias("m"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array("v"), lambda acc, _: F.concat(acc, F.array(push(F.element_at(acc, -1)))))
    return start.select("start_state", F.posexplode(path).alias("step", "v")).select("start_state", "step", *[F.get("v", i).alias(s) for i, s in enumerate(STATES)])


def growth_multiplier(community: Column, upvotes: Column) -> Column:
    """What early upvotes grow by, by the least bound that holds them (the last one holds all above)."""

    def of(table: dict[int, float]) -> Column:
        bounds = sorted(table)
        out = F.when(upvotes <= bounds[0], table[bounds[0]])
        for b in bounds[1:]:
            out = out.when(upvotes <= b, table[b])
        return out.otherwise(table[bounds[-1]])

    out = F.when(community == ELSEWHERE, of(GROWTH[ELSEWHERE]))
    for name, table in GROWTH.items():
        out = out.when(community == name, of(table))
    return out.otherwise(of(GROWTH[ELSEWHERE]))


def outcome_forecast(posts: DataFrame, sentiment: str = "sentiment", steps: int = 12, at: int = 6) -> DataFrame:
    """Start state, chance to rise and to flop, verdict, expected peak and hours of all posts (post_id, community, upvotes, sentiment).

    The five possible trajectories are rolled out once and joined to the posts. Halves are rounded to even, upvotes are cut to whole ones first."""
    from ..functions.scores import early_state
    from ..functions.states import lookup

    mid = fixed_trajectories(posts.sparkSession, steps).where(F.col("step") == at)
    mid = mid.select("start_state", F.bround(F.col("surging") + F.col("alive"), 3).alias("_pop"), F.bround(F.col("dying") + F.col("dead"), 3).alias("flop_probability"))
    up = F.floor(F.coalesce("upvotes", F.lit(0.0)))
    p = posts.withColumn("_up", up).withColumn("start_state", early_state(F.col("_up"))).join(F.broadcast(mid), "start_state")  # five rows
    s = F.col(sentiment)
    pop = F.when(s < -0.15, F.least(F.lit(0.99), F.col("_pop") * 1.1)).otherwise(F.col("_pop"))
    effect = F.when(s.isNull(), "no data").when(s < -0.15, "controversial - may boost engagement").when(s > 0.15, "positive - standard trajectory").otherwise("neutral")
    hours = lambda table: lookup({k: float(v) for k, v in table.items()}, F.col("community"), float(ELSEWHERE_HOURS))
    scaled = lambda h, up_, down: F.when(F.col("start_state") == "surging", F.bround(h * up_, 0)).when(F.col("start_state") == "dying", F.bround(h * down, 0)).otherwise(h)
    p = p.withColumn("pop_probability", pop).withColumn("growth_multiplier", growth_multiplier(F.col("community"), F.col("_up"))).withColumn("estimated_peak", F.bround(F.col("_up") * F.col("growth_multiplier"), 0))
    verdict = F.when(F.col("pop_probability") >= 0.6, "LIKELY TO POP").when(F.col("pop_probability") >= 0.4, "COIN FLIP").when(F.col("pop_probability") >= 0.2, "PROBABLY FLOPS").otherwise("DEAD ON ARRIVAL")
    return p.select(
        "post_id", "community", "start_state", "pop_probability", "flop_probability", verdict.alias("verdict"), "growth_multiplier", "estimated_peak", F.bround(F.col("estimated_peak") * 0.3, 0).alias("peak_low"), F.bround(F.col("estimated_peak") * 3, 0).alias("peak_high"),
        scaled(hours(ALIVE_HOURS), 1.5, 0.3).alias("alive_hours"), scaled(hours(PEAK_HOURS), 0.8, 0.5).alias("peak_hour"), effect.alias("sentiment_effect"),
    )
