"""Flows against loops over dictionaries, and hand-worked numbers of starts, scenarios and fixed trajectories."""

import random

import pytest
from pyspark.sql import functions as F

from threadpulse.operators import flows
from threadpulse.operators.markov import STATES


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def array(v):
    return F.array(*map(F.lit, map(float, v)))


def test_scenario(spark):
    v = [0.15, 0.60, 0.15, 0.07, 0.03]
    assert value(spark, flows.shifted(array(v), F.lit(1.0))) == v
    got = value(spark, flows.shifted(array(v), F.lit(4.0)))  # 0.6 2.4 0.0375 0.0175 0.0075, sum 3.0625
    assert got == pytest.approx([0.6 / 3.0625, 2.4 / 3.0625, 0.0375 / 3.0625, 0.0175 / 3.0625, 0.0075 / 3.0625])
    quiet = value(spark, flows.shifted(array(v), F.lit(0.05)))  # below 0.1 the divisor stays 0.1
    assert quiet == pytest.approx([x / 2.5375 for x in (0.0075, 0.03, 1.5, 0.7, 0.3)])


def test_anchor(spark):
    assert value(spark, flows.anchored(F.lit("alive"), F.lit(1.0))) == pytest.approx([x / 0.88 for x in (0.02, 0.8, 0.02, 0.02, 0.02)])
    assert value(spark, flows.anchored(F.lit("alive"), F.lit(2.0))) == pytest.approx([x / 1.06 for x in (0.17, 0.85, 0.02, 0.01, 0.01)])
    assert value(spark, flows.anchored(F.lit("emerging"), F.lit(0.5))) == pytest.approx([x / 1.01 for x in (0.01, 0.79, 0.02, 0.12, 0.07)])


def rows(n=4000):
    rng = random.Random(4)
    out = []
    for _ in range(n):
        c, t = rng.choice("ab"), rng.choice(["x", "y"])
        out.append((c, t, rng.choice(flows.AGES[:6]), rng.choices(flows.VELOCITIES, [6, 3, 0.2])[0], rng.choices(STATES, [1, 5, 4, 0.1, 1])[0], rng.choice([*STATES, None]), rng.choice([None, 0.0, 2.0, 7.0]), rng.random() * 100))
    return out + [("thin", "x", "under_30m", "low", "alive", "dead", None, 3.0)]


SCHEMA = "community string, topic string, age_bucket string, velocity_bucket string, state string, next_state string, comment_velocity double, upvotes double"


def normal(v):
    return [x / sum(v) for x in v] if sum(v) else [0.2] * 5


def plain_row(data, community, age, speed, state):
    count = lambda f: [sum(1 for r in data if r[5] == s and r[2] == age and r[4] == state and f(r)) for s in STATES]
    for f in (lambda r: r[0] == community and r[3] == speed, lambda r: r[0] == community):
        if sum(count(f)) >= 10:
            return normal(count(f))
    return normal(count(lambda r: True))


def plain_chain(data, community, dist, speed):
    out = []
    for age in flows.AGES:
        new = [0.0] * 5
        for k, s in enumerate(STATES):
            new = [a + dist[k] * b for a, b in zip(new, plain_row(data, community, age, speed, s))]
        dist = normal(new)
        out.append(dist)
        if age in ("3h_to_6h", "6h_to_12h") and speed == "high":
            speed = "med"
    return out


def test_matrix_and_path(spark):
    data = rows()
    m = flows.age_matrices(spark.createDataFrame(data, SCHEMA), ["community"])
    got = {r.community: r for r in m.select("community", "m", *[flows.aged_path(array([0.1, 0.5, 0.2, 0.1, 0.1]), F.col("m"), F.lit(k)).alias(f"p{k}") for k in range(3)]).collect()}
    assert set(got) == {"a", "b", "thin"} and len(got["a"].m) == 525
    for c in got:
        for k, speed in enumerate(flows.VELOCITIES):
            for x, y in zip(got[c][f"p{k}"], plain_chain(data, c, [0.1, 0.5, 0.2, 0.1, 0.1], speed)):
                assert x == pytest.approx(y)


def test_starts(spark):
    got = {(r.topic, r.community): r for r in flows.starts(spark.createDataFrame(rows(), SCHEMA), ["topic", "community"]).collect()}
    thin = got["x", "thin"]
    assert thin.base == list(flows.UNKNOWN_START.values()) and thin.tier["high"] == thin.base
    early = [r for r in rows() if r[:2] == ("a", "x") and r[2] in flows.AGES[:2]]
    assert got["x", "a"].base == pytest.approx(normal([sum(r[4] == s for r in early) for s in STATES]))
    fast = [r for r in early if (r[6] or 0) >= 5]
    assert got["x", "a"].tier["high"] == pytest.approx(normal([sum(r[4] == s for r in fast) for s in STATES]))


def test_fixed_trajectories(spark):
    got = {(r.start_state, r.step): [r[s] for s in STATES] for r in flows.fixed_trajectories(spark).collect()}
    assert len(got) == 65 and got["dead", 1] == pytest.approx([0.01, 0.42, 0.09, 0.0, 0.48])
    # a share of 0 (dying) isn't carried on: alive after two steps
    assert got["dead", 2][1] == pytest.approx(0.01 * 0.13 + 0.42 * 0.63 + 0.09 * 0.39 + 0.48 * 0.42)


def test_outcomes(spark):
    p = spark.createDataFrame([(1, "politics", 4.9, -0.2), (2, "politics", 31.0, 0.2), (3, "nowhere", 501.0, None), (4, "Games", None, 0.0)], "post_id long, community string, upvotes double, sentiment double")
    got = {r.post_id: r for r in flows.outcome_forecast(p).collect()}
    assert (got[1].start_state, got[1].growth_multiplier, got[1].estimated_peak, got[1].alive_hours, got[1].peak_hour) == ("dying", 6.3, 25.0, 3.0, 6.0)
    assert (got[2].start_state, got[2].growth_multiplier, got[2].estimated_peak, got[2].peak_low, got[2].peak_high, got[2].alive_hours) == ("cooling", 5.9, 183.0, 55.0, 549.0, 11.0)
    assert (got[3].start_state, got[3].growth_multiplier, got[3].alive_hours, got[3].peak_hour, got[3].sentiment_effect) == ("surging", 1.1, 36.0, 19.0, "no data")
    assert got[1].sentiment_effect.startswith("controversial") and got[4].sentiment_effect == "neutral"
    assert got[1].pop_probability == pytest.approx(min(0.99, round(got[1].pop_probability / 1.1, 3) * 1.1))
