"""Scores and states of posts as column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers and decays of the states, their base of the die-soon score, and ages in minutes
STATE_MULTIPLIER = {"surging": 1.0, "alive": 0.9, "emerging": 0.8, "cooling": 0.45, "dying": 0.15, "dead": 0.0}
STATE_DECAY = {"surging": 0.9, "alive": 0.8, "emerging": 0.72, "cooling": 0.45, "dying": 0.2, "dead": 0.0}
DIE_SOON_BASE = {"surging": 0.08, "alive": 0.22, "emerging": 0.34, "cooling": 0.72, "dying": 0.9, "dead": 1.0}
DYING_AGE, DEAD_AGE, FRESH_AGE, FLAT_SHARE = 720.0, 2160.0, 60.0, 0.35
THRESHOLDS = [f"{s}_{m}" for s in ("alive", "surging", "dead") for m in ("upvotes", "comments")]


def zero(c) -> Column:
    """A null number counts as 0."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*values.items())])[key], F.lit(default))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where either is null or the divisor is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def activity_state() -> Column:
    """State of a post in a snapshot, from age_minutes, hours_since_previous, upvote_delta, comment_delta, upvote_velocity, comment_velocity,
    still_visible_next and the six thresholds. The order of the rules matters; null velocity counts as no motion."""
    up, com, age = zero("upvote_velocity"), zero("comment_velocity"), F.col("age_minutes")
    grows = (zero("upvote_delta") > 0) | (zero("comment_delta") > 0)
    moves = (up > F.col("dead_upvotes")) | (com > F.col("dead_comments"))
    flat = (up <= F.col("dead_upvotes") * FLAT_SHARE) & (com <= F.col("dead_comments") * FLAT_SHARE)
    fades = ~moves & (flat | ~grows)
    fresh = F.coalesce(age <= FRESH_AGE, F.lit(False))
    return (
        F.when(F.col("hours_since_previous").isNull(), F.when(fresh, "emerging").otherwise("unknown"))
        .when((com >= F.col("surging_comments")) | (up >= F.col("surging_upvotes")), "surging")
        .when((com >= F.col("alive_comments")) | (up >= F.col("alive_upvotes")) | (grows & moves), "alive")
        .when((age >= DEAD_AGE) & fades, "dead")
        .when((age >= DYING_AGE) & fades, "dying")
        .when(F.col("still_visible_next") == 1, "cooling")
        .when(fresh, "emerging")
        .otherwise("cooling")
    )


def age_bucket(minutes: Column, edges=((60, "0-1h"), (180, "1-3h"), (360, "3-6h"), (720, "6-12h"), (1440, "12-24h"), (2880, "24-48h"))) -> Column:
    """Half-open buckets of age; null is unknown."""
    out = F.when(minutes.isNull(), "unknown")
    for upper, name in edges:
        out = out.when(minutes < upper, name)
    return out.otherwise("48h+")


def gap_bucket(hours: Column, short: float = 0.75, regular: float = 1.5, wide: float = 2.5) -> Column:
    return F.when(hours.isNull(), "missing").when(hours < short, "short").when(hours <= regular, "regular").when(hours <= wide, "wide").otherwise("very_wide")


def decayed_total(delta: Column, state: Column, hours: int) -> Column:
    """Sum of a delta that shrinks by the state's decay each hour, in closed form."""
    q = lookup(STATE_DECAY, state, 0.5)
    total = F.when(F.abs(q - 1) < 1e-9, delta * hours).otherwise(delta * (1 - F.pow(q, F.lit(float(hours)))) / (1 - q))
    return F.when((delta <= 0) | (q <= 0), F.lit(0.0)).otherwise(total)


def die_soon_score(state: Column, upvotes: Column, comments: Column, attention: Column, popularity: Column, observed_hours: Column) -> Column:
    """How likely a post dies soon: state, low motion, nearness to the dead thresholds and time, less attention and popularity; 0 to 1."""
    ratio = lambda v, name, top: F.least(F.coalesce(safe_ratio(v, F.col(name)), F.lit(0.0)), F.lit(top))
    alive = (ratio(upvotes, "alive_upvotes", 4.0) + ratio(comments, "alive_comments", 4.0)) / 2
    dead = (ratio(upvotes, "dead_upvotes", 8.0) + ratio(comments, "dead_comments", 8.0)) / 2
    score = 0.42 * lookup(DIE_SOON_BASE, state, 0.35) + 0.28 * (1 - clamp(alive / 1.5)) + 0.22 * (1 - clamp(dead / 3.0)) + 0.08 * clamp(observed_hours / 6.0) - 0.12 * clamp(attention / 50.0) - 0.08 * clamp(popularity / 75.0)
    return F.when(state == "dead", F.lit(1.0)).otherwise(clamp(score))


def recommendation(state: Column, upvotes: Column, comments: Column) -> Column:
    """What to watch a post for, from its predicted growth and state."""
    over = lambda k: (upvotes >= F.col(f"{k}_upvotes")) | (comments >= F.col(f"{k}_comments"))
    return F.when(over("surging"), "surge_watch").when(over("alive"), "active_watch").when(state == "dying", "dying_watch").when(state == "cooling", "cooling_watch").when(state == "dead", "stop_watch").otherwise("low_watch")


def predicted_state(state: Column, upvotes: Column, comments: Column, die_soon: Column) -> Column:
    over = lambda k: (upvotes >= F.col(f"{k}_upvotes")) | (comments >= F.col(f"{k}_comments"))
    return F.when(over("surging"), "surging").when(over("alive"), "alive").when((die_soon >= 0.9) | (state == "dead"), "dead").when((die_soon >= 0.65) | (state == "dying"), "dying").otherwise("cooling")


def slope_score(slope: Column, reference: Column) -> Column:
    """A slope as 0 to 25, in parts of a reference; 12.5 where unknown."""
    return F.when(slope.isNull() | F.coalesce(reference <= 0, F.lit(True)), F.lit(12.5)).otherwise((clamp(slope / reference * 5, -1.0, 1.0) + 1) / 2 * 25)


def health_label(score: Column) -> Column:
    return F.when(score >= 75, "healthy").when(score >= 50, "declining").when(score >= 25, "critical").otherwise("dead")


def topic_day_state(today: Column, yesterday: Column) -> Column:
    """State of a topic on a day, from its posts on the day and the day before (absent: 0)."""
    before = F.coalesce(yesterday, F.lit(0))
    r = today / F.nullif(before, F.lit(0))
    return F.when(today < 2, "dead").when((before == 0) | (r > 1.5), "surging").when(r > 1.05, "growing").when(r > 0.8, "stable").when(r > 0.5, "cooling").otherwise("dying")
