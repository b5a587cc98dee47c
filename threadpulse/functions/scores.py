"""Engagement, popularity and attention scores, priorities and the settled state of a post, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .states import lookup

#: Weights of the logarithms in the scores, and what states, listings and ages add to attention
ENGAGEMENT_WEIGHTS = {"latest_comments": 1.2, "latest_upvotes": 1.3, "latest_replies": 1.4, "latest_commenters": 0.9, "max_upvotes_seen": 0.7, "max_replies_seen": 0.8}
POPULARITY_WEIGHTS = {"max_upvotes": 1.5, "max_comments": 1.6, "upvote_growth": 1.0, "comment_growth": 1.1, "last_upvote_velocity": 0.8, "last_comment_velocity": 1.0}
FLOW_WEIGHTS = {"last_upvote_velocity": 1.8, "last_comment_velocity": 2.0, "latest_upvotes": 0.9, "latest_replies": 1.0, "latest_commenters": 0.7}
ATTENTION_MULTIPLIER = {"surging": 1.25, "alive": 1.0, "emerging": 1.05, "cooling": 0.65, "dying": 0.35, "dead": 0.15, "unknown": 0.35}
ATTENTION_BONUS = {"surging": 1.6, "alive": 0.9, "emerging": 1.1, "cooling": 0.2, "dying": -0.7, "dead": -1.5, "unknown": -0.2}
LISTING_BONUS = {"hot": 1.7, "rising": 1.5, "new": 1.0, "top_day": 0.9, "top_week": 0.3}
PRIORITIES = ("highest", "high", "medium", "low", "very_low")


def log_sum(weights: dict[str, float]) -> Column:
    """Sum of weight x ln(1 + column) over columns of these names; null and negative numbers count as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.log1p(F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return total


def engagement_score() -> Column:
    return log_sum(ENGAGEMENT_WEIGHTS)


def popularity_score(engagement: Column) -> Column:
    return log_sum(POPULARITY_WEIGHTS) + F.coalesce(engagement, F.lit(0.0))


def attention_score(state: Column, listing: Column, age_minutes: Column, rank: Column) -> Column:
    """Flow of the moment times the state's multiplier, plus what state, listing, freshness and rank add."""
    fresh = F.when(age_minutes.isNull(), 0.0).when(age_minutes <= 60, 1.3).when(age_minutes <= 360, 0.8).when(age_minutes <= 1440, 0.2).otherwise(-0.6)
    place = F.when(rank > 0, 2.2 / F.log1p(F.greatest(F.lit(2.0), rank + 1.5))).otherwise(0.0)
    return log_sum(FLOW_WEIGHTS) * lookup(ATTENTION_MULTIPLIER, state, 0.5) + lookup(ATTENTION_BONUS, state, 0.0) + lookup(LISTING_BONUS, listing, 0.0) + fresh + place


def settled_state(state: Column, snapshots: Column, age_minutes: Column, moves: Column) -> Column:
    """A post's last state after the sight of its history: quiet states need two or three snapshots, and motion above the dead thresholds
    (`moves`) or youth take back a death."""
    return (
        F.when(state.isin("surging", "alive", "emerging"), state)
        .when((snapshots < 2) | (state.isin("cooling", "dying", "dead") & (snapshots < 3)), "unknown")
        .when(state == "dying", F.when(moves, "cooling").otherwise("dying"))
        .when(state == "dead", F.when(F.coalesce(age_minutes < 720, F.lit(False)) | moves, "dying").otherwise("dead"))
        .otherwise(state)
    )


def analysis_priority(state: Column, age_minutes: Column) -> Column:
    return F.when(state == "surging", "highest").when(state.isin("alive", "emerging"), "high").when((state == "cooling") & F.coalesce(age_minutes <= 360, F.lit(False)), "medium").when(state == "dead", "very_low").otherwise("low")


def priority_rank(priority: Column) -> Column:
    """Place of a priority from 0 on; unknown ones last."""
    return lookup({p: float(i) for i, p in enumerate(PRIORITIES)}, priority, 9.0)


def forecast_priority(upvotes: Column, comments: Column, attention: Column, popularity: Column, die_soon: Column) -> Column:
    positive_log = lambda c: F.log1p(F.greatest(c, F.lit(0.0)))
    return positive_log(upvotes) + positive_log(comments * 4.0) + attention * 0.15 + popularity * 0.03 - die_soon * 2.0


def freshness_flags(age_minutes: Column) -> dict[str, Column]:
    """0/1 flags; a null age is neither fresh nor old."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"is_fresh_30m": flag(age_minutes <= 30), "is_fresh_1h": flag(age_minutes <= 60), "is_fresh_3h": flag(age_minutes <= 180), "is_fresh_6h": flag(age_minutes <= 360), "is_old_12h": flag(age_minutes >= 720), "is_old_24h": flag(age_minutes >= 1440)}


def snapshot_age_bucket(age_minutes: Column) -> Column:
    out = F.when(age_minutes.isNull(), "unknown")
    for upper, name in ((30, "under_30m"), (60, "30m_to_1h"), (180, "1h_to_3h"), (360, "3h_to_6h"), (720, "6h_to_12h"), (1440, "12h_to_24h")):
        out = out.when(age_minutes < upper, name)
    return out.otherwise("over_24h")


def early_state(upvotes: Column) -> Column:
    """The state that a post's first upvotes suggest."""
    return F.when(upvotes >= 200, "surging").when(upvotes >= 50, "alive").when(upvotes >= 10, "cooling").otherwise("dying")


def size_bucket(peak: Column) -> Column:
    return F.when(peak <= 3, "small (1-3)").when(peak <= 7, "medium (4-7)").when(peak <= 15, "big (8-15)").otherwise("viral (16+)")


def velocity_bucket(velocity: Column, alive: Column, surging: Column) -> Column:
    """low, med or high against two thresholds, which are 4 and 60 where unknown or 0; a null velocity counts as 0."""
    known = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    v = F.coalesce(velocity, F.lit(0.0))
    return F.when(v >= known(surging, 60.0), "high").when(v >= known(alive, 4.0), "med").otherwise("low")


def topic_quality(surge: Column, gini: Column, sentiment: Column, dead: Column, alive: Column) -> tuple[Column, Column]:
    """Quality and direction of a topic from the rates of its latest day."""
    rules = [((surge > 0.3) & (gini > 0.5), "HIGH QUALITY", "RISING"), ((surge > 0.15) & (sentiment < -0.1), "CONTROVERSIAL", "VOLATILE"), (dead > 0.5, "LOW QUALITY", "FADING"), (alive > 0.5, "HEALTHY", "STABLE")]
    quality, direction = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for hit, name, way in rules[1:]:
        quality, direction = quality.when(hit, name), direction.when(hit, way)
    return quality.otherwise("MIXED"), direction.otherwise("UNCERTAIN")
