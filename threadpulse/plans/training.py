"""Queries of the training table and of models on it, on topics and on moods. Fitted models are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from ..operators import cases, labels, topics, training
from ..sources import tables
from . import fixtures as fx
from .cases import mood
from .fixtures import LINKS_SQL, PLACED_SQL, POSTS_SQL
from .labels import placed
from .now import profiles, PROFILE_SQL, sentiments
from .profiles import _TOPICS
from .registry import _CATEGORY, _FLAGS, _KEY, grid, keyword_days, query, STATES_SQL, with_words


def table(s, d):
    """Documents are the posts' contents, pages their links; conversations their comments."""
    p = fx.posts(s, d).join(fx.links(s, d), "post_id", "left")
    c = p.select("post_id", "title", "body", "link", "domain", (F.col("post_id") % 2 == 0).alias("is_video"), (F.col("post_id") % 3 == 0).alias("has_images"), ((F.col("post_id") % 10) / 10).alias("upvote_ratio"))
    return tables.materialize(training.training_table(placed(s, d), c, profiles(s, d)))


_BOTH = []
for _m in ("upvote", "comment"):
    _v = f"{_m}_velocity"
    _mean = f"avg({_v}) OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)"
    _BOTH += [
        f"lag({_v}) OVER o AS previous_{_m}_velocity, lag({_m}_delta) OVER o AS previous_{_m}_delta, {_v} - lag({_v}) OVER o AS {_m}_velocity_change, ({_v} - lag({_v}) OVER o) / nullif(hours_since_previous, 0) AS {_m}_acceleration, {_v} / nullif(lag({_v}) OVER o, 0) AS {_m}_velocity_to_previous",
        f"{_v} / nullif(max({_v}) OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {_m}_velocity_to_prior_peak, {_mean} AS recent_{_m}_velocity_mean_2, {_v} / nullif({_mean}, 0) AS {_m}_velocity_to_recent_mean_2",
        f"CASE WHEN lead(snapshot_no) OVER o = next_no THEN lead({_m}s) OVER o END - {_m}s AS next_{_m}_delta",
    ]
_gap = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} < 0.75 THEN 'short' WHEN {c} <= 1.5 THEN 'regular' WHEN {c} <= 2.5 THEN 'wide' ELSE 'very_wide' END"
_age = "CASE WHEN age_minutes < 30 THEN 'under_30m' WHEN age_minutes < 60 THEN '30m_to_1h' WHEN age_minutes < 180 THEN '1h_to_3h' WHEN age_minutes < 360 THEN '3h_to_6h' WHEN age_minutes < 720 THEN '6h_to_12h' WHEN age_minutes < 1440 THEN '12h_to_24h' ELSE 'over_24h' END"
_has = lambda words: "regexp_matches(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '" + "|".join(w.replace("-", "\\-") for w in words) + "')"
_words = lambda c: f"len(regexp_extract_all({c}, '[^ \\t\\n\\r\\f]+'))"
_PRIORITY = "CASE WHEN state = 'surging' THEN 'highest' WHEN state IN ('alive', 'emerging') THEN 'high' WHEN state = 'cooling' AND age_minutes <= 360 THEN 'medium' WHEN state = 'dead' THEN 'very_low' ELSE 'low' END"
_known = lambda *s: f"CASE WHEN next_state IS NOT NULL THEN CAST(next_state IN ({', '.join(repr(x) for x in (*s, ''))}) AS INT) END"
_FLOATS = {*training.NUMBERS} - {"title_chars", "body_chars", "title_words", "body_words", "rank", "previous_rank", "rank_change", "abs_rank_change", "hour_utc", "position", "irregular_gaps", "large_gaps", "night_snapshots", "day_snapshots", "same_title_24h", "same_story_24h", "listing_run_length", *(f"sample_{c}" for c in ("n_comments", "n_top_level", "n_replies", "n_commenters", "max_upvotes"))}
_ALL = ["post_id", "snapshot_no", *training.NUMBERS, *training.FLAGS, *training.LABELS, "next_upvote_delta", "next_comment_delta", *training.TARGETS, "broad_label", "strict_label", "regular_label"]
_FLOATS |= {"next_upvote_delta", "next_comment_delta"}
_WHOLE = {*training.NUMBERS} - _FLOATS
_shown = lambda c: f"round({c}, 6) + 0.0 AS {c}" if c in _FLOATS else f"CAST({c} AS BIGINT) AS {c}" if c in _WHOLE else c
_repeat = lambda c: f"CASE WHEN coalesce(x.{c}, '') = '' THEN 0 ELSE (SELECT count(*) FROM fk_{c} f WHERE f.community = x.community AND f.k = x.{c} AND f.post_id <> x.post_id AND f.t0 < x.at_s AND f.t0 >= x.at_s - 86400) END"
TRAINING_SQL = (
    f"""{STATES_SQL}, {PLACED_SQL}, {POSTS_SQL}, {LINKS_SQL}, {PROFILE_SQL},
tsc AS (SELECT p.post_id, topic, len(list_filter(tk.words, lambda w: contains(lower(trim(concat_ws(' ', coalesce(p.title, ''), coalesce(p.body, '')))), w))) AS n FROM posts p CROSS JOIN {_TOPICS}), tb0 AS (SELECT post_id, first(topic ORDER BY n DESC, topic) AS topic, max(n) AS n FROM tsc GROUP BY 1),
ct AS (SELECT p.post_id, length(coalesce(title, '')) AS title_chars, length(coalesce(body, '')) AS body_chars, {_words("coalesce(title, '')")} AS title_words, {_words("coalesce(body, '')")} AS body_words, length(regexp_replace(title, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')), 0) AS uppercase_ratio, p.post_id % 10 / 10 AS upvote_ratio,
  CAST(p.post_id % 2 = 0 AS INT) AS is_video, CAST(p.post_id % 3 = 0 AS INT) AS has_images, {', '.join(f'CAST(coalesce({v}, FALSE) AS INT) AS title_{k}' for k, v in _FLAGS.items())}, {', '.join(f'CAST({_has(w)} AS INT) AS content_has_{k}_word' for k, w in text.CONTENT_FLAGS.items())}, {_CATEGORY} AS link_category,
  CASE WHEN trim(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))) = '' THEN 'unknown' WHEN tb0.n = 0 THEN 'general' ELSE tb0.topic END AS topic, {_KEY} AS title_key, CASE WHEN coalesce(link, '') <> '' THEN 'external_link:' || lower(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1)) || rtrim(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') WHEN {_KEY} <> '' THEN 'title:' || {_KEY} ELSE 'post_id:' || CAST(p.post_id AS VARCHAR) END AS story_key
  FROM posts p LEFT JOIN links l ON l.post_id = p.post_id JOIN tb0 ON tb0.post_id = p.post_id),
t1 AS (SELECT *, row_number() OVER o AS position, CASE WHEN row_number() OVER o > 1 THEN nullif(hours_since_previous, 0) END AS gap, lag(rank) OVER o AS previous_rank, coalesce(lag(listing) OVER o, '') AS previous_listing, hours - min(hours) OVER p AS hours_since_first, CAST(hours AS INT) % 24 AS hour_utc, {', '.join(_BOTH)},
  CASE WHEN lead(snapshot_no) OVER o = next_no THEN lead(state) OVER o END AS next_state, CASE WHEN lag(listing) OVER o = listing THEN 0 ELSE 1 END AS turn FROM pl WINDOW p AS (PARTITION BY community, post_id), o AS (PARTITION BY community, post_id ORDER BY hours, snapshot_no)),
t2 AS (SELECT *, sum(turn) OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no ROWS UNBOUNDED PRECEDING) AS run, median(gap) OVER p AS expected_gap, max(gap) OVER p AS max_gap, count(CASE WHEN gap < 0.75 OR gap > 1.5 THEN 1 END) OVER p AS irregular_gaps, count(CASE WHEN gap > 2.5 THEN 1 END) OVER p AS large_gaps, count(gap) OVER p AS gaps,
  sum(CASE WHEN hour_utc < 6 THEN 1 ELSE 0 END) OVER p AS night_snapshots, count(*) OVER p AS n FROM t1 WINDOW p AS (PARTITION BY community, post_id)),
t3 AS (SELECT *, count(*) OVER r AS listing_run_length, sum(CASE WHEN turn = 0 THEN coalesce(hours_since_previous, 0) ELSE 0 END) OVER r AS hours_in_listing, CAST(hours * 3600 AS BIGINT) AS at_s FROM t2 WINDOW r AS (PARTITION BY community, post_id, run ORDER BY hours, snapshot_no ROWS UNBOUNDED PRECEDING)),
x AS (SELECT t3.*, ct.* EXCLUDE (post_id) FROM t3 LEFT JOIN ct ON ct.post_id = t3.post_id),"""
    + ", ".join(f"fk_{c} AS (SELECT community, {c} AS k, post_id, min(at_s) AS t0 FROM x GROUP BY 1, 2, 3)" for c in ("title_key", "story_key"))
    + f""", x2 AS (SELECT x.*, {_repeat('title_key')} AS same_title_24h, {_repeat('story_key')} AS same_story_24h FROM x),
x3 AS (SELECT x2.*, CAST(pf.post_id IS NOT NULL AS INT) AS has_sample, coalesce(pf.op_replied, 0) AS op_replied, pf.n_comments / nullif(x2.comments, 0) AS sample_coverage, {', '.join(f'pf.{c} AS sample_{c}' for c in training.SAMPLE)} FROM x2 LEFT JOIN pf ON pf.post_id = x2.post_id AND pf.snapshot_no = x2.snapshot_no),
tt AS (SELECT *, age_minutes / 60 AS age_hours, previous_rank - rank AS rank_change, abs(previous_rank - rank) AS abs_rank_change, hours_since_previous / nullif(expected_gap, 0) AS previous_gap_to_expected, hours_to_next / nullif(expected_gap, 0) AS next_gap_to_expected, hours_since_previous / nullif(hours_to_next, 0) AS previous_to_next_gap,
  (gaps - irregular_gaps) / nullif(gaps, 0) AS regular_gap_share, n - night_snapshots AS day_snapshots, night_snapshots / n AS night_share, CAST(age_minutes <= 60 AS INT) AS is_fresh_1h, CAST(age_minutes <= 360 AS INT) AS is_fresh_6h, CAST(age_minutes >= 1440 AS INT) AS is_old_24h, CAST(hour_utc < 6 AS INT) AS is_night, CAST(position > 1 AND previous_listing <> listing AS INT) AS listing_changed,
  CAST(coalesce(previous_rank > rank, FALSE) AS INT) AS rank_improved, CAST(coalesce(previous_rank < rank, FALSE) AS INT) AS rank_worsened, CAST(coalesce(previous_rank = rank, FALSE) AS INT) AS rank_unchanged, CAST(same_title_24h > 0 AS INT) AS same_title_seen, CAST(same_story_24h > 0 AS INT) AS same_story_seen,
  {_gap('hours_since_previous')} AS previous_gap, {_gap('hours_to_next')} AS next_gap, CASE WHEN position = 1 THEN '__start__' ELSE coalesce(nullif(previous_listing, ''), '__none__') END || '->' || listing AS listing_transition, {_PRIORITY} AS priority, {_age} AS age_bucket,
  {_known('surging', 'alive', 'emerging')} AS alive_next, {_known('surging')} AS surging_next, {_known('cooling', 'dead')} AS cooling_or_dead_next, CASE WHEN next_upvote_delta IS NOT NULL THEN CAST(next_upvote_delta >= coalesce(alive_upvotes, 0) AS INT) END AS high_upvote_growth_next, CASE WHEN next_comment_delta IS NOT NULL THEN CAST(next_comment_delta >= coalesce(alive_comments, 0) AS INT) END AS high_comment_growth_next,
  CAST(coalesce(next_state IS NOT NULL AND hours_to_next BETWEEN 0.5 AND 2.5, FALSE) AS INT) AS broad_label, CAST(coalesce(next_state IS NOT NULL AND hours_to_next BETWEEN 0.75 AND 1.5, FALSE) AS INT) AS strict_label, CAST(coalesce(next_state IS NOT NULL AND hours_to_next BETWEEN 0.75 AND 1.5 AND (hours_since_previous IS NULL OR hours_since_previous BETWEEN 0.75 AND 1.5), FALSE) AS INT) AS regular_label FROM x3),
tz AS (SELECT *, CAST(previous_gap = 'regular' AS INT) AS previous_gap_regular, CAST(next_gap = 'regular' AS INT) AS next_gap_regular, CAST(previous_gap = 'very_wide' AS INT) AS previous_gap_large, CAST(next_gap = 'very_wide' AS INT) AS next_gap_large FROM tt)"""
)


def shown(df):
    return df.select([(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) if c in _FLOATS else F.col(c).cast("long").alias(c) if c in _WHOLE else F.col(c) for c in _ALL])


query("training_table", f"WITH {TRAINING_SQL} SELECT {', '.join(map(_shown, _ALL))} FROM tz")(lambda s, d: shown(table(s, d)))


def halves(s, d):
    """Snapshots before the 16th day's and from it on."""
    return training.temporal(table(s, d), "snapshot_no", 64)


query("next_state_report")(lambda s, d: training.target_report(*halves(s, d)))
query("next_growth_report")(lambda s, d: training.growth_report(*halves(s, d)))


def _known_days(df):
    return training.temporal(tables.materialize(df), "day_no", 8)


NUMBERS = ["n_posts", "yesterday", "before", "total_upvotes", "best_upvotes", "n_communities", "alive_rate", "dead_rate"]


def topic_base(days):
    """Topic days with their state, the day before and the days' measures."""
    w = Window.partitionBy("topic").orderBy("day_no")
    return tables.materialize(topics.topic_states(days).join(days.select("day_no", "topic", "total_upvotes", "best_upvotes", "n_communities", "alive_rate", "dead_rate"), ["day_no", "topic"]).withColumn("before", F.coalesce(F.lag("n_posts").over(w), F.lit(0))))


def growing(days, base, y):
    """Topic days of few posts, as (train, test, label, features) with label y of the peak to come."""
    later = topics.future_peak(days, 1, 3, 3).select("day_no", "topic", "future_peak")
    return (*_known_days(base.join(later, ["day_no", "topic"]).select("day_no", *NUMBERS, y.cast("int").alias("y"))), "y", NUMBERS)


def emergence(days, base):
    return growing(days, base, F.col("future_peak") >= 3)


def tasks(s, d):
    """The topic tables as (train, test, label, features), parted by day 8; those without a day by their topics' hashes."""
    days = tables.materialize(keyword_days(s, d))
    words = with_words(s, d)
    out = {}
    base, numbers = topic_base(days), NUMBERS
    y = lambda c: c.cast("int").alias("y")
    out["emergence"] = emergence(days, base)
    out["growth"] = growing(days, base, F.col("future_peak") > F.col("n_posts"))
    spread = labels.spread_labels(labels.community_days(words, "words"), "s1").select("day_no", "topic", "spreads", "reaches_target")
    sp = base.join(spread, ["day_no", "topic"])
    out["spread"] = (*_known_days(sp.select("day_no", *numbers, y(F.col("spreads")))), "y", numbers)
    out["reaches_target"] = (*_known_days(sp.select("day_no", *numbers, y(F.col("reaches_target")))), "y", numbers)
    out["declines"] = (*_known_days(base.where("state IN ('surging', 'growing') AND next_state IS NOT NULL").select("day_no", *numbers, y(F.col("next_state").isin("cooling", "dying", "dead")))), "y", numbers)
    out["dies_tomorrow"] = (*_known_days(labels.dies_tomorrow(days).select("day_idx", "topic", y(F.col("dies"))).join(base, ["day_idx", "topic"]).select("day_no", *numbers, "y")), "y", numbers)
    by_topic = lambda df, features: (df.where(F.pmod(F.xxhash64("topic"), F.lit(10)) < 7), df.where(F.pmod(F.xxhash64("topic"), F.lit(10)) >= 7), "y", features)
    peaks = tables.materialize(labels.peak_profiles(days))
    early = ["first_posts", "first_upvotes", "post_growth", "upvote_growth"]
    out["virality_size"] = by_topic(peaks.withColumn("y", (F.col("peak_posts") > 7).cast("int")), early)
    out["peaks_by_second"] = by_topic(peaks.withColumn("y", F.col("peaks_by_second").cast("int")), early[:2])
    out["quick_death"] = by_topic(peaks.withColumn("y", (F.col("days_to_quiet") <= 2).cast("int")), [*early, "peak_posts", "days_to_peak"])
    rev = tables.materialize(labels.reviver_profiles(grid(s, d)))
    out["revival"] = by_topic(rev.withColumn("y", F.col("is_reviver").cast("int")), ["peak", "active_days", "posts", "consistency", "volatility"])
    return out


query("task_report")(lambda s, d: training.task_report(tasks(s, d)))


def settings(s, d):
    days = tables.materialize(keyword_days(s, d))
    train, test, label, features = emergence(days, topic_base(days))
    return training.settings_report(train, test, label, features, training.grid())


query("settings_report")(settings)
query("hours_to_death_report")(lambda s, d: training.folded(tables.materialize(training.midpoint_rows(placed(s, d))), "remaining_hours", training.MIDPOINT, "post_id"))

_MOOD_FEATURES = ["sentiment_mean", "sentiment_weighted", "positive_share", "negative_share", "sentiment_variance", "comment_count", "avg_body_len"]
_PATH_FEATURES = ["first_sentiment", "mid_sentiment", "last_sentiment", "sentiment_change", "sentiment_slope", "volatility", "variance_change", "neg_share_change", "first_count", "last_count"]


def mood_tasks(s, d):
    """Mood from the comments' sentiment, activity from its path over snapshots, and from how the discussion is spread; a post is tested where 3 divides it."""
    from ..operators import discussion, groups

    m = mood(s, d)
    alive = m.select("post_id", F.col("state").isin("surging", "alive").cast("int").alias("y"))
    path = discussion.sentiment_trajectory(sentiments(s, d), "snapshot_no").join(alive, "post_id")
    profile = groups.engagement_profile(fx.comments(s, d)).join(alive, "post_id")
    part = lambda df, features: (df.where("post_id % 3 <> 0"), df.where("post_id % 3 = 0"), "y", features)
    return {
        "mood": part(tables.materialize(cases.comment_feature_rows(m)), _MOOD_FEATURES),
        "trajectory": part(tables.materialize(path), _PATH_FEATURES),
        "engagement": part(tables.materialize(profile), ["n_comments", "gini", "top_share", "top3_mean", "lower_half_mean", "reply_share"]),
    }


query("mood_report")(lambda s, d: training.task_report(mood_tasks(s, d), ("tree", "forest")))
