"""Queries of what is going on now, of discussions, cross-posts and selections; registered by the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import discussion, groups, pulse, selection
from ..sources import tables
from . import fixtures as fx
from .fixtures import POSTS_SQL
from .registry import SIMILAR_SQL, STATES_SQL, _r, query, rounded, states

_FIVE = "('surging', 'alive', 'cooling', 'dying', 'dead')"


def topic_states(s, d):
    """States of post snapshots under a topic (post mod 2) and the day of the snapshot."""
    return states(s, d).select(F.floor(F.col("snapshot_no") / 4).cast("int").alias("day"), F.concat(F.lit("t"), (F.col("post_id") % 2).cast("string")).alias("topic"), "community", "state")


TOPIC_SQL = STATES_SQL + f""", tsa AS (SELECT CAST(floor(snapshot_no / 4) AS INT) AS day, 't' || CAST(post_id % 2 AS VARCHAR) AS topic, community, state FROM st), ts AS (SELECT * FROM tsa WHERE state IN {_FIVE})"""
_CNT = lambda cond, suffix: ", ".join(f"count(CASE WHEN {cond} AND {c} THEN 1 END) AS {n}_{suffix}" for n, c in (("total", "TRUE"), ("active", "state IN ('surging', 'alive')"), ("surge", "state = 'surging'"), ("dead", "state = 'dead'")))
_RATIOS = ", ".join(f"({n}_now / total_now) / greatest({n}_base / nullif(total_base, 0), 0.01::DOUBLE) AS {n}_ratio" for n in ("surge", "active", "dead")) + ", active_now / total_now AS active_rate"
_KIND = "CASE WHEN surge_ratio >= 1.4::DOUBLE * 1.5 THEN 'SURGE SPIKE' WHEN surge_ratio >= 1.4::DOUBLE THEN 'elevated activity' WHEN active_ratio <= 1 / 1.4::DOUBLE THEN 'unusually quiet' WHEN dead_ratio >= 1.4::DOUBLE * 1.5 THEN 'mass die-off' ELSE 'normal' END AS kind"
_SIZE = "CASE WHEN surge_ratio >= 1.4::DOUBLE THEN surge_ratio WHEN active_ratio <= 1 / 1.4::DOUBLE THEN 1 / greatest(active_ratio, 0.01::DOUBLE) WHEN dead_ratio >= 1.4::DOUBLE * 1.5 THEN dead_ratio ELSE 1.0::DOUBLE END AS magnitude"

query(
    "live_pulse",
    f"""WITH {TOPIC_SQL}, h AS (SELECT DISTINCT day FROM ts ORDER BY day DESC LIMIT 4), e AS (SELECT max(day) AS l, CASE WHEN count(*) >= 4 THEN list_sort(list(day))[2] ELSE max(day) END AS c FROM h),
b AS (SELECT topic, community, {_CNT("day = l", "now")}, {_CNT("day < c", "base")} FROM ts, e GROUP BY 1, 2), r AS (SELECT *, {_RATIOS} FROM b WHERE total_now >= 3 AND total_base >= 10), k AS (SELECT *, {_KIND}, {_SIZE} FROM r)
SELECT topic, community, total_now, total_base, kind, {_r("active_rate", "surge_ratio", "active_ratio", "dead_ratio", "magnitude")} FROM (SELECT * FROM k ORDER BY magnitude DESC, active_rate DESC, topic, community LIMIT 10)""",
)(lambda s, d: rounded(pulse.live_pulse(tables.materialize(topic_states(s, d)), "day", ["topic", "community"])))

query(
    "deviation_timeline",
    f"""WITH {TOPIC_SQL}, c AS (SELECT day, topic, community, {_CNT("TRUE", "now")} FROM ts GROUP BY 1, 2, 3), h AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM ts)), x AS (SELECT c.*, h.i FROM c JOIN h ON h.day = c.day),
b AS (SELECT *, {", ".join(f"coalesce(sum({n}_now) OVER w, 0) AS {n}_base" for n in ("total", "active", "surge", "dead"))} FROM x WINDOW w AS (PARTITION BY topic, community ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)),
r AS (SELECT *, {_RATIOS} FROM b WHERE total_now >= 3 AND i >= 3), k AS (SELECT *, {_KIND}, {_SIZE} FROM r), best AS (SELECT * FROM k WHERE total_base >= 10 QUALIFY row_number() OVER (PARTITION BY day ORDER BY magnitude DESC, active_rate DESC, topic, community) = 1)
SELECT h.day, round(coalesce(least(best.magnitude, 6.0), 1.0), 6) AS max_magnitude, coalesce(best.kind, 'normal') AS kind, CASE WHEN best.day IS NOT NULL THEN best.topic || ' | ' || CAST(best.community AS VARCHAR) WHEN h.day IN (SELECT day FROM k) THEN 'normal' ELSE 'warming up' END AS top_label FROM h LEFT JOIN best ON best.day = h.day""",
)(lambda s, d: rounded(pulse.deviation_timeline(tables.materialize(topic_states(s, d)), "day", ["topic", "community"])))

query(
    "live_heat",
    f"""WITH {TOPIC_SQL}, g AS (SELECT topic, community, count(CASE WHEN day = m THEN 1 END) AS n_now, avg(CASE WHEN day = m THEN CAST(state IN ('surging', 'alive') AS INT) END) AS rate, avg(CAST(state IN ('surging', 'alive') AS INT)) AS usual_rate FROM tsa, (SELECT max(day) AS m FROM tsa) GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN n_now >= 3 AND usual_rate > 0 THEN rate / usual_rate ELSE 1.0::DOUBLE END AS heat, CASE WHEN n_now >= 3 THEN rate ELSE 0.0::DOUBLE END AS current_rate FROM g)
SELECT topic, community, n_now, {_r("current_rate", "usual_rate", "heat")}, CASE WHEN n_now < 3 THEN 'insufficient data' WHEN heat >= 2 THEN 'VERY HOT' WHEN heat >= 1.3::DOUBLE THEN 'hot' WHEN heat >= 0.7::DOUBLE THEN 'normal' WHEN heat >= 0.4::DOUBLE THEN 'cool' ELSE 'cold' END AS label FROM h""",
)(lambda s, d: rounded(pulse.live_heat(tables.materialize(topic_states(s, d)), "day", ["topic", "community"])))

query(
    "time_to_death",
    f"""WITH {STATES_SQL}, l AS (SELECT state, (max(age_minutes) OVER w - age_minutes) / 60 AS h, count(*) OVER w AS c FROM st WINDOW w AS (PARTITION BY post_id)), o AS (SELECT state, h, row_number() OVER (PARTITION BY state ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY state) AS n FROM l WHERE c >= 2)
SELECT state, count(*) AS n, round(median(h), 6) AS median_hours, round(avg(h), 6) AS avg_hours, round(max(CASE WHEN i = n // 4 THEN h END), 6) AS p25, round(max(CASE WHEN i = 3 * n // 4 THEN h END), 6) AS p75 FROM o GROUP BY 1""",
)(lambda s, d: rounded(pulse.time_to_death(tables.materialize(states(s, d)))))

_LEXICON = {"of": 1.2, "in": -0.8, "the": 0.6, "to": -1.5, "is": 2.0, "an": -2.2, "be": 1.1}


def scored_comments(s, d):
    """Turns as comments with a compound sentiment; two turns make a snapshot, a turn takes ten minutes."""
    c = fx.comments(s, d).select("post_id", "comment_id", "parent_id", "author", "body", "upvotes", F.floor(F.col("comment_id") / 2).cast("int").alias("snapshot_no"), F.col("parent_id").isNull().alias("is_top_level"), (F.col("comment_id") * 10.0).alias("age_minutes"), F.concat_ws(":", "post_id", "comment_id").alias("k"))
    lexicon = s.createDataFrame(list(_LEXICON.items()), "token string, valence double")
    return c.join(groups.sentiment(c, lexicon, "k", "body").distinct(), "k").withColumn("compound", F.when(F.coalesce("body", F.lit("")) != "", F.col("compound")))


def profiles(s, d):
    c = scored_comments(s, d)
    return discussion.comment_profile(c, c.where("comment_id = 1").groupBy("post_id").agg(F.max("author").alias("post_author")), ["post_id", "snapshot_no"])


COMPOUND_SQL = (
    r"""cm AS (SELECT conv_id AS post_id, turn AS comment_id, role AS author, text AS body, CAST(length(text) % 50 AS BIGINT) AS upvotes, CAST(floor(turn / 2) AS INT) AS snapshot_no, turn = 0 AS is_top_level, turn * 10.0::DOUBLE AS age_minutes FROM conversations),
w AS (SELECT post_id, comment_id, unnest(regexp_extract_all(lower(body), '\p{L}+')) AS token, generate_subscripts(regexp_extract_all(lower(body), '\p{L}+'), 1) AS pos FROM cm), b4 AS (SELECT *, lag(token) OVER (PARTITION BY post_id, comment_id ORDER BY pos) AS before FROM w),
sm AS (SELECT post_id, comment_id, sum(CASE WHEN before IN ('not', 'no', 'never') THEN -0.74 * valence ELSE valence END)::DOUBLE AS s FROM b4 JOIN (VALUES """
    + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _LEXICON.items())
    + r""") l(t, valence) ON l.t = b4.token GROUP BY 1, 2),
sc AS (SELECT cm.*, CASE WHEN coalesce(body, '') != '' THEN coalesce(s / sqrt(s * s + 15), 0) END AS compound, greatest(1.0::DOUBLE, coalesce(upvotes, 1)) AS wt FROM cm LEFT JOIN sm ON sm.post_id = cm.post_id AND sm.comment_id = cm.comment_id)"""
)
_WEIGHTED = "sum(compound * wt) / nullif(sum(CASE WHEN compound IS NOT NULL THEN wt END), 0)"
PROFILE_SQL = (
    COMPOUND_SQL
    + rf""", au AS (SELECT post_id, max(author) AS post_author FROM cm WHERE comment_id = 1 GROUP BY 1), pf AS (SELECT sc.post_id, snapshot_no, count(*) AS n_comments, count(CASE WHEN is_top_level THEN 1 END) AS n_top_level, count(CASE WHEN NOT is_top_level THEN 1 END) AS n_replies, avg(CAST(is_top_level AS INT)) AS top_level_share,
  count(DISTINCT nullif(lower(trim(author)), '')) AS n_commenters, avg(CAST(coalesce(author, '') = '[deleted]' AS INT)) AS deleted_share, avg(CAST(contains(coalesce(body, ''), '?') AS INT)) AS question_share, max(CAST(coalesce(lower(trim(author)) = lower(post_author), FALSE) AS INT)) AS op_replied,
  avg(upvotes) AS avg_upvotes, max(upvotes) AS max_upvotes, avg(len(regexp_extract_all(coalesce(body, ''), '[^ \t\n\r\f]+')))::DOUBLE AS avg_words, max(len(regexp_extract_all(coalesce(body, ''), '[^ \t\n\r\f]+')))::DOUBLE AS max_words, min(age_minutes) AS newest_age, max(age_minutes) AS oldest_age, CASE WHEN count(age_minutes) >= 2 THEN max(age_minutes) - min(age_minutes) END AS age_span,
  avg(compound) AS sentiment_mean, {_WEIGHTED} AS sentiment_weighted, avg(CAST(compound >= 0.05 AS INT)) AS positive_share, avg(CAST(compound <= -0.05 AS INT)) AS negative_share, CASE WHEN count(compound) >= 2 THEN var_pop(compound) END AS sentiment_variance FROM sc LEFT JOIN au ON au.post_id = sc.post_id GROUP BY 1, 2)"""
)
_PF = ("top_level_share", "deleted_share", "question_share", "avg_upvotes", "avg_words", "max_words", "newest_age", "oldest_age", "age_span", "sentiment_mean", "sentiment_weighted", "positive_share", "negative_share", "sentiment_variance")
query("comment_profile", f"WITH {PROFILE_SQL} SELECT post_id, snapshot_no, n_comments, n_top_level, n_replies, n_commenters, op_replied, max_upvotes, {_r(*_PF)} FROM pf")(lambda s, d: rounded(profiles(s, d)))

SNAP_SQL = COMPOUND_SQL + f""", sn AS (SELECT post_id, snapshot_no, count(*) AS n, avg(compound) AS mean, {_WEIGHTED} AS weighted, avg(CAST(compound > 0.05 AS INT)) AS pos_share, avg(CAST(compound < -0.05 AS INT)) AS neg_share, coalesce(var_samp(compound), 0) AS variance FROM sc WHERE compound IS NOT NULL GROUP BY 1, 2)"""


def sentiments(s, d):
    return discussion.snapshot_sentiment(scored_comments(s, d), ["post_id", "snapshot_no"])


query("snapshot_sentiment", f"WITH {SNAP_SQL} SELECT post_id, snapshot_no, n, {_r('mean', 'weighted', 'pos_share', 'neg_share', 'variance')} FROM sn")(lambda s, d: rounded(sentiments(s, d)))
_AT = lambda c, place, name: f"max(CASE WHEN i = {place} THEN {c} END) AS {name}"
query(
    "sentiment_trajectory",
    f"""WITH {SNAP_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY snapshot_no) - 1 AS i, count(*) OVER (PARTITION BY post_id) AS c FROM sn),
g AS (SELECT post_id, max(c) AS n_snapshots, {_AT("weighted", 0, "first_sentiment")}, {_AT("weighted", "c // 2", "mid_sentiment")}, {_AT("weighted", "c - 1", "last_sentiment")}, {_AT("variance", 0, "v0")}, {_AT("variance", "c - 1", "v1")}, {_AT("neg_share", 0, "n0")}, {_AT("neg_share", "c - 1", "n1")}, max(weighted) AS peak, min(weighted) AS trough, {_AT("n", 0, "first_count")}, {_AT("n", "c - 1", "last_count")} FROM q WHERE c >= 2 GROUP BY 1),
t AS (SELECT *, v1 - v0 AS variance_change, n1 - n0 AS neg_share_change, last_sentiment - first_sentiment AS sentiment_change, (last_sentiment - first_sentiment) / n_snapshots AS sentiment_slope, peak - trough AS volatility FROM g)
SELECT post_id, n_snapshots, first_count, last_count, {_r("first_sentiment", "mid_sentiment", "last_sentiment", "variance_change", "neg_share_change", "peak", "trough", "sentiment_change", "sentiment_slope", "volatility")},
  CASE WHEN first_sentiment > 0.05 AND last_sentiment < -0.05 THEN 'pos_to_neg' WHEN first_sentiment < -0.05 AND last_sentiment > 0.05 THEN 'neg_to_pos' WHEN first_sentiment > 0.05 AND last_sentiment > 0.05 THEN 'stayed_positive' WHEN first_sentiment < -0.05 AND last_sentiment < -0.05 THEN 'stayed_negative' ELSE 'neutral' END AS flip FROM t""",
)(lambda s, d: rounded(discussion.sentiment_trajectory(sentiments(s, d), "snapshot_no")))


def grouped_profiles(s, d):
    return profiles(s, d).withColumn("topic", F.col("post_id") % 3).withColumn("community", F.col("post_id") % 5)


_GROUPED = PROFILE_SQL + ", gp AS (SELECT *, post_id % 3 AS topic, post_id % 5 AS community FROM pf)"
query(
    "discussion_quality",
    f"""WITH {_GROUPED}, q AS (SELECT topic, community, count(*) AS n, least(avg(question_share) * 100, 25) + least(avg(avg_upvotes) * 0.5, 25) + least(avg(n_commenters) * 0.25, 25) + least(avg(avg_words) * (1 / 6), 25) AS s FROM gp GROUP BY 1, 2)
SELECT topic, community, n, round_even(s, 0) AS score, CASE WHEN s >= 75 THEN 'deep & engaged' WHEN s >= 55 THEN 'good discussion' WHEN s >= 35 THEN 'moderate' ELSE 'shallow / low engagement' END AS label FROM q""",
)(lambda s, d: rounded(discussion.discussion_quality(grouped_profiles(s, d), ["topic", "community"])))
_BAND = lambda none, *v: f"CASE WHEN s IS NULL THEN {none} WHEN s > 0.15 THEN {v[0]} WHEN s > 0.05 THEN {v[1]} WHEN s < -0.15 THEN {v[2]} WHEN s < -0.05 THEN {v[3]} ELSE {v[4]} END"
query(
    "sentiment_signal",
    f"""WITH {_GROUPED}, q AS (SELECT topic, community, avg(coalesce(sentiment_weighted, sentiment_mean)) AS s FROM gp GROUP BY 1, 2)
SELECT topic, community, round(s, 6) + 0.0 AS avg_sentiment, CAST({_BAND("1.0", "1.3", "1.1", "0.7", "0.9", "1.0")} AS DOUBLE) AS multiplier, {_BAND("'insufficient sentiment data'", "'strongly positive'", "'mildly positive'", "'strongly negative'", "'mildly negative'", "'neutral'")} AS label FROM q""",
)(lambda s, d: rounded(discussion.sentiment_signal(grouped_profiles(s, d), ["topic", "community"])))


def cross(s, d):
    p = fx.posts(s, d).withColumn("created", (F.col("day_no") * 24 + F.col("created_hour")).cast("double"))
    return tables.materialize(selection.cross_posts(p.withColumn("words", text.similarity_words(F.col("title")))))


CROSS_SQL = (
    f"{POSTS_SQL}, {SIMILAR_SQL}"
    + """, pr AS (SELECT x.post_id AS a, y.post_id AS b, count(*) / least(any_value(x.n), any_value(y.n)) AS sim FROM t x JOIN t y ON x.w = y.w AND x.community < y.community GROUP BY 1, 2),
pc AS (SELECT post_id, community, title, CAST(day_no * 24 + created_hour AS DOUBLE) AS created, upvotes, state IN ('surging', 'alive') AS alive FROM posts),
cj AS (SELECT abs(y.created - x.created) AS lag_hours, CASE WHEN x.created <= y.created THEN x ELSE y END AS f, CASE WHEN x.created <= y.created THEN y ELSE x END AS s FROM pr JOIN pc x ON x.post_id = pr.a JOIN pc y ON y.post_id = pr.b WHERE sim >= 0.5 AND abs(y.created - x.created) <= 48),
cp AS (SELECT f.community AS first, s.community AS second, f.post_id AS first_id, s.post_id AS second_id, lag_hours, f.upvotes AS first_upvotes, s.upvotes AS second_upvotes, f.alive AS first_alive, s.alive AS second_alive FROM cj QUALIFY row_number() OVER (PARTITION BY substr(f.title, 1, 30), f.community, s.community ORDER BY f.post_id, s.post_id) = 1)"""
)
query("cross_posts", f"WITH {CROSS_SQL} SELECT * FROM cp")(lambda s, d: cross(s, d))
query(
    "transfer_matrix",
    f"""WITH {CROSS_SQL}, g AS (SELECT first, second, count(*) AS n, avg(CAST(second_alive AS INT)) AS success_rate, count(CASE WHEN first_alive THEN 1 END) AS n_first_alive, avg(CASE WHEN first_alive THEN CAST(second_alive AS INT) END) AS g, count(CASE WHEN first_upvotes > 0 THEN 1 END) AS c, median(CASE WHEN first_upvotes > 0 THEN second_upvotes / first_upvotes END) AS m, median(second_upvotes) AS median_second FROM cp GROUP BY 1, 2)
SELECT first, second, n, n_first_alive, {_r("success_rate", "median_second")}, round(CASE WHEN c >= 5 THEN m END, 6) AS median_ratio, round(CASE WHEN n_first_alive >= 3 THEN g END, 6) AS success_given_alive, CASE WHEN n_first_alive >= 3 THEN CASE WHEN g > 0.3 THEN 'post' WHEN g > 0.15 THEN 'maybe' ELSE 'skip' END END AS advice FROM g""",
)(lambda s, d: rounded(selection.transfer_matrix(cross(s, d))))
query(
    "lag_bands",
    f"WITH {CROSS_SQL}, b AS (SELECT *, CASE WHEN lag_hours < 1 THEN '< 1h' WHEN lag_hours < 4 THEN '1-4h' WHEN lag_hours < 12 THEN '4-12h' WHEN lag_hours < 48 THEN '12-48h' END AS band FROM cp) SELECT band, count(*) AS n, round(avg(CAST(second_alive AS INT)), 6) AS success_rate, round(median(second_upvotes), 6) AS median_second, round(avg(second_upvotes), 6) AS avg_second FROM b WHERE band IS NOT NULL GROUP BY 1",
)(lambda s, d: rounded(selection.lag_bands(cross(s, d))))
query(
    "propagation",
    f"WITH {CROSS_SQL} SELECT first, count(*) AS times_first, round(avg(CASE WHEN lag_hours > 0 THEN lag_hours END), 6) AS avg_lag, round(median(CASE WHEN lag_hours > 0 THEN lag_hours END), 6) AS median_lag, round(avg(CAST(first_upvotes > second_upvotes AS INT)), 6) AS first_wins FROM cp GROUP BY 1",
)(lambda s, d: rounded(selection.propagation(cross(s, d))))

query(
    "case_selection",
    f"""WITH {POSTS_SQL}, r AS (SELECT community, post_id, upvotes, row_number() OVER (ORDER BY upvotes DESC, post_id) AS o, row_number() OVER (PARTITION BY community ORDER BY upvotes DESC, post_id) AS g FROM posts) SELECT community, post_id, upvotes, CASE WHEN o <= 3 THEN 'overall' ELSE 'group' END AS why FROM r WHERE o <= 3 OR g = 1""",
)(lambda s, d: selection.choose_cases(fx.posts(s, d).select("community", "post_id", "upvotes"), [F.desc("upvotes"), F.asc("post_id")], 3, "community", "post_id"))


def cohort(s, d):
    p = fx.posts(s, d).select("post_id", "community", "state", "upvotes", "day_no")
    current = p.where("day_no BETWEEN 2 AND 5").select("post_id", "community", F.when(F.col("state") == "cooling", "").otherwise(F.concat(F.lit("now "), "state")).alias("state"), (F.col("upvotes") + 1).alias("upvotes"))
    return selection.merge_cohort(p.where("day_no < 4").drop("day_no"), current, "post_id"), p.where("day_no BETWEEN 4 AND 8").select("post_id", "community", "state", "upvotes")


COHORT_SQL = POSTS_SQL + """, pv AS (SELECT * FROM posts WHERE day_no < 4), cu AS (SELECT post_id, community, CASE WHEN state = 'cooling' THEN '' ELSE 'now ' || state END AS state, upvotes + 1 AS upvotes FROM posts WHERE day_no BETWEEN 2 AND 5),
co AS (SELECT coalesce(cu.post_id, pv.post_id) AS post_id, coalesce(nullif(cu.community, ''), pv.community) AS community, coalesce(nullif(cu.state, ''), pv.state) AS state, coalesce(cu.upvotes, pv.upvotes) AS upvotes FROM pv FULL JOIN cu ON cu.post_id = pv.post_id)"""
query("cohort_merge", f"WITH {COHORT_SQL} SELECT * FROM co")(lambda s, d: cohort(s, d)[0])
query(
    "cohort_admission",
    f"""WITH {COHORT_SQL}, k AS (SELECT community, count(*) AS c FROM co GROUP BY 1), f AS (SELECT post_id, community, state, upvotes, row_number() OVER (PARTITION BY community ORDER BY upvotes DESC, post_id) AS admitted FROM posts WHERE day_no BETWEEN 4 AND 8 AND post_id NOT IN (SELECT post_id FROM co)) SELECT f.* FROM f LEFT JOIN k ON k.community = f.community WHERE admitted + coalesce(c, 0) <= 120""",
)(lambda s, d: selection.admit(*cohort(s, d), "community", "post_id", [F.desc("upvotes"), F.asc("post_id")], 120).withColumn("admitted", F.col("admitted").cast("long")))
query(
    "union_keep_first",
    f"""WITH {COHORT_SQL}, u AS (SELECT post_id, community, state, upvotes, 0 AS o FROM co UNION ALL SELECT post_id, community, state, upvotes, 1 FROM posts WHERE day_no BETWEEN 4 AND 8) SELECT post_id, community, state, upvotes FROM u QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY o) = 1""",
)(lambda s, d: selection.union_keep_first(list(cohort(s, d)), "post_id"))
