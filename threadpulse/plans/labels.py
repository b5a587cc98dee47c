"""Queries on topic labels and posts' launches."""

from __future__ import annotations

from ..operators import labels
from ..sources import tables
from . import fixtures as fx
from .fixtures import PLACED_SQL
from .registry import _r, DAYS_SQL, grid, GRID_SQL, INDEX_SQL, keyword_days, KEYWORDS_SQL, query, rounded, states, STATES_SQL, with_words

query(
    "growth_targets",
    f"""WITH {DAYS_SQL}{INDEX_SQL}, p AS (SELECT d.*, coalesce(max(n_posts) OVER (PARTITION BY topic ORDER BY day_idx RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS future_peak, coalesce(CASE WHEN lag(day_idx) OVER (PARTITION BY topic ORDER BY day_idx) = day_idx - 1 THEN lag(n_posts) OVER (PARTITION BY topic ORDER BY day_idx) END, 0) AS y, (SELECT max(day_idx) FROM di) AS m FROM di d)
SELECT day_no, topic, n_posts, future_peak, future_peak >= 2 AS reaches_2, future_peak >= 3 AS reaches_3, future_peak >= 5 AS reaches_5, future_peak >= 1.5 * n_posts AS times_1_5, future_peak >= 2 * n_posts AS times_2, future_peak >= 3 * n_posts AS times_3, future_peak < 2 AS fails, y > 0 AND n_posts > y AS momentum FROM p WHERE n_posts BETWEEN 1 AND 3 AND day_idx + 3 <= m""",
)(lambda s, d: labels.growth_targets(keyword_days(s, d), 1, 3, 3, (2, 3, 5), (1.5, 2.0, 3.0), 2))
_OWN = f"""{DAYS_SQL}{INDEX_SQL}, own AS (SELECT *, count(*) OVER t AS n_days, CAST(sum(n_posts) OVER t AS BIGINT) AS total_posts, row_number() OVER (PARTITION BY topic ORDER BY day_idx) - 1 AS place FROM di WINDOW t AS (PARTITION BY topic))"""
query(
    "dies_tomorrow",
    f"""WITH {_OWN}, w AS (SELECT *, lead(n_posts) OVER o AS np, lead(day_idx) OVER o AS nd, lag(n_posts) OVER o AS lp, lag(total_upvotes) OVER o AS lu FROM own WHERE n_days >= 2 AND total_posts >= 5 WINDOW o AS (PARTITION BY topic ORDER BY day_idx))
SELECT topic, day_idx, n_posts, CAST(place AS INT) AS age, CASE WHEN nd <> day_idx + 1 OR np < 2 THEN 1 ELSE 0 END AS dies, round(CASE WHEN place > 0 THEN n_posts / greatest(lp, 1) ELSE 1.0 END, 6) AS post_trend, round(CASE WHEN place > 0 THEN total_upvotes / greatest(lu, 1) ELSE 1.0 END, 6) + 0.0 AS upvote_trend FROM w WHERE np IS NOT NULL""",
)(lambda s, d: rounded(labels.dies_tomorrow(keyword_days(s, d))))
query(
    "peak_profiles",
    f"""WITH {_OWN}, w AS (SELECT *, first_value(place) OVER (PARTITION BY topic ORDER BY n_posts DESC, place) AS pk FROM own WHERE n_days >= 3 AND total_posts >= 5), g AS (SELECT topic, max(n_days) AS n_days, max(total_posts) AS total_posts, max(n_posts) AS peak_posts, max(pk) AS pk, max(CASE WHEN place = pk THEN day_idx END) AS peak_idx, max(CASE WHEN place = 0 THEN n_posts END) AS first_posts,
  max(CASE WHEN place = 0 THEN total_upvotes END) AS first_upvotes, max(CASE WHEN place = 1 THEN n_posts END) AS p2, max(CASE WHEN place = 1 THEN total_upvotes END) AS u2, min(CASE WHEN place > pk AND n_posts < 2 THEN place - pk END) AS q FROM w GROUP BY 1)
SELECT topic, n_days, total_posts, peak_posts, CAST(peak_idx AS INT) AS peak_idx, CAST(pk AS INT) AS days_to_peak, pk = 0 AS peaks_first, pk <= 1 AS peaks_by_second, first_posts, first_upvotes, round(p2 / greatest(first_posts, 1), 6) AS post_growth, round(u2 / greatest(first_upvotes, 1), 6) + 0.0 AS upvote_growth, CAST(coalesce(q, n_days - pk) AS INT) AS days_to_quiet FROM g""",
)(lambda s, d: rounded(labels.peak_profiles(keyword_days(s, d))))
query(
    "reviver_profiles",
    f"""WITH {GRID_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY topic) AS n, lag(n_posts) OVER o AS b, lead(n_posts) OVER o AS a, coalesce(max(n_posts) OVER (PARTITION BY topic ORDER BY day_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) >= 2, false) AS again FROM gr WINDOW o AS (PARTITION BY topic ORDER BY day_idx)),
g AS (SELECT topic, count(*) FILTER (a IS NOT NULL AND n_posts < 2 AND b >= 2) AS drops, count(*) FILTER (a IS NOT NULL AND n_posts < 2 AND b >= 2 AND again) AS revivals, max(n_posts) FILTER (day_idx < 5) AS peak, count(*) FILTER (day_idx < 5 AND n_posts >= 2) AS active_days, CAST(sum(n_posts) FILTER (day_idx < 5) AS BIGINT) AS posts, stddev_pop(n_posts) FILTER (day_idx < 5) AS v,
  count(*) FILTER (day_idx > 0 AND day_idx < least(5, n) - 1 AND n_posts > b AND n_posts > a) AS t, count(*) FILTER (day_idx < 5) AS k FROM w GROUP BY 1)
SELECT topic, drops, revivals, revivals > 0 AS is_reviver, peak, active_days, posts, round(CASE WHEN active_days >= 2 THEN active_days / k ELSE 0 END, 6) + 0.0 AS consistency, round(CASE WHEN active_days >= 2 THEN v ELSE 0 END, 6) + 0.0 AS volatility, CASE WHEN active_days >= 2 THEN t ELSE 0 END AS peaks FROM g WHERE posts >= 3""",
)(lambda s, d: rounded(labels.reviver_profiles(grid(s, d))))
_CD = f"""{KEYWORDS_SQL}, cd AS (SELECT day_no, topic, community, count(*) AS n_posts, CAST(sum(upvotes) AS BIGINT) AS total_upvotes, max(upvotes) AS best_upvotes FROM (SELECT *, unnest(words) AS topic FROM kp) GROUP BY 1, 2, 3)"""
query("community_days", f"WITH {_CD} SELECT * FROM cd")(lambda s, d: labels.community_days(with_words(s, d), "words"))
query(
    "spread_labels",
    f"""WITH {_CD}, ix AS (SELECT day_no, row_number() OVER (ORDER BY day_no) - 1 AS day_idx FROM (SELECT DISTINCT day_no FROM cd)), t AS (SELECT topic, cd.day_no, day_idx, CAST(sum(n_posts) AS BIGINT) AS n_posts, list_sort(list(DISTINCT community)) AS today FROM cd JOIN ix ON ix.day_no = cd.day_no GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN lead(day_idx) OVER o = day_idx + 1 THEN lead(today) OVER o END AS ahead FROM t WINDOW o AS (PARTITION BY topic ORDER BY day_idx)),
u AS (SELECT *, list_sort(list_filter(coalesce(ahead, []), lambda x: NOT list_contains(today, x))) AS new FROM v WHERE len(today) <= 3 AND day_idx < (SELECT max(day_idx) FROM ix))
SELECT day_no, topic, n_posts, CAST(len(today) AS INT) AS n_communities, array_to_string(new, ',') AS new_communities, len(new) > 0 AS spreads, list_contains(new, 's1') AS reaches_target, list_contains(today, 's1') AS is_in_target FROM u""",
)(lambda s, d: labels.spread_labels(labels.community_days(with_words(s, d), "words"), "s1"))
query(
    "cumulative_history",
    f"""WITH {DAYS_SQL}{INDEX_SQL}, c AS (SELECT day_no, topic, count(*) FILTER (state IN ('surging', 'alive')) AS na, count(*) FILTER (state = 'surging') AS ns FROM (SELECT *, unnest(words) AS topic FROM kp) GROUP BY 1, 2), fs AS (SELECT f AS day_no, topic, count(*) AS nf FROM (SELECT topic, community, min(day_no) AS f FROM (SELECT *, unnest(words) AS topic FROM kp) GROUP BY 1, 2) GROUP BY 1, 2), w AS (SELECT di.day_no, di.topic, day_idx, n_posts, row_number() OVER o AS days_seen, CAST(sum(n_posts) OVER s AS BIGINT) AS posts, CAST(sum(total_upvotes) OVER s AS BIGINT) AS upvotes,
  CAST(sum(nf) OVER s AS INT) AS n_communities, sum(na) OVER s / sum(n_posts) OVER s AS alive_rate, sum(ns) OVER s / sum(n_posts) OVER s AS surging_rate, (n_posts - lag(n_posts) OVER o) / greatest(lag(n_posts) OVER o, 1) AS recent_growth, coalesce(max(n_posts) OVER (PARTITION BY di.topic ORDER BY day_idx RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS future_peak
  FROM di JOIN c ON c.day_no = di.day_no AND c.topic = di.topic LEFT JOIN fs ON fs.day_no = di.day_no AND fs.topic = di.topic WINDOW o AS (PARTITION BY di.topic ORDER BY day_idx), s AS (PARTITION BY di.topic ORDER BY day_idx ROWS UNBOUNDED PRECEDING))
SELECT day_no, topic, days_seen, posts, upvotes, CAST(n_communities AS INT) AS n_communities, {_r('alive_rate', 'surging_rate', 'recent_growth')}, future_peak FROM w WHERE days_seen >= 2 AND posts BETWEEN 3 AND 15 AND day_idx + 3 <= (SELECT max(day_idx) FROM di)""",
)(lambda s, d: rounded(labels.cumulative_history(with_words(s, d), "words")))
query(
    "day_windows",
    f"""WITH {DAYS_SQL}{INDEX_SQL}, w AS (SELECT topic, day_no, total_upvotes AS value, lag(total_upvotes, 1) OVER o AS lag_1, lag(total_upvotes, 2) OVER o AS lag_2, lag(total_upvotes, 3) OVER o AS lag_3, avg(total_upvotes) OVER b AS mean_3, max(total_upvotes) OVER b AS max_3, lead(total_upvotes, 1) OVER o AS next_1, lead(total_upvotes, 2) OVER o AS next_2, lead(total_upvotes, 3) OVER o AS next_3
  FROM di WINDOW o AS (PARTITION BY topic ORDER BY day_idx), b AS (PARTITION BY topic ORDER BY day_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT topic, day_no, value, lag_1, lag_2, lag_3, round(value / greatest(lag_1, 1), 6) + 0.0 AS growth, round(mean_3, 6) AS mean_3, max_3, round((lag_1 - lag_3) / 2, 6) + 0.0 AS trend_3, next_1, next_2, next_3, round((next_1 - value) / greatest(value, 1), 6) + 0.0 AS next_change FROM w WHERE lag_3 IS NOT NULL""",
)(lambda s, d: rounded(labels.day_windows(keyword_days(s, d))))
query(
    "emerging_keywords",
    f"""WITH {GRID_SQL}, f AS (SELECT *, min(CASE WHEN n_posts >= 1 THEN day_idx END) OVER (PARTITION BY topic) AS fi FROM gr), g AS (SELECT topic, max(fi) AS first_idx, max(CASE WHEN day_idx = fi THEN n_posts END) AS first_posts, max(n_posts) AS peak_posts, string_agg(CAST(n_posts AS VARCHAR), ',' ORDER BY day_idx) AS timeline FROM f GROUP BY 1),
k AS (SELECT f.topic, min(f.day_idx) AS peak_idx FROM f JOIN g ON g.topic = f.topic AND f.n_posts = g.peak_posts AND f.day_idx >= g.first_idx GROUP BY 1)
SELECT g.topic, first_idx, first_posts, peak_idx, peak_posts, round(peak_posts / greatest(first_posts, 1), 6) AS growth, peak_idx - first_idx AS days_to_peak, timeline FROM g JOIN k ON k.topic = g.topic WHERE first_posts <= 5 AND peak_posts >= 3""",
)(lambda s, d: rounded(labels.emerging_keywords(grid(s, d), 5, 3)))
_RANKOF = lambda c: f"CASE {c} WHEN 'dying' THEN 1 WHEN 'cooling' THEN 2 WHEN 'alive' THEN 3 WHEN 'surging' THEN 4 ELSE 0 END"
query(
    "accelerating_posts",
    f"""WITH {STATES_SQL}, w AS (SELECT *, coalesce(upvote_velocity, 0) AS v, row_number() OVER (PARTITION BY community, post_id ORDER BY hours DESC, snapshot_no DESC) AS r FROM st), x AS (SELECT a.community, a.post_id, a.upvotes, a.state, a.v - b.v AS velocity_increase, (a.upvotes - b.upvotes) / greatest(1.0, a.hours - b.hours) AS upvotes_per_hour, {_RANKOF('a.state')} > {_RANKOF('b.state')} AS state_improved, a.v > b.v OR {_RANKOF('a.state')} > {_RANKOF('b.state')} AS accelerates
  FROM w a JOIN w b ON a.community = b.community AND a.post_id = b.post_id AND a.r = 1 AND b.r = 2 WHERE a.upvotes <= 2000) SELECT community, post_id, {_r('upvotes')}, state, {_r('velocity_increase', 'upvotes_per_hour')}, state_improved, accelerates FROM x""",
)(lambda s, d: rounded(labels.accelerating_posts(states(s, d), 2000.0)))
query(
    "launch_speed",
    f"""WITH {STATES_SQL}, w AS (SELECT *, coalesce(upvote_velocity, 0) AS v, row_number() OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no) AS r FROM st), x AS (SELECT a.community, a.post_id, a.upvotes / greatest(0.1, a.age_minutes / 60) AS upvote_speed, a.comments / greatest(0.1, a.age_minutes / 60) AS comment_speed, (b.upvotes - a.upvotes) / greatest(0.1, (b.age_minutes - a.age_minutes) / 60) - a.upvotes / greatest(0.1, a.age_minutes / 60) AS upvote_acceleration,
  (b.comments - a.comments) / greatest(0.1, (b.age_minutes - a.age_minutes) / 60) - a.comments / greatest(0.1, a.age_minutes / 60) AS comment_acceleration, b.v - a.v AS velocity_acceleration FROM w a JOIN w b ON a.community = b.community AND a.post_id = b.post_id AND a.r = 1 AND b.r = 2) SELECT community, post_id, {_r('upvote_speed', 'comment_speed', 'upvote_acceleration', 'comment_acceleration', 'velocity_acceleration')} FROM x""",
)(lambda s, d: rounded(labels.launch_speed(states(s, d))))


def placed(s, d):
    return fx.placed(tables.materialize(states(s, d)))


query(
    "rank_changes",
    f"""WITH {STATES_SQL}, {PLACED_SQL}, w AS (SELECT *, lag(rank) OVER o - rank AS rc, lag(state) OVER o AS ls FROM pl WINDOW o AS (PARTITION BY community, post_id ORDER BY hours, snapshot_no))
SELECT community, post_id, snapshot_no, rc AS rank_change, CASE WHEN rc > 0 THEN 1 ELSE 0 END AS moved_up, CASE WHEN rc < 0 THEN 1 ELSE 0 END AS moved_down, CASE WHEN ls IS NOT NULL THEN CASE WHEN {_RANKOF('state')} > {_RANKOF('ls')} THEN 1 ELSE 0 END END AS state_rises FROM w""",
)(lambda s, d: labels.rank_changes(placed(s, d)))
query(
    "listing_paths",
    f"""WITH {STATES_SQL}, {PLACED_SQL}, m AS (SELECT *, CASE WHEN lag(listing) OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no) = listing THEN 0 ELSE 1 END AS turn FROM pl), r AS (SELECT *, sum(turn) OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT community, post_id, run, any_value(listing) AS listing, count(*) AS n, max(hours) - min(hours) AS span FROM r GROUP BY 1, 2, 3)
SELECT community, post_id, count(*) AS n_runs, string_agg(listing, '>' ORDER BY run) AS path, array_to_string(list(listing ORDER BY run)[-3:], '>') AS last_three, last(n ORDER BY run) AS run_length, round(last(span ORDER BY run), 6) + 0.0 AS hours_in_run FROM g GROUP BY 1, 2""",
)(lambda s, d: rounded(labels.listing_paths(placed(s, d))))
