"""Queries on posts as they stand: comments, status, boards, forecast with scores, catalog, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import status, timeline
from ..sources import tables
from . import fixtures as fx
from .fixtures import COMMENT_SNAPSHOTS_SQL, LINKS_SQL, PLACED_SQL, POSTS_SQL
from .registry import _r, neighbours, NEIGHBOURS_SQL, query, rounded, states, STATES_SQL

AGGREGATES_SQL = f"""{COMMENT_SNAPSHOTS_SQL}, ca AS (SELECT community, post_id, snapshot_no, count(*) AS n, count(*) FILTER (is_top_level = 1) AS t, count(DISTINCT lower(author)) AS w, sum(upvotes) AS u, CAST(sum(replies) AS DOUBLE) AS p, avg(upvotes) AS au, max(upvotes) AS mu, CAST(max(replies) AS DOUBLE) AS mp FROM cs GROUP BY 1, 2, 3),
ag AS (SELECT community, post_id, count(*) AS comment_snapshots, max(snapshot_no) AS latest_comment_snapshot, last(n ORDER BY snapshot_no) AS latest_comments, last(t ORDER BY snapshot_no) AS latest_top_level, last(n - t ORDER BY snapshot_no) AS latest_reply_comments, last(w ORDER BY snapshot_no) AS latest_commenters,
  last(u ORDER BY snapshot_no) AS latest_upvotes, last(p ORDER BY snapshot_no) AS latest_replies, last(au ORDER BY snapshot_no) AS latest_avg_upvotes, last(mu ORDER BY snapshot_no) AS latest_max_upvotes, last(mp ORDER BY snapshot_no) AS latest_max_replies, sum(u) AS total_upvotes, sum(p) AS total_replies,
  max(mu) AS max_upvotes_seen, max(mp) AS max_replies_seen, max(n) AS max_comments_seen, max(u) AS most_upvotes_in_snapshot, max(p) AS most_replies_in_snapshot FROM ca GROUP BY 1, 2)"""
_l = lambda c: f"ln(1 + greatest(0, coalesce({c}, 0)))"
_ord = "ORDER BY hours, snapshot_no, rank"
_first, _last = (lambda c: f"first({c} {_ord})"), (lambda c: f"last({c} {_ord})")
_TH = [f"{s}_{m}" for s in ("alive", "surging", "dead") for m in ("upvotes", "comments")]
STATUS_SQL = f"""{STATES_SQL}, {PLACED_SQL}, {AGGREGATES_SQL}, s0 AS (SELECT community, post_id, count(*) AS snapshot_count, max(hours) - min(hours) AS observed_hours, {_last('age_minutes')} AS age_minutes, {_first('listing')} AS first_listing, {_last('listing')} AS last_listing, min(rank) AS best_rank, {_last('rank')} AS latest_rank, {_last('state')} AS raw_state,
  max(upvotes) AS max_upvotes, max(comments) AS max_comments, {_last('upvotes')} - {_first('upvotes')} AS upvote_growth, {_last('comments')} - {_first('comments')} AS comment_growth, {_last('upvote_velocity')} AS last_upvote_velocity, {_last('comment_velocity')} AS last_comment_velocity, count(*) FILTER (still_visible_next = 1) AS visible_next_count,
  min(snapshot_no) AS first_snapshot, max(snapshot_no) AS last_snapshot, {", ".join(f"{_last(k)} AS {k}" for k in _TH)} FROM pl GROUP BY 1, 2),
s1 AS (SELECT s0.*, ag.* EXCLUDE (community, post_id, total_upvotes, total_replies), coalesce(last_upvote_velocity, 0) > dead_upvotes OR coalesce(last_comment_velocity, 0) > dead_comments AS moves FROM s0 LEFT JOIN ag ON ag.community = s0.community AND ag.post_id = s0.post_id),
s2 AS (SELECT *, CASE WHEN raw_state IN ('surging', 'alive', 'emerging') THEN raw_state WHEN snapshot_count < 2 THEN 'unknown' WHEN raw_state IN ('cooling', 'dying', 'dead') AND snapshot_count < 3 THEN 'unknown' WHEN raw_state = 'dying' AND moves THEN 'cooling' WHEN raw_state = 'dead' AND (age_minutes < 720 OR moves) THEN 'dying' ELSE raw_state END AS latest_state,
  1.2 * {_l('latest_comments')} + 1.3 * {_l('latest_upvotes')} + 1.4 * {_l('latest_replies')} + 0.9 * {_l('latest_commenters')} + 0.7 * {_l('max_upvotes_seen')} + 0.8 * {_l('max_replies_seen')} AS engagement FROM s1),
s3 AS (SELECT *, 1.5 * {_l('max_upvotes')} + 1.6 * {_l('max_comments')} + {_l('upvote_growth')} + 1.1 * {_l('comment_growth')} + 0.8 * {_l('last_upvote_velocity')} + {_l('last_comment_velocity')} + engagement AS popularity,
  (1.8 * {_l('last_upvote_velocity')} + 2.0 * {_l('last_comment_velocity')} + 0.9 * {_l('latest_upvotes')} + {_l('latest_replies')} + 0.7 * {_l('latest_commenters')}) * CASE latest_state WHEN 'surging' THEN 1.25 WHEN 'alive' THEN 1.0 WHEN 'emerging' THEN 1.05 WHEN 'cooling' THEN 0.65 WHEN 'dying' THEN 0.35 WHEN 'dead' THEN 0.15 WHEN 'unknown' THEN 0.35 ELSE 0.5 END
  + CASE latest_state WHEN 'surging' THEN 1.6 WHEN 'alive' THEN 0.9 WHEN 'emerging' THEN 1.1 WHEN 'cooling' THEN 0.2 WHEN 'dying' THEN -0.7 WHEN 'dead' THEN -1.5 WHEN 'unknown' THEN -0.2 ELSE 0 END + CASE last_listing WHEN 'hot' THEN 1.7 WHEN 'rising' THEN 1.5 WHEN 'new' THEN 1.0 WHEN 'top_day' THEN 0.9 WHEN 'top_week' THEN 0.3 ELSE 0 END
  + CASE WHEN age_minutes IS NULL THEN 0 WHEN age_minutes <= 60 THEN 1.3 WHEN age_minutes <= 360 THEN 0.8 WHEN age_minutes <= 1440 THEN 0.2 ELSE -0.6 END + CASE WHEN latest_rank > 0 THEN 2.2 / ln(1 + greatest(2.0, latest_rank + 1.5)) ELSE 0 END AS attention,
  CASE latest_state WHEN 'surging' THEN 'highest' WHEN 'alive' THEN 'high' WHEN 'emerging' THEN 'high' WHEN 'cooling' THEN CASE WHEN age_minutes <= 360 THEN 'medium' ELSE 'low' END WHEN 'dead' THEN 'very_low' ELSE 'low' END AS priority FROM s2)"""
_z = lambda *names: ", ".join(f"round(coalesce({n}, 0), 9) DESC" for n in names)


def post_status(s, d):
    rows = tables.materialize(fx.placed(states(s, d)))
    return status.post_status(rows, status.comment_aggregates(fx.comment_snapshots(s, d)))


query("comment_aggregates", f"WITH {AGGREGATES_SQL} SELECT * REPLACE (round(latest_avg_upvotes, 6) AS latest_avg_upvotes) FROM ag")(lambda s, d: rounded(status.comment_aggregates(fx.comment_snapshots(s, d))))
_SHOWN = ["community", "post_id", "snapshot_count", "first_listing", "last_listing", "best_rank", "latest_rank", "raw_state", "latest_state", "priority", "visible_next_count", "latest_comments", "latest_commenters"]
_NUMBERS = ["observed_hours", "age_minutes", "max_upvotes", "upvote_growth", "comment_growth", "engagement", "popularity", "attention"]
query("post_status", f"WITH {STATUS_SQL} SELECT {', '.join(_SHOWN)}, {_r(*_NUMBERS)} FROM s3")(lambda s, d: rounded(post_status(s, d).select(*_SHOWN, *_NUMBERS)))
query("top_posts", f"WITH {STATUS_SQL} SELECT community, post_id, row_number() OVER (PARTITION BY community ORDER BY {_z('popularity', 'engagement', 'max_upvotes', 'max_comments', 'upvote_growth')}, first_snapshot, post_id) AS popularity_rank FROM s3")(lambda s, d: status.top_posts(rounded9(post_status(s, d))).select("community", "post_id", "popularity_rank"))
_STATUS_ORDER = f"CASE priority WHEN 'highest' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'very_low' THEN 4 ELSE 9 END, {_z('attention', 'last_comment_velocity', 'last_upvote_velocity', 'engagement', 'popularity', 'max_upvotes')}, post_id"


def rounded9(df):
    """Numbers that orders go by, to 9 places, so that both engines see the same ties."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


for _name, _states, _priorities in (("alive_focus", ("surging", "alive", "emerging"), ("highest", "high")), ("cooling_posts", ("cooling", "dying"), None), ("dead_posts", ("dead",), None)):

    def _f(s, d, a=_states, b=_priorities):
        return status.latest_status(rounded9(post_status(s, d)), a, b).select("community", "post_id", "latest_state", "priority", "status_rank")

    _where = f"latest_state IN ({', '.join(repr(x) for x in _states)},'')" + (f" AND priority IN ({', '.join(repr(x) for x in _priorities)})" if _priorities else "")
    query(_name, f"WITH {STATUS_SQL} SELECT community, post_id, latest_state, priority, row_number() OVER (PARTITION BY community ORDER BY {_STATUS_ORDER}) AS status_rank FROM s3 WHERE {_where}")(_f)
query("top_risers", f"WITH {STATUS_SQL} SELECT community, post_id, {_r('attention')} FROM s3 WHERE latest_state IN ('surging', 'alive', 'emerging') AND priority IN ('highest', 'high') ORDER BY {_z('attention', 'last_comment_velocity', 'last_upvote_velocity', 'engagement', 'comment_growth', 'upvote_growth')}, community, post_id LIMIT 50")(lambda s, d: rounded(status.top_risers(rounded9(post_status(s, d)), 50).select("community", "post_id", "attention")))
query(
    "attention_summary",
    f"""WITH {STATUS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY {_z('attention', 'popularity')}, post_id) AS k FROM s3) SELECT community, count(*) AS n_posts, count(*) FILTER (latest_state IN ('surging', 'alive', 'emerging')) AS n_alive, count(*) FILTER (latest_state IN ('cooling', 'dying')) AS n_cooling, count(*) FILTER (latest_state = 'dying') AS n_dying, count(*) FILTER (latest_state = 'dead') AS n_dead,
  round(sum(attention), 5) + 0.0 AS total_attention, round(avg(attention), 6) + 0.0 AS avg_attention, round(max(attention), 6) + 0.0 AS max_attention, round(sum(popularity), 5) + 0.0 AS total_popularity, round(avg(popularity), 6) AS avg_popularity, round(max(popularity), 6) AS max_popularity, max(post_id) FILTER (k = 1) AS top_post, max(latest_state) FILTER (k = 1) AS top_state, max(last_listing) FILTER (k = 1) AS top_listing FROM o GROUP BY 1""",
)(lambda s, d: rounded(status.attention_summary(rounded9(post_status(s, d))).withColumns({c: F.round(c, 5) for c in ("total_attention", "total_popularity")})))
_MULT = "CASE latest_state WHEN 'surging' THEN 1.0 WHEN 'alive' THEN 0.9 WHEN 'emerging' THEN 0.8 WHEN 'cooling' THEN 0.45 WHEN 'dying' THEN 0.15 WHEN 'dead' THEN 0.0 ELSE 0.5 END"
_DECAY = "CASE latest_state WHEN 'surging' THEN 0.9 WHEN 'alive' THEN 0.8 WHEN 'emerging' THEN 0.72 WHEN 'cooling' THEN 0.45 WHEN 'dying' THEN 0.2 WHEN 'dead' THEN 0.0 ELSE 0.5 END"
_BASE = "CASE latest_state WHEN 'surging' THEN 0.08 WHEN 'alive' THEN 0.22 WHEN 'emerging' THEN 0.34 WHEN 'cooling' THEN 0.72 WHEN 'dying' THEN 0.9 WHEN 'dead' THEN 1.0 ELSE 0.35 END"
_ratio = lambda v, t, top: f"least(coalesce({v} / nullif({t}, 0), 0), {top})"
_over = lambda k: f"(next_upvotes >= {k}_upvotes OR next_comments >= {k}_comments)"
_six = lambda v: f"CASE WHEN {v} <= 0 OR q <= 0 THEN 0 ELSE {v} * (1 + q + q ** 2 + q ** 3 + q ** 4 + q ** 5) END"
FORECAST_SQL = f"""{STATUS_SQL}, f0 AS (SELECT *, greatest(coalesce(last_upvote_velocity, 0), 0) AS u, greatest(coalesce(last_comment_velocity, 0), 0) AS c, {_MULT}::DOUBLE AS k, {_DECAY}::DOUBLE AS q, {_BASE}::DOUBLE AS base FROM s3),
f1 AS (SELECT *, u * k AS next_upvotes, c * k AS next_comments, CASE WHEN latest_state = 'dead' THEN 1.0 ELSE least(1.0, greatest(0.0, 0.42 * base + 0.28 * (1 - least(1, greatest(0, ({_ratio("u", "alive_upvotes", 4)} + {_ratio("c", "alive_comments", 4)}) / 2 / 1.5))) + 0.22 * (1 - least(1, greatest(0, ({_ratio("u", "dead_upvotes", 8)} + {_ratio("c", "dead_comments", 8)}) / 2 / 3.0)))
  + 0.08 * least(1, observed_hours / 6.0) - 0.12 * least(1, greatest(0, attention / 50)) - 0.08 * least(1, greatest(0, popularity / 75)))) END AS die_soon FROM f0),
f2 AS (SELECT *, ln(1 + next_upvotes) + ln(1 + next_comments * 4) + attention * 0.15 + popularity * 0.03 - die_soon * 2 AS forecast_priority, CASE WHEN {_over("surging")} THEN 'surge_watch' WHEN {_over("alive")} THEN 'active_watch' WHEN latest_state = 'dying' THEN 'dying_watch' WHEN latest_state = 'cooling' THEN 'cooling_watch' WHEN latest_state = 'dead' THEN 'stop_watch' ELSE 'low_watch' END AS recommendation,
  CASE WHEN {_over("surging")} THEN 'surging' WHEN {_over("alive")} THEN 'alive' WHEN die_soon >= 0.9 OR latest_state = 'dead' THEN 'dead' WHEN die_soon >= 0.65 OR latest_state = 'dying' THEN 'dying' ELSE 'cooling' END AS predicted_state FROM f1)"""
_FORECAST = ["next_upvotes", "next_comments", "die_soon", "forecast_priority"]
query("forecast_board", f"WITH {FORECAST_SQL} SELECT community, post_id, latest_state, recommendation, predicted_state, CASE WHEN die_soon >= 0.65 THEN 'likely_to_die_soon' ELSE 'likely_to_continue' END AS die_soon_label, {_r(*_FORECAST)}, round({_six('next_upvotes')}, 6) + 0.0 AS upvotes_6h, round({_six('next_comments')}, 6) + 0.0 AS comments_6h FROM f2")(
    lambda s, d: rounded(status.forecast(post_status(s, d)).select("community", "post_id", "latest_state", "recommendation", "predicted_state", "die_soon_label", *_FORECAST, "upvotes_6h", "comments_6h"))
)
_three = lambda v: f"CASE WHEN {v} <= 0 OR q <= 0 THEN 0 ELSE {v} * (1 + q + q * q) END"
query("forecast", f"WITH {FORECAST_SQL} SELECT community, post_id, latest_state, {_r('next_upvotes', 'next_comments', 'die_soon')}, round({_three('next_upvotes')}, 6) + 0.0 AS upvotes_3h, round({_six('next_upvotes')}, 6) + 0.0 AS upvotes_6h, recommendation, predicted_state FROM f2")(
    lambda s, d: rounded(status.forecast(post_status(s, d)).select("community", "post_id", "latest_state", "next_upvotes", "next_comments", "die_soon", "upvotes_3h", "upvotes_6h", "recommendation", "predicted_state"))
)
_FORDER = f"{_z('forecast_priority', 'next_upvotes', 'next_comments')}, post_id"
query("forecast_ranks", f"WITH {FORECAST_SQL} SELECT community, post_id, row_number() OVER (PARTITION BY community ORDER BY {_FORDER}) AS community_rank, row_number() OVER (ORDER BY round(forecast_priority, 9) DESC, post_id) AS overall_rank FROM f2")(
    lambda s, d: timeline.overall_rank(status.ranked_in(rounded9(status.forecast(post_status(s, d))), "community", "community_rank", *status.falling("forecast_priority", "next_upvotes", "next_comments"), F.col("post_id")), "forecast_priority", "overall_rank", "post_id").select("community", "post_id", "community_rank", "overall_rank")
)
query("watchlist", f"WITH {FORECAST_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY {_FORDER}) AS watch_rank FROM f2 WHERE recommendation IN ('surge_watch', 'active_watch', 'cooling_watch', 'dying_watch')) SELECT community, post_id, recommendation, watch_rank FROM w WHERE watch_rank <= 20")(
    lambda s, d: status.watchlist(rounded9(status.forecast(post_status(s, d)))).select("community", "post_id", "recommendation", "watch_rank")
)


def linked_posts(s, d):
    """Posts as snapshots by day, with the link of the page of the same number."""
    p = fx.posts(s, d).join(fx.links(s, d), "post_id", "left")
    return p.select(F.col("day_no").alias("snapshot_no"), "community", "post_id", "upvotes", (F.col("upvotes") % 4).alias("comments"), "link", "domain", F.col("post_id").alias("place"))


LINKED_SQL = f"{POSTS_SQL}, {LINKS_SQL}, lp AS (SELECT p.day_no AS snapshot_no, p.community, p.post_id, p.upvotes, p.upvotes % 4 AS comments, l.link, l.domain, p.post_id AS place FROM posts p LEFT JOIN links l ON l.post_id = p.post_id)"
query(
    "snapshot_catalog",
    f"""WITH {LINKED_SQL}, d0 AS (SELECT snapshot_no, community, domain, count(*) AS n, min(place) AS first_at FROM lp WHERE coalesce(domain, '') <> '' GROUP BY 1, 2, 3), d1 AS (SELECT snapshot_no, community, first(domain ORDER BY n DESC, first_at) AS top_domain, max(n) AS n FROM d0 GROUP BY 1, 2),
g AS (SELECT snapshot_no, community, count(*) AS n_posts, count(DISTINCT nullif(domain, '')) AS n_domains, round(avg(upvotes), 6) AS avg_upvotes, round(median(upvotes), 6) AS median_upvotes, round(avg(comments), 6) + 0.0 AS avg_comments, round(median(comments), 6) + 0.0 AS median_comments, round(avg(CASE WHEN comments > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_with_comments, round(avg(CASE WHEN coalesce(link, '') <> '' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_with_links FROM lp GROUP BY 1, 2)
SELECT g.*, d1.top_domain, round(d1.n / g.n_posts, 6) AS top_domain_share FROM g LEFT JOIN d1 ON d1.snapshot_no = g.snapshot_no AND d1.community = g.community""",
)(lambda s, d: rounded(status.snapshot_catalog(linked_posts(s, d))))
query(
    "gap_patch",
    f"""WITH {NEIGHBOURS_SQL}, g AS (SELECT *, coalesce(hours_since_previous > 0 AND hours_since_previous < 7 AND coalesce(upvote_velocity, 0) = 0 AND upvotes > 20, false) AS still, coalesce(hours_since_previous >= 7, false) AS wide FROM nb), h AS (SELECT *, coalesce((still AND upvote_delta > 0) OR (wide AND upvote_delta IS NOT NULL), false) AS mend FROM g)
SELECT community, post_id, snapshot_no, CAST(wide AS INT) AS is_collection_gap, CAST(mend AS INT) AS velocity_interpolated, CAST(coalesce(still AND upvote_delta = 0, false) AS INT) AS is_fuzzing, round(CASE WHEN mend THEN round(upvote_delta / hours_since_previous, 4) ELSE upvote_velocity END, 6) + 0.0 AS patched_velocity FROM h""",
)(lambda s, d: rounded(timeline.gap_patch(neighbours(s, d), 7.0).select("community", "post_id", "snapshot_no", "is_collection_gap", "velocity_interpolated", "is_fuzzing", "patched_velocity")))
_AGED = f"{NEIGHBOURS_SQL}, ag AS (SELECT *, (hours - min(hours) OVER (PARTITION BY community, post_id)) * 60 AS a FROM nb)"
query(
    "freshness",
    f"WITH {_AGED} SELECT CASE WHEN a < 30 THEN 'under_30m' WHEN a < 60 THEN '30m_to_1h' WHEN a < 180 THEN '1h_to_3h' WHEN a < 360 THEN '3h_to_6h' WHEN a < 720 THEN '6h_to_12h' WHEN a < 1440 THEN '12h_to_24h' ELSE 'over_24h' END AS bucket, count(*) AS n, CAST(sum(CASE WHEN a <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS is_fresh_30m, CAST(sum(CASE WHEN a <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS is_fresh_1h, CAST(sum(CASE WHEN a <= 180 THEN 1 ELSE 0 END) AS BIGINT) AS is_fresh_3h, CAST(sum(CASE WHEN a <= 360 THEN 1 ELSE 0 END) AS BIGINT) AS is_fresh_6h, CAST(sum(CASE WHEN a >= 720 THEN 1 ELSE 0 END) AS BIGINT) AS is_old_12h, CAST(sum(CASE WHEN a >= 1440 THEN 1 ELSE 0 END) AS BIGINT) AS is_old_24h FROM ag GROUP BY 1",
)(lambda s, d: states(s, d).groupBy(scores.snapshot_age_bucket(F.col("age_minutes")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in scores.freshness_flags(F.col("age_minutes")).items()]))
query("run_summary", "WITH x AS (SELECT user_id % 5 AS c, user_id AS p, CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6.0) AS INT) AS s FROM events), y AS (SELECT DISTINCT c, p, s FROM x) SELECT (SELECT count(*) FROM (SELECT DISTINCT c, s FROM y)) AS n_snapshots, count(*) AS n_post_snapshots, (SELECT count(*) FROM (SELECT DISTINCT c, p FROM y)) AS n_posts, count(DISTINCT c) AS n_communities FROM y")(lambda s, d: status.run_summary(fx.post_snapshots(s, d)))
query("velocity_buckets", f"WITH {STATES_SQL} SELECT community, CASE WHEN coalesce(upvote_velocity, 0) >= surging_upvotes THEN 'high' WHEN coalesce(upvote_velocity, 0) >= alive_upvotes THEN 'med' ELSE 'low' END AS bucket, state, count(*) AS n FROM st GROUP BY 1, 2, 3")(lambda s, d: states(s, d).groupBy("community", scores.velocity_bucket(F.col("upvote_velocity"), F.col("alive_upvotes"), F.col("surging_upvotes")).alias("bucket"), "state").agg(F.count(F.lit(1)).alias("n")))
query(
    "coverage_by_day",
    f"WITH {STATES_SQL} SELECT snapshot_no // 4 AS day_no, community, count(*) AS n_rows, count(DISTINCT post_id) AS n_posts, " + ", ".join(f"round(avg(CASE WHEN state = '{x}' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_{x}" for x in ("emerging", "surging", "alive", "cooling", "dying", "dead", "unknown")) + " FROM st GROUP BY 1, 2",
)(lambda s, d: rounded(states(s, d).groupBy(F.floor(F.col("snapshot_no") / 4).cast("int").alias("day_no"), "community").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("post_id").alias("n_posts"), *[F.avg((F.col("state") == x).cast("double")).alias(f"share_{x}") for x in ("emerging", "surging", "alive", "cooling", "dying", "dead", "unknown")])))
query("latest_community_row", f"WITH {STATES_SQL}, h AS (SELECT community, snapshot_no, count(*) AS n_posts FROM st GROUP BY 1, 2) SELECT community, max(snapshot_no) AS snapshot_no, last(n_posts ORDER BY snapshot_no) AS n_posts FROM h GROUP BY 1")(lambda s, d: status.latest_per_community(states(s, d).groupBy("community", "snapshot_no").agg(F.count(F.lit(1)).alias("n_posts")), "snapshot_no", "n_posts"))
