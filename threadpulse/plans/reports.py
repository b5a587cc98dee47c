"""Queries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import groups, reports, topics
from . import fixtures as fx
from .fixtures import LINKS_SQL, POSTS_SQL
from .now import _LEXICON, COMPOUND_SQL, scored_comments
from .registry import _r, keyword_days, KEYWORDS_SQL, query, rounded, STATE_DAYS_SQL, states, STATES_SQL, with_words
from .status import _MULT


def with_next(s, d):
    """State rows whose post is in its community's next snapshot, with that state and the deltas."""
    w = Window.partitionBy("community", "post_id").orderBy("hours", "snapshot_no")
    is_next = F.lead("snapshot_no").over(w) == F.col("next_no")
    r = states(s, d).withColumns({"next_state": F.when(is_next, F.lead("state").over(w)), **{f"next_{m}_delta": F.when(is_next, F.lead(f"{m}s").over(w) - F.col(f"{m}s")) for m in ("upvote", "comment")}})
    return r.where("next_state IS NOT NULL")


NEXT_ROWS_SQL = STATES_SQL + ", nr AS (SELECT * FROM (SELECT *, CASE WHEN lead(snapshot_no) OVER o = next_no THEN lead(state) OVER o END AS next_state, CASE WHEN lead(snapshot_no) OVER o = next_no THEN lead(upvotes) OVER o - upvotes END AS next_upvote_delta, CASE WHEN lead(snapshot_no) OVER o = next_no THEN lead(comments) OVER o - comments END AS next_comment_delta FROM st WINDOW o AS (PARTITION BY community, post_id ORDER BY hours, snapshot_no)) WHERE next_state IS NOT NULL)"
_label = lambda state, u, c: f"CASE WHEN {u} >= surging_upvotes OR {c} >= surging_comments THEN 'surge_watch' WHEN {u} >= alive_upvotes OR {c} >= alive_comments THEN 'active_watch' WHEN {state} = 'dying' THEN 'dying_watch' WHEN {state} = 'cooling' THEN 'cooling_watch' WHEN {state} = 'dead' THEN 'stop_watch' ELSE 'low_watch' END"
_in = lambda c, kinds: f"{c} IN ({', '.join(repr(k) for k in (*kinds, ''))})"
_prec = ", ".join(f"count(*) FILTER ({_in('predicted', k)}) AS predicted_{n}, round(count(*) FILTER ({_in('predicted', k)} AND {_in('actual', k)}) / nullif(count(*) FILTER ({_in('predicted', k)}), 0), 6) AS {n}_precision" for n, k in (("surge", reports.SURGE), ("active", reports.ACTIVE), ("die", reports.DIE)))
query(
    "recommendation_report",
    f"""WITH {NEXT_ROWS_SQL}, m AS (SELECT *, greatest(coalesce(upvote_velocity, 0), 0) * {_MULT.replace('latest_state', 'state')} AS pu, greatest(coalesce(comment_velocity, 0), 0) * {_MULT.replace('latest_state', 'state')} AS pc, greatest(coalesce(next_upvote_delta, 0), 0) AS au, greatest(coalesce(next_comment_delta, 0), 0) AS ac FROM nr),
l AS (SELECT *, {_label('state', 'pu', 'pc')} AS predicted, {_label('next_state', 'au', 'ac')} AS actual FROM m)
SELECT community, count(*) AS n, round(avg(abs(pu - au)), 6) AS upvotes_mae, round(sqrt(avg((pu - au) * (pu - au))), 6) AS upvotes_rmse, round(avg(abs(pc - ac)), 6) AS comments_mae, round(sqrt(avg((pc - ac) * (pc - ac))), 6) AS comments_rmse, round(avg(CAST(predicted = actual AS INT)), 6) AS exact_match, {_prec} FROM l GROUP BY GROUPING SETS ((community), ())""",
)(lambda s, d: rounded(reports.recommendation_report(reports.forecast_labels(with_next(s, d)))))
query(
    "domain_report",
    f"WITH {POSTS_SQL}, {LINKS_SQL} SELECT domain, count(*) AS n_posts, round(median(upvotes), 6) AS median_upvotes, round(avg(upvotes), 6) AS avg_upvotes, round(avg(CAST(state IN ('surging', 'alive') AS INT)), 6) AS alive_rate, round(avg(CAST(state IN ('dead', 'dying') AS INT)), 6) AS dead_rate, count(DISTINCT community) AS n_communities FROM posts p JOIN links l ON l.post_id = p.post_id WHERE coalesce(domain, '') <> '' GROUP BY 1 HAVING count(*) >= 5",
)(lambda s, d: rounded(reports.domain_report(fx.posts(s, d).join(fx.links(s, d), "post_id"))))
query(
    "pair_community_days",
    f"WITH {KEYWORDS_SQL}, x AS (SELECT day_no, community, upvotes, post_id % 40 AS comments, CASE WHEN post_id % 5 > 0 THEN post_id % 17 ELSE 0 END AS velocity, a.w || '+' || b.w AS pair FROM kp, unnest(title_words) a(w), unnest(title_words) b(w) WHERE a.w < b.w) SELECT day_no, pair, community, count(*) AS n_posts, CAST(sum(upvotes) AS BIGINT) AS total_upvotes, max(comments)::DOUBLE AS best_comments, round(avg(comments), 6) AS avg_comments, max(velocity)::DOUBLE AS best_velocity, round(avg(velocity), 6) AS avg_velocity FROM x GROUP BY 1, 2, 3",
)(lambda s, d: rounded(reports.pair_community_days(with_words(s, d).withColumns({"comments": (F.col("post_id") % 40).cast("double"), "velocity": F.when(F.col("post_id") % 5 > 0, (F.col("post_id") % 17).cast("double"))}), "title_words")))
_MOODS = ["total_upvotes", "max_upvotes", "mean_upvotes", "median_upvotes", "top_share", "top3_sentiment", "bottom_sentiment", "early_sentiment", "late_sentiment", "all_sentiment", "weighted_sentiment", "top_level_sentiment", "reply_sentiment", "gini", "sentiment_gap"]
_mean = lambda cond, name: f"coalesce(avg(CASE WHEN {cond} THEN compound END), 0) AS {name}"
query(
    "discussion_moods",
    f"""WITH {COMPOUND_SQL}, r AS (SELECT *, coalesce(upvotes, 0)::DOUBLE AS u, count(*) OVER (PARTITION BY post_id) AS n, row_number() OVER (PARTITION BY post_id ORDER BY coalesce(upvotes, 0) DESC, comment_id) - 1 AS bu, row_number() OVER (PARTITION BY post_id ORDER BY age_minutes, comment_id) - 1 AS ba, row_number() OVER (PARTITION BY post_id ORDER BY coalesce(upvotes, 0)) AS i FROM sc WHERE compound IS NOT NULL),
g AS (SELECT post_id, count(*) AS n_comments, sum(u) AS total_upvotes, max(u) AS max_upvotes, avg(u) AS mean_upvotes, median(u) AS median_upvotes, coalesce(max(u) / nullif(sum(u), 0), 0) AS top_share, {_mean('bu < 3', 'top3_sentiment')}, {_mean('bu >= n // 2', 'bottom_sentiment')}, {_mean('ba < greatest(n // 3, 1)', 'early_sentiment')}, {_mean('ba >= 2 * n // 3', 'late_sentiment')}, avg(compound) AS all_sentiment, sum(compound * wt) / sum(wt) AS weighted_sentiment, {_mean('is_top_level', 'top_level_sentiment')}, {_mean('NOT is_top_level', 'reply_sentiment')},
  CASE WHEN count(*) < 2 OR sum(u) = 0 THEN 0 ELSE (2 * sum(i * u) - (count(*) + 1) * sum(u)) / (count(*) * sum(u)) END AS gini FROM r GROUP BY 1), h AS (SELECT *, top3_sentiment - bottom_sentiment AS sentiment_gap FROM g) SELECT post_id, n_comments, {_r(*_MOODS)} FROM h""",
)(lambda s, d: rounded(reports.discussion_moods(scored_comments(s, d)).select("post_id", "n_comments", *_MOODS)))


def scored_titles(s, d):
    p = fx.posts(s, d)
    return p.join(groups.sentiment(p, s.createDataFrame(list(_LEXICON.items()), "token string, valence double"), "post_id", "title"), "post_id")


_BANDS = "CASE " + " ".join(f"WHEN compound >= {low} THEN '{name}'" for low, name in reversed(reports.SENTIMENT_BANDS)) + " END"
query(
    "sentiment_bands",
    f"""WITH {POSTS_SQL}, tw AS (SELECT post_id, unnest(regexp_extract_all(lower(title), '\\p{{L}}+')) AS token, generate_subscripts(regexp_extract_all(lower(title), '\\p{{L}}+'), 1) AS pos FROM posts), tb AS (SELECT *, lag(token) OVER (PARTITION BY post_id ORDER BY pos) AS before FROM tw),
tm AS (SELECT post_id, sum(CASE WHEN before IN ('not', 'no', 'never') THEN -0.74 * valence ELSE valence END)::DOUBLE AS s FROM tb JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _LEXICON.items())}) l(t, valence) ON l.t = tb.token GROUP BY 1),
ti AS (SELECT p.*, coalesce(s / sqrt(s * s + 15), 0) AS compound FROM posts p LEFT JOIN tm ON tm.post_id = p.post_id) SELECT {_BANDS} AS band, count(*) AS n, round(avg(CAST(state IN ('surging', 'alive') AS INT)), 6) AS alive_rate, round(median(upvotes), 6) AS median_upvotes, round(avg(upvotes), 6) AS avg_upvotes FROM ti GROUP BY 1""",
)(lambda s, d: rounded(reports.sentiment_bands(scored_titles(s, d))))
_LIFT = ["next_upvote_delta", "next_comment_delta", "upvote_velocity", "comment_velocity"]
_OUT = [*_LIFT, *[f"{c}_lift" for c in _LIFT[:2]], *[f"{c}_ratio" for c in _LIFT[:2]], "strong_upvote_share", "strong_comment_share"]
query(
    "growth_lift",
    f"""WITH {NEXT_ROWS_SQL}, {KEYWORDS_SQL}, j AS (SELECT title_words, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in _LIFT)} FROM nr JOIN kp ON kp.post_id = nr.post_id), a AS (SELECT {', '.join(f'avg({c}) AS all_{c}' for c in _LIFT[:2])} FROM j), x AS (SELECT j.*, a.*, unnest(title_words) AS keyword FROM j, a),
g AS (SELECT keyword, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in _LIFT)}, {', '.join(f'avg({c}) - any_value(all_{c}) AS {c}_lift, avg({c}) / nullif(any_value(all_{c}), 0) AS {c}_ratio' for c in _LIFT[:2])}, avg(CAST(next_upvote_delta > all_next_upvote_delta AS INT)) AS strong_upvote_share, avg(CAST(next_comment_delta > all_next_comment_delta AS INT)) AS strong_comment_share FROM x GROUP BY 1 HAVING count(*) >= 25) SELECT keyword, n, {_r(*_OUT)} FROM g""",
)(lambda s, d: rounded(reports.growth_lift(with_next(s, d).join(with_words(s, d).select("post_id", "title_words"), "post_id"), "title_words").select("keyword", "n", *_OUT)))
query("decline_labels", f"WITH {STATE_DAYS_SQL} SELECT day_no, topic, n_posts, yesterday, state, CAST(next_state IN ('cooling', 'dying', 'dead') AS INT) AS declines FROM ts WHERE state IN ('surging', 'growing', 'stable') AND next_state IS NOT NULL")(lambda s, d: reports.declines(topics.topic_states(keyword_days(s, d))))
