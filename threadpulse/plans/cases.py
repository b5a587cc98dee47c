"""Queries of moods, sentiment summaries, single-run features, case studies and keyword days with quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cases, groups, selection, sentiment, status
from ..sources import tables
from . import fixtures as fx
from .fixtures import COMMENTS_SQL, POSTS_SQL
from .labels import placed
from .now import _LEXICON, COMPOUND_SQL, scored_comments
from .registry import _r, query, rounded, states, STATES_SQL
from .status import FORECAST_SQL, post_status, rounded9

SENTIMENT_SQL = COMPOUND_SQL + """, ps AS (SELECT post_id, count(*) AS comment_count, avg(compound) AS sentiment_mean, sum(compound * wt) / sum(wt) AS sentiment_weighted, avg(CAST(compound > 0.05 AS INT)) AS positive_share, avg(CAST(compound < -0.05 AS INT)) AS negative_share, coalesce(var_samp(compound), 0) AS sentiment_variance, avg(length(body)) AS avg_body_len FROM sc WHERE compound IS NOT NULL GROUP BY 1)"""
LATEST_SQL = "lf AS (SELECT community, post_id, arg_max(state, snapshot_no) AS state, max_by(struct_pack(v := upvote_velocity), snapshot_no).v AS upvote_velocity FROM st GROUP BY 1, 2)"
_MOOD = "CASE " + " ".join(f"WHEN state = '{s}' THEN '{m}'" for s, m in cases.MOODS.items()) + " ELSE 'neutral' END"
MOOD_SQL = f"{STATES_SQL}, {LATEST_SQL}, {SENTIMENT_SQL}, mt AS (SELECT lf.*, ps.* EXCLUDE (post_id), {_MOOD} AS mood FROM lf JOIN ps ON ps.post_id = lf.post_id WHERE coalesce(state, '') <> '')"


def mood(s, d):
    x = states(s, d).groupBy("community", "post_id").agg(F.max_by(F.struct("state", "upvote_velocity"), "snapshot_no").alias("x"))
    return tables.materialize(cases.mood_table(cases.post_sentiment(scored_comments(s, d)), x.select("community", "post_id", "x.*")))


_M = ["sentiment_mean", "sentiment_weighted", "positive_share", "negative_share", "sentiment_variance", "avg_body_len", "upvote_velocity"]
query("mood_table", f"WITH {MOOD_SQL} SELECT community, post_id, state, mood, comment_count, {_r(*_M)} FROM mt")(lambda s, d: rounded(mood(s, d).select("community", "post_id", "state", "mood", "comment_count", *_M)))
_SIDE = lambda c, s: f"avg(CASE WHEN state IN {s} THEN {c} END)"
_ALIVE, _DEAD = "('surging', 'alive')", "('dying', 'dead')"
query(
    "mood_by_state",
    f"WITH {MOOD_SQL}, g AS (SELECT state, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in _M[:5])} FROM mt GROUP BY 1 UNION ALL SELECT 'alive - dead', count(*) FILTER (state IN {_ALIVE} OR state IN {_DEAD}), {', '.join(f'{_SIDE(c, _ALIVE)} - {_SIDE(c, _DEAD)}' for c in _M[:5])} FROM mt HAVING count(*) FILTER (state IN {_ALIVE}) > 0 AND count(*) FILTER (state IN {_DEAD}) > 0) SELECT state, n, {_r(*_M[:5])} FROM g",
)(lambda s, d: rounded(cases.mood_by_state(mood(s, d))))
_OUTLOOK = "CASE " + " ".join([f"WHEN sentiment_weighted > {b} THEN '{t}'" for b, t in cases.ABOVE] + [f"WHEN sentiment_weighted < {b} THEN '{t}'" for b, t in cases.BELOW]) + " ELSE 'NEUTRAL - standard trajectory' END"
query(
    "mood_shortlist",
    f"WITH {MOOD_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY round(coalesce(upvote_velocity, 0), 9) DESC, post_id) AS i FROM mt WHERE state IN ('surging', 'alive', 'emerging')) SELECT post_id, community, state, {_r('upvote_velocity', 'sentiment_weighted')}, {_OUTLOOK} AS outlook, CASE WHEN sentiment_variance > 0.3 THEN 'HIGH CONTROVERSY' WHEN sentiment_variance > 0.15 THEN 'moderate debate' ELSE '' END AS controversy FROM k WHERE i <= 20",
)(lambda s, d: rounded(cases.mood_shortlist(rounded9(mood(s, d)))))


def titles(s, d):
    """Titles' compounds, beside their communities."""
    p = fx.posts(s, d)
    return p.join(groups.sentiment(p, s.createDataFrame(list(_LEXICON.items()), "token string, valence double"), "post_id", "title"), "post_id").select("community", "compound")


query(
    "sentiment_by_community",
    f"""WITH {POSTS_SQL}, {COMPOUND_SQL}, tw AS (SELECT post_id, unnest(regexp_extract_all(lower(title), '\\p{{L}}+')) AS token, generate_subscripts(regexp_extract_all(lower(title), '\\p{{L}}+'), 1) AS pos FROM posts), tb AS (SELECT *, lag(token) OVER (PARTITION BY post_id ORDER BY pos) AS before FROM tw),
tm AS (SELECT post_id, sum(CASE WHEN before IN ('not', 'no', 'never') THEN -0.74 * valence ELSE valence END)::DOUBLE AS s FROM tb JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _LEXICON.items())}) l(t, valence) ON l.t = tb.token GROUP BY 1),
ti AS (SELECT community, coalesce(s / sqrt(s * s + 15), 0) AS compound FROM posts p LEFT JOIN tm ON tm.post_id = p.post_id), co AS (SELECT 's' || CAST((post_id % 7) AS VARCHAR) AS community, compound FROM sc WHERE compound IS NOT NULL),
a AS (SELECT community, count(*) AS n, avg(compound) AS m, avg(CAST(compound <= -0.05 AS INT)) * 100 AS p FROM co GROUP BY 1), b AS (SELECT community, count(*) AS n, avg(compound) AS m, avg(CAST(compound <= -0.05 AS INT)) * 100 AS p FROM ti GROUP BY 1)
SELECT coalesce(a.community, b.community) AS community, coalesce(a.n, 0) AS comment_count, round(a.m, 6) + 0.0 AS comment_avg_sentiment, round(coalesce(a.p, 0), 6) + 0.0 AS comment_negative_pct, coalesce(b.n, 0) AS title_count, round(b.m, 6) + 0.0 AS title_avg_sentiment, round(coalesce(b.p, 0), 6) + 0.0 AS title_negative_pct FROM a FULL JOIN b ON a.community = b.community""",
)(lambda s, d: rounded(cases.sentiment_by_community(scored_comments(s, d).select(F.concat(F.lit("s"), (F.col("post_id") % 7).cast("string")).alias("community"), "compound"), titles(s, d))))


def single_run(s, d):
    """Conversations as posts of one scrape: a turn each 20 minutes from 10 minutes before the post was made."""
    c = fx.comments(s, d).withColumn("created", (F.col("comment_id") * 1200 - 600 + F.col("post_id") * 10).cast("long"))
    p = c.groupBy("post_id").agg(F.max("author").alias("author"), F.count(F.lit(1)).alias("n"))
    p = p.select("post_id", "author", (F.col("post_id") * 10).cast("long").alias("created"), (F.col("post_id") * 10 + 90_000).cast("long").alias("scraped"), F.when(F.col("post_id") % 6 != 0, F.col("n") + F.col("post_id") % 4).otherwise(0).cast("long").alias("number_of_comments"))
    return tables.materialize(p), tables.materialize(c.where("post_id % 9 != 0"))


query(
    "single_run_features",
    f"""WITH RECURSIVE {COMMENTS_SQL}, ca AS (SELECT *, comment_id * 1200 - 600 + post_id * 10 AS created FROM comments), po AS (SELECT post_id, max(author) AS author, post_id * 10 AS created, CASE WHEN post_id % 6 <> 0 THEN count(*) + post_id % 4 ELSE 0 END AS number_of_comments FROM ca GROUP BY post_id), cb AS (SELECT * FROM ca WHERE post_id % 9 <> 0),
dp AS (SELECT post_id, comment_id, 1 AS depth FROM cb WHERE parent_id IS NULL UNION ALL SELECT c.post_id, c.comment_id, dp.depth + 1 FROM cb c JOIN dp ON c.post_id = dp.post_id AND c.parent_id = dp.comment_id),
x AS (SELECT cb.*, dp.depth, po.author AS op, CASE WHEN cb.created >= po.created THEN cb.created - po.created END AS delay FROM cb JOIN po ON po.post_id = cb.post_id LEFT JOIN dp ON dp.post_id = cb.post_id AND dp.comment_id = cb.comment_id),
g AS (SELECT post_id, count(*) AS n, count(*) FILTER (parent_id IS NULL) AS t, count(*) FILTER (parent_id IS NOT NULL) AS r, count(*) FILTER (author = op) AS a, count(DISTINCT author) AS u, avg(upvotes) AS m, median(upvotes) AS md, max(depth) AS dm, min(delay) AS fd, count(*) FILTER (delay <= 3600) AS h, count(*) FILTER (delay <= 86400) AS dd FROM x GROUP BY 1)
SELECT po.post_id, po.author, po.number_of_comments, coalesce(n, 0) AS scraped_comment_count, coalesce(t, 0) AS top_level_comment_count, coalesce(r, 0) AS reply_comment_count, coalesce(a, 0) AS author_reply_count, coalesce(u, 0) AS unique_commenter_count, round(m, 6) AS avg_comment_upvotes, round(md, 6) AS median_comment_upvotes,
  coalesce(dm, 0) AS max_comment_depth, fd AS first_comment_delay, coalesce(h, 0) AS first_hour_comment_count, coalesce(dd, 0) AS first_day_comment_count, 25.0::DOUBLE AS hours_until_scrape, round(coalesce(n, 0) / nullif(number_of_comments, 0), 6) AS scraped_comment_coverage FROM po LEFT JOIN g ON g.post_id = po.post_id""",
)(lambda s, d: rounded(cases.single_run_features(*single_run(s, d))))

_CASE = ["latest_state", "recommendation", "die_soon_label"]


def studies(s, d):
    f = rounded9(status.forecast(post_status(s, d))).select("community", "post_id", *_CASE, "forecast_priority")
    chosen = selection.choose_cases(f, [F.desc("forecast_priority"), F.asc("post_id")], 5, "community", "post_id")
    return cases.case_studies(tables.materialize(chosen).drop("forecast_priority"), placed(s, d), fx.comment_snapshots(s, d), ["community", "post_id"])


query(
    "case_studies",
    f"""WITH {FORECAST_SQL}, o AS (SELECT community, post_id, {', '.join(_CASE[:2])}, CASE WHEN die_soon >= 0.65 THEN 'likely_to_die_soon' ELSE 'likely_to_continue' END AS die_soon_label, row_number() OVER (ORDER BY round(forecast_priority, 9) DESC, post_id) AS a, row_number() OVER (PARTITION BY community ORDER BY round(forecast_priority, 9) DESC, post_id) AS b FROM f2),
ch AS (SELECT *, CASE WHEN a <= 5 THEN 'overall' ELSE 'group' END AS why FROM o WHERE a <= 5 OR b = 1),
tl AS (SELECT pl.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY pl.community, pl.post_id) AS n, lag(listing) OVER w AS before FROM pl SEMI JOIN ch ON ch.community = pl.community AND ch.post_id = pl.post_id WINDOW w AS (PARTITION BY pl.community, pl.post_id ORDER BY hours, snapshot_no)),
tg AS (SELECT community, post_id, count(*) AS n_snapshots, max(CASE WHEN i = 1 THEN upvotes END) AS first_upvotes, max(CASE WHEN i = 1 THEN comments END) AS first_comments, max(CASE WHEN i = n THEN upvotes END) AS last_upvotes, max(CASE WHEN i = n THEN comments END) AS last_comments,
  string_agg(CASE WHEN i > n - 3 THEN 'u=' || CAST(CAST(trunc(upvotes) AS BIGINT) AS VARCHAR) || ' c=' || CAST(CAST(trunc(comments) AS BIGINT) AS VARCHAR) || ' state=' || state END, ' | ' ORDER BY i) AS recent, string_agg(CASE WHEN before IS NULL OR before <> listing THEN listing END, ' -> ' ORDER BY i) AS listing_path FROM tl GROUP BY 1, 2),
cq AS (SELECT CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6.0) AS INT) AS snapshot_no, user_id AS post_id, user_id % 5 AS community, event_id AS comment_id, CAST(floor(value) AS DOUBLE) AS upvotes, event_id % 7 AS replies FROM events),
crx AS (SELECT *, row_number() OVER (PARTITION BY community, post_id ORDER BY upvotes DESC, replies DESC, comment_id) AS k FROM (SELECT * FROM cq QUALIFY snapshot_no = max(snapshot_no) OVER (PARTITION BY community, post_id))),
ctx AS (SELECT community, post_id, count(*) AS n_latest_comments, max(CASE WHEN k = 1 THEN comment_id END) AS top_comment_1, max(CASE WHEN k = 2 THEN comment_id END) AS top_comment_2 FROM crx GROUP BY 1, 2)
SELECT ch.community, ch.post_id, {', '.join(_CASE)}, why, coalesce(n_snapshots, 0) AS n_snapshots, {_r('first_upvotes', 'first_comments', 'last_upvotes', 'last_comments')}, recent, listing_path, coalesce(n_latest_comments, 0) AS n_latest_comments, top_comment_1, top_comment_2 FROM ch LEFT JOIN tg ON tg.community = ch.community AND tg.post_id = ch.post_id LEFT JOIN ctx ON ctx.community = ch.community AND ctx.post_id = ch.post_id""",
)(lambda s, d: rounded(studies(s, d)))

_QUALITY_STOP = text.COMMON


def quality_days(s, d):
    p = fx.posts(s, d).withColumn("keys", text.tokens(F.col("title"), least=4, stop=_QUALITY_STOP)).withColumn("velocity", (F.col("upvotes") % 5).cast("double"))
    return cases.keyword_quality_days(p, "keys", cases.comment_quality(scored_comments(s, d)))


_Q = ["surge_rate", "alive_rate", "dead_rate", "avg_gini", "avg_sentiment", "avg_velocity", "avg_neg_share"]
query(
    "keyword_quality_days",
    f"""WITH {POSTS_SQL}, {COMPOUND_SQL}, gi AS (SELECT post_id, CASE WHEN count(*) < 2 OR sum(upvotes) = 0 THEN 0 ELSE (2.0 * sum(i * upvotes) - (count(*) + 1) * sum(upvotes)) / (count(*) * sum(upvotes)) END AS gini FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY upvotes) AS i FROM cm) GROUP BY 1),
qu AS (SELECT sc.post_id, any_value(gini) AS gini, sum(coalesce(compound, 0) * greatest(1.0, coalesce(upvotes, 0))) / greatest(1.0, sum(greatest(1.0, coalesce(upvotes, 0)))) AS sentiment, avg(CAST(coalesce(compound, 0) < -0.05 AS INT)) AS neg_share FROM sc JOIN gi ON gi.post_id = sc.post_id GROUP BY 1),
kw AS (SELECT p.*, p.upvotes % 5 AS velocity, qu.gini, qu.sentiment, qu.neg_share, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in text.COMMON)}], w)))) AS topic FROM posts p LEFT JOIN qu ON qu.post_id = p.post_id),
g AS (SELECT day_no, topic, count(*) AS n_posts, CAST(sum(upvotes) AS BIGINT) AS total_upvotes, avg(CAST(state = 'surging' AS INT)) AS surge_rate, avg(CAST(state IN ('surging', 'alive') AS INT)) AS alive_rate, avg(CAST(state IN ('dead', 'dying') AS INT)) AS dead_rate, coalesce(avg(gini), 0) AS avg_gini, coalesce(avg(sentiment), 0) AS avg_sentiment, coalesce(avg(nullif(velocity, 0)), 0) AS avg_velocity, coalesce(avg(neg_share), 0) AS avg_neg_share FROM kw GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT day_no, topic, n_posts, total_upvotes, {_r(*_Q)} FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS c FROM g) WHERE c >= 5""",
)(lambda s, d: rounded(quality_days(s, d)))

query("sentiment_labels", f"WITH {COMPOUND_SQL} SELECT post_id, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n FROM sc WHERE compound IS NOT NULL GROUP BY 1, 2")(lambda s, d: scored_comments(s, d).where("compound IS NOT NULL").groupBy("post_id", text.sentiment_label(F.col("compound")).alias("label")).agg(F.count(F.lit(1)).alias("n")))

_RULES = {"boosters": {"and": 0.293, "that": 0.293, "or": -0.293}, "negators": ("was", "he"), "contrast": "on"}
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_B = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _RULES["boosters"].items()) + " END"
_NEG = ", ".join(f"'{w}'" for w in _RULES["negators"])


def _step(v: str, d: int, fade: float) -> str:
    up = f"(CASE WHEN {v} < 0 THEN -{_B.format(f'w{d}')} ELSE {_B.format(f'w{d}')} END + CASE WHEN mixed AND c{d} THEN CASE WHEN {v} > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END)"
    return f"(({v} + coalesce({up} * {fade}, 0)) * CASE WHEN w{d} IN ({_NEG}) THEN -0.74 ELSE 1.0 END)"


query(
    "sentiment_rules",
    f"""WITH {COMMENTS_SQL}, r0 AS (SELECT post_id, comment_id, body, list_transform(list_filter(regexp_split_to_array(coalesce(body, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), lambda w: CASE WHEN length(regexp_replace(w, '{_EDGES}', '', 'g')) <= 2 THEN w ELSE regexp_replace(w, '{_EDGES}', '', 'g') END) AS ws FROM comments),
r1 AS (SELECT *, list_transform(ws, lambda w: lower(w)) AS low, list_transform(ws, lambda w: w = upper(w) AND w <> lower(w)) AS cap FROM r0),
r2 AS (SELECT *, len(list_filter(cap, lambda c: c)) AS nc, coalesce(list_position(low, 'on'), 0) AS turn, least(length(coalesce(body, '')) - length(replace(coalesce(body, ''), '!', '')), 4) * 0.292 AS ex, length(coalesce(body, '')) - length(replace(coalesce(body, ''), '?', '')) AS q FROM r1),
r3 AS (SELECT post_id, comment_id, turn, nc > 0 AND nc < len(ws) AS mixed, ex + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * 0.18 ELSE 0.96 END AS e, i, low[i] AS token, cap[i] AS c, {', '.join(f'CASE WHEN i > {d} THEN low[i - {d}] END AS w{d}, CASE WHEN i > {d} THEN cap[i - {d}] END AS c{d}' for d in (1, 2, 3))} FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM r2)),
r4 AS (SELECT r3.*, valence + CASE WHEN mixed AND c THEN sign(valence) * 0.733 ELSE 0 END AS v0 FROM r3 JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _LEXICON.items())}) l(t, valence) ON l.t = r3.token),
r5 AS (SELECT *, {_step('v0', 1, 1.0)} AS v1 FROM r4), r6 AS (SELECT *, {_step('v1', 2, 0.95)} AS v2 FROM r5), r7 AS (SELECT *, {_step('v2', 3, 0.9)} AS v3 FROM r6),
r8 AS (SELECT post_id, comment_id, count(*) AS n_hits, any_value(e) AS e, sum(v3 * CASE WHEN turn = 0 THEN 1.0 WHEN i < turn THEN 0.5 WHEN i > turn THEN 1.5 ELSE 1.0 END)::DOUBLE AS s FROM r7 GROUP BY 1, 2), r9 AS (SELECT *, s + sign(s) * e AS z FROM r8)
SELECT c.post_id, c.comment_id, round(coalesce(z / sqrt(z * z + 15), 0), 6) + 0.0 AS compound, coalesce(n_hits, 0) AS n_hits FROM comments c LEFT JOIN r9 ON r9.post_id = c.post_id AND r9.comment_id = c.comment_id""",
)(lambda s, d: rounded(sentiment.rule_scores(fx.comments(s, d).withColumn("k", F.concat_ws(":", "post_id", "comment_id")), s.createDataFrame(list(_LEXICON.items()), "token string, valence double"), "k", "body", **_RULES).select(F.split("k", ":")[0].cast("long").alias("post_id"), F.split("k", ":")[1].cast("long").alias("comment_id"), "compound", "n_hits")))
