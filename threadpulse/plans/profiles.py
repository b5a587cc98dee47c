"""Queries on curves, sequences, training rows, keyword and title profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.states import age_bucket
from ..operators import groups, profiles, status
from ..sources import tables
from . import fixtures as fx
from .fixtures import COMMENTS_SQL, LINKS_SQL, PLACED_SQL, POSTS_SQL
from .labels import placed
from .registry import _r, _words, DAYS_SQL, keyword_days, KEYWORDS_SQL, neighbours, NEIGHBOURS_SQL, query, rounded, states, STATES_SQL, with_words
from .status import post_status, STATUS_SQL

_CURVE = "CASE " + " ".join(f"WHEN age_minutes / 60 <= {u} THEN '{n}'" for u, n in ((0.5, "0-30m"), (1, "30m-1h"), (2, "1-2h"), (3, "2-3h"), (4, "3-4h"), (6, "4-6h"), (8, "6-8h"), (12, "8-12h"), (18, "12-18h"), (24, "18-24h"), (36, "24-36h"), (48, "36-48h"), (72, "48-72h"))) + " END"
for _name, _by in (("upvote_curve", "community"), ("state_curve", "state")):
    query(_name, f"WITH {STATES_SQL} SELECT {_by}, {_CURVE} AS age_bucket, count(*) AS n, round(median(upvotes), 6) AS median_upvotes, round(avg(upvotes), 6) AS avg_upvotes FROM st WHERE age_minutes / 60 <= 72 GROUP BY 1, 2")(lambda s, d, by=_by: rounded(profiles.upvote_curve(states(s, d), by)))
query(
    "span_velocities",
    f"""WITH {STATES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY community, post_id ORDER BY age_minutes, snapshot_no) - 1 AS k, count(*) OVER (PARTITION BY community, post_id) AS n FROM st)
SELECT community, post_id, max(n) AS n, round((last(upvotes ORDER BY k) - first(upvotes ORDER BY k)) / ((max(age_minutes) - min(age_minutes)) / 60), 6) + 0.0 AS velocity, max(CASE WHEN k = n // 2 THEN snapshot_no END) AS midpoint, round(max(CASE WHEN k = n // 2 THEN upvotes END), 6) AS midpoint_upvotes FROM w GROUP BY 1, 2 HAVING max(n) >= 2 AND (max(age_minutes) - min(age_minutes)) / 60 >= 0.1""",
)(lambda s, d: rounded(profiles.span_velocities(states(s, d))))
query(
    "early_growth",
    f"""WITH {STATES_SQL}, p AS (SELECT community, post_id, first(upvotes ORDER BY hours, snapshot_no) AS f, first(upvotes ORDER BY hours, snapshot_no) FILTER (age_minutes >= 30) AS t, last(state ORDER BY hours, snapshot_no) AS state FROM st GROUP BY 1, 2)
SELECT CASE WHEN t - f >= 500 THEN '500+' WHEN t - f >= 100 THEN '100-500' WHEN t - f >= 50 THEN '50-100' WHEN t - f >= 10 THEN '10-50' ELSE '0-10' END AS band, state, count(*) AS n FROM p WHERE t IS NOT NULL GROUP BY 1, 2""",
)(lambda s, d: profiles.early_growth(states(s, d)))
query(
    "community_direction",
    f"""WITH {STATES_SQL}, h AS (SELECT community, snapshot_no, avg(upvotes) AS v FROM st GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY snapshot_no) - 1 AS i, count(*) OVER (PARTITION BY community) AS n FROM h), g AS (SELECT community, max(n) AS n, regr_slope(v, i) AS s, avg(v) AS m, avg(v) FILTER (i >= n - 5) AS l FROM w GROUP BY 1)
SELECT community, n, round(CASE WHEN n >= 3 THEN s ELSE 0 END, 6) + 0.0 AS slope, round(m, 6) AS mean, round(CASE WHEN n >= 7 AND m <> 0 THEN (l - m) / abs(m) ELSE 0 END, 6) + 0.0 AS momentum FROM g""",
)(lambda s, d: rounded(profiles.community_direction(states(s, d).groupBy("community", "snapshot_no").agg(F.avg("upvotes").alias("v")), "v")))
query(
    "sequence_profiles",
    f"""WITH {NEIGHBOURS_SQL}, w AS (SELECT *, hours % 24 < 6 AS night, row_number() OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no) = 1 AS f FROM nb), x AS (SELECT *, CASE WHEN NOT f AND hours_since_previous <> 0 THEN hours_since_previous END AS gap FROM w),
g AS (SELECT community, post_id, count(*) AS length, max(hours) - min(hours) AS span, bool_or(night AND f) AS fn, count(*) FILTER (night) AS night_snapshots, count(*) FILTER (NOT night) AS day_snapshots, count(*) FILTER (night AND NOT f) AS ln, median(gap) AS median_gap, max(gap) AS max_gap, count(gap) AS gaps, count(*) FILTER (gap < 0.75 OR gap > 1.5) AS irregular_gaps, count(*) FILTER (gap > 2.5) AS large_gaps,
  max(upvotes) AS max_upvotes, max(comments) AS max_comments, max(upvote_velocity) AS max_upvote_velocity, max(comment_velocity) AS max_comment_velocity FROM x GROUP BY 1, 2)
SELECT community, post_id, length, {_r('span')}, night_snapshots, day_snapshots, round(night_snapshots / length, 6) + 0.0 AS night_share, CAST(fn AND day_snapshots > 0 AS INT) AS carried_to_day, CAST(NOT fn AND ln > 0 AS INT) AS carried_to_night, {_r('median_gap', 'max_gap')}, irregular_gaps, large_gaps, round((gaps - irregular_gaps) / nullif(gaps, 0), 6) + 0.0 AS regular_gap_share, {_r('max_upvotes', 'max_comments', 'max_upvote_velocity', 'max_comment_velocity')} FROM g""",
)(lambda s, d: rounded(profiles.sequence_profiles(neighbours(s, d))))
_in = lambda c, *s: f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN {c} IN ({', '.join(repr(x) for x in s)}, '') THEN 1 ELSE 0 END END"
_PRED = ["hours_since_first", "previous_velocity", "velocity_change", "ratio_to_prior_peak", "next_upvotes_per_hour", "next_comments_per_hour", "progress"]
query(
    "prediction_rows",
    f"""WITH {STATES_SQL}, {PLACED_SQL}, w AS (SELECT *, lead(snapshot_no) OVER o = next_no AS isn, lead(state) OVER o AS ns, lead(upvotes) OVER o AS nu, lead(comments) OVER o AS nc, row_number() OVER o AS position, row_number() OVER o / count(*) OVER (PARTITION BY community, post_id) AS progress, hours - min(hours) OVER (PARTITION BY community, post_id) AS hours_since_first, lag(upvote_velocity) OVER o AS previous_velocity,
  upvote_velocity - lag(upvote_velocity) OVER o AS velocity_change, upvote_velocity / nullif(max(upvote_velocity) OVER (PARTITION BY community, post_id ORDER BY hours, snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ratio_to_prior_peak, lag(rank) OVER o - rank AS rank_change, CASE WHEN coalesce(lag(listing) OVER o, listing) <> listing THEN 1 ELSE 0 END AS listing_changed, lag(state) OVER o AS previous_state
  FROM pl WINDOW o AS (PARTITION BY community, post_id ORDER BY hours, snapshot_no)), x AS (SELECT *, CASE WHEN isn THEN ns END AS next_state, CASE WHEN isn THEN (nu - upvotes) / nullif(hours_to_next, 0) END AS next_upvotes_per_hour, CASE WHEN isn THEN (nc - comments) / nullif(hours_to_next, 0) END AS next_comments_per_hour, CAST(CAST(hours AS INT) % 24 < 6 AS INT) AS is_night FROM w)
SELECT community, post_id, snapshot_no, position, rank_change, listing_changed, previous_state, is_night, next_state, {_in('next_state', 'surging', 'alive', 'emerging')} AS next_is_alive, {_in('next_state', 'surging')} AS next_is_surging, {_in('next_state', 'dying', 'dead')} AS next_is_dying, still_visible_next AS next_is_visible, {_r(*_PRED)} FROM x""",
)(lambda s, d: rounded(profiles.prediction_rows(placed(s, d)).select("community", "post_id", "snapshot_no", "position", "rank_change", "listing_changed", "previous_state", "is_night", "next_state", "next_is_alive", "next_is_surging", "next_is_dying", "next_is_visible", *_PRED)))
query("chronological_split", f"WITH {NEIGHBOURS_SQL}, r AS (SELECT community, post_id, snapshot_no, row_number() OVER (ORDER BY snapshot_no, post_id) AS k, floor(count(*) OVER () * 0.8) AS c FROM nb) SELECT community, post_id, snapshot_no, CASE WHEN k <= c THEN 'train' ELSE 'test' END AS split FROM r")(lambda s, d: profiles.chronological_split(fx.post_snapshots(s, d).select("community", "post_id", "snapshot_no"), "snapshot_no", "post_id"))
query(
    "standard_spec",
    f"""WITH {STATES_SQL}, {PLACED_SQL}, c AS (SELECT 'state' AS feature, state AS value, count(*) AS n FROM pl GROUP BY 2 UNION ALL SELECT 'listing', listing, count(*) FROM pl GROUP BY 2), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS place FROM c)
SELECT feature, 'category' AS kind, value, CAST(place AS INT) AS place, NULL::DOUBLE AS mean, NULL::DOUBLE AS deviation FROM k WHERE place <= 12 UNION ALL """
    + " UNION ALL ".join(f"SELECT '{c}', 'number', NULL, NULL, round(avg(coalesce({c}, 0)), 5), round(CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, 0)) END, 5) FROM pl" for c in ("upvotes", "upvote_velocity", "age_minutes")),
)(lambda s, d: rounded(profiles.standard_spec(placed(s, d), ["upvotes", "upvote_velocity", "age_minutes"], ["state", "listing"]).withColumns({"mean": F.round("mean", 5), "deviation": F.round("deviation", 5)})))
_ST = ["popularity", "attention", "engagement", "max_upvotes", "snapshot_count"]
query("status_by_state", f"WITH {STATUS_SQL} SELECT latest_state, count(*) AS n, {', '.join(f'round(avg({c}), 6) + 0.0 AS avg_{c}' for c in _ST)} FROM s3 GROUP BY 1")(lambda s, d: rounded(profiles.mean_by(post_status(s, d), "latest_state", _ST)))
query("group_ratios", f"WITH {STATUS_SQL}, x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (latest_state IN ('surging', 'alive')) AS y, avg({c}) FILTER (latest_state NOT IN ('surging', 'alive')) AS n FROM s3" for c in _ST) + ") SELECT feature, round(y, 6) + 0.0 AS mean_yes, round(n, 6) + 0.0 AS mean_no, round(y / nullif(n, 0), 6) + 0.0 AS ratio FROM x")(lambda s, d: rounded(profiles.group_ratios(post_status(s, d).withColumn("flag", F.col("latest_state").isin("surging", "alive")), "flag", _ST)))
_AGEB = "CASE WHEN age_minutes < 60 THEN '0-1h' WHEN age_minutes < 180 THEN '1-3h' WHEN age_minutes < 360 THEN '3-6h' WHEN age_minutes < 720 THEN '6-12h' WHEN age_minutes < 1440 THEN '12-24h' WHEN age_minutes < 2880 THEN '24-48h' ELSE '48h+' END"
_VELB = "CASE WHEN coalesce(upvote_velocity, 0) >= surging_upvotes THEN 'high' WHEN coalesce(upvote_velocity, 0) >= alive_upvotes THEN 'med' ELSE 'low' END"
query("markov_buckets", f"WITH {STATES_SQL}, t AS (SELECT a.community, {_AGEB.replace('age_minutes', 'a.age_minutes')} AS age_bucket, CASE WHEN coalesce(a.upvote_velocity, 0) >= a.surging_upvotes THEN 'high' WHEN coalesce(a.upvote_velocity, 0) >= a.alive_upvotes THEN 'med' ELSE 'low' END AS velocity_bucket, a.state, b.state AS next_state FROM st a JOIN st b ON b.community = a.community AND b.post_id = a.post_id AND b.snapshot_no = a.next_no), n AS (SELECT community, age_bucket, velocity_bucket, state, next_state, count(*) AS n FROM t GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY community, age_bucket, velocity_bucket, state) AS BIGINT) AS support FROM n")(
    lambda s, d: profiles.bucketed_transitions(states(s, d), age_bucket(F.col("age_minutes")), scores.velocity_bucket(F.col("upvote_velocity"), F.col("alive_upvotes"), F.col("surging_upvotes")))
)
query("initial_states", f"WITH {STATES_SQL}, e AS (SELECT community, state, count(*) AS n FROM st WHERE age_minutes <= 720 GROUP BY 1, 2), o AS (SELECT *, sum(n) OVER (PARTITION BY community) AS t FROM e) SELECT community, state, round(n / t, 6) AS p, 'community' AS source FROM o WHERE t >= 8 UNION ALL SELECT c.community, w.state, round(w.p, 6), 'all' FROM (SELECT DISTINCT community FROM st WHERE community NOT IN (SELECT community FROM o WHERE t >= 8)) c CROSS JOIN (SELECT state, sum(n) / (SELECT sum(n) FROM e) AS p FROM e GROUP BY 1) w")(lambda s, d: rounded(profiles.initial_states(states(s, d), 720.0, 8)))
query("active_rates", f"WITH {STATES_SQL} SELECT community, round(coalesce(avg(CASE WHEN state IN ('surging', 'alive', 'emerging') THEN 1.0 ELSE 0.0 END), 0.6), 6) + 0.0 AS active_rate, round(coalesce(avg(upvotes), 100), 6) AS avg_upvotes, round(coalesce(avg(upvote_velocity), 2), 6) AS avg_velocity FROM st GROUP BY 1")(lambda s, d: rounded(states(s, d).groupBy("community").agg(F.coalesce(F.avg(F.col("state").isin("surging", "alive", "emerging").cast("double")), F.lit(0.6)).alias("active_rate"), F.coalesce(F.avg("upvotes"), F.lit(100.0)).alias("avg_upvotes"), F.coalesce(F.avg("upvote_velocity"), F.lit(2.0)).alias("avg_velocity"))))

_TOPICS = "(VALUES " + ", ".join(f"('{t}', [{', '.join(repr(k) for k in words)}])" for t, words in text.TOPICS.items()) + ") tk(topic, words)"
query(
    "primary_topics",
    f"""WITH {POSTS_SQL}, sc AS (SELECT p.post_id, tk.topic, len(list_filter(tk.words, lambda w: contains(lower(trim(p.body)), w))) AS n FROM posts p CROSS JOIN {_TOPICS}), b AS (SELECT post_id, first(topic ORDER BY n DESC, topic) AS topic, max(n) AS n FROM sc GROUP BY 1)
SELECT p.post_id, CASE WHEN coalesce(trim(p.body), '') = '' THEN 'unknown' WHEN b.n = 0 THEN 'general' ELSE b.topic END AS topic FROM posts p JOIN b ON b.post_id = p.post_id""",
)(lambda s, d: fx.posts(s, d).select("post_id", text.primary_topic(F.col("body")).alias("topic")))
query(
    "story_keys",
    f"""WITH {POSTS_SQL}, {LINKS_SQL}, j AS (SELECT p.post_id, coalesce(l.link, '') AS link, trim(regexp_replace(lower(p.title), '[^a-z0-9]+', ' ', 'g')) AS k FROM posts p LEFT JOIN links l ON l.post_id = p.post_id)
SELECT post_id, CASE WHEN link <> '' THEN 'external_link' WHEN k <> '' THEN 'title' ELSE 'post_id' END AS type, CASE WHEN link <> '' THEN lower(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1)) || rtrim(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') WHEN k <> '' THEN k ELSE CAST(post_id AS VARCHAR) END AS key FROM j""",
)(lambda s, d: fx.posts(s, d).join(fx.links(s, d), "post_id", "left").select("post_id", text.story_key(F.col("link"), F.col("title"), F.col("post_id")).alias("k")).select("post_id", "k.type", "k.key"))
_any = lambda words: "regexp_matches(t, '" + "|".join(words) + "')"
_wd = lambda words: f"list_has_any(string_split_regex(t, '\\s+'), [{', '.join(repr(w) for w in words)}])"
query(
    "title_style",
    f"""WITH {POSTS_SQL}, x AS (SELECT post_id, title, lower(trim(title)) AS t, list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '') AS ws FROM posts) SELECT post_id, contains(title, '?') AS is_question, regexp_matches(title, '[0-9]') AS has_number, regexp_matches(title, '["''‘“]') AS has_quote, {_any(text.BREAKING)} AS is_breaking, contains(title, ':') AS has_colon,
  {_any(text.OPINION)} AS is_opinion, {_wd(text.NEGATIVE_WORDS)} AS has_negative_word, {_wd(text.POSITIVE_WORDS)} AS has_positive_word, {_any(text.SHOCK)} AS has_shock_word, len(ws) AS word_count, length(title) AS char_count, len(list_filter(ws, lambda w: length(w) > 1 AND regexp_matches(w, '\\p{{Lu}}') AND upper(w) = w)) AS all_caps_words FROM x""",
)(lambda s, d: fx.posts(s, d).select("post_id", *[c.alias(k) for k, c in text.title_style(F.col("title")).items()]))
query("length_bands", f"WITH {POSTS_SQL} SELECT CASE WHEN length(title) < 50 THEN 'Short (<50 chars)' WHEN length(title) < 80 THEN 'Medium (50-80)' WHEN length(title) < 120 THEN 'Long (80-120)' ELSE 'Very long (120+)' END AS band, count(*) AS n, round(avg(CASE WHEN state IN ('surging', 'alive') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS alive_rate, round(median(upvotes), 6) AS median_upvotes, round(avg(upvotes), 6) AS avg_upvotes FROM posts WHERE length(title) < 300 GROUP BY 1")(lambda s, d: rounded(profiles.length_bands(fx.posts(s, d))))
query("event_clock", "SELECT hour(ts) AS utc_hour, isodow(ts) - 1 AS utc_weekday, CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_night, count(*) AS n FROM events GROUP BY 1, 2, 3")(lambda s, d: fx.table(s, d, "events").select(*[c.alias(k) for k, c in text.clock(F.col("ts")).items()]).groupBy("utc_hour", "utc_weekday", "is_night").agg(F.count(F.lit(1)).alias("n")))
query("similarity_keys", f"WITH {POSTS_SQL}, x AS (SELECT post_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM posts) SELECT post_id, regexp_replace(regexp_replace(regexp_replace(k, '^breaking ', ''), '^update ', ''), '^megathread ', '') AS key FROM x")(lambda s, d: fx.posts(s, d).select("post_id", text.similarity_key(F.col("title")).alias("key")))


def discussion(s, d):
    """Gini and number of comments of each post that has any."""
    g = groups.gini(fx.comments(s, d), "post_id", "upvotes")
    return g.select("post_id", F.col("gini"), F.col("n").alias("n_comments"))


_KP = ["surging_rate", "alive_rate", "dead_rate", "top_share", "top3_share", "best_to_worst", "best_gini", "high_gini_share", "avg_gini", "author_ratio"]
query(
    "keyword_profiles",
    f"""WITH {KEYWORDS_SQL}, {COMMENTS_SQL}, gi AS (SELECT post_id, count(*) AS n_comments, CASE WHEN count(*) < 2 OR sum(upvotes) = 0 THEN 0 ELSE (2.0 * sum(i * upvotes) - (count(*) + 1) * sum(upvotes)) / (count(*) * sum(upvotes)) END AS gini FROM (SELECT post_id, upvotes, row_number() OVER (PARTITION BY post_id ORDER BY upvotes) AS i FROM comments) GROUP BY 1),
lg AS (SELECT kp.day_no, kp.community, kp.post_id, kp.upvotes, kp.state, kp.author, kp.created_hour, topic, n_comments, gini, row_number() OVER (PARTITION BY kp.day_no, topic ORDER BY kp.upvotes DESC) AS k FROM (SELECT *, unnest(words) AS topic FROM kp) kp LEFT JOIN gi ON gi.post_id = kp.post_id),
pe AS (SELECT day_no, topic, count(*) AS n, CAST(sum(upvotes) AS BIGINT) AS total, count(DISTINCT community) AS n_communities, avg(CASE WHEN state = 'surging' THEN 1.0 ELSE 0 END) AS surging_rate, avg(CASE WHEN state IN ('surging', 'alive') THEN 1.0 ELSE 0 END) AS alive_rate, avg(CASE WHEN state IN ('dead', 'dying') THEN 1.0 ELSE 0 END) AS dead_rate, max(upvotes) AS hi, min(upvotes) AS lo, sum(upvotes) FILTER (k <= 3) AS s3,
  count(DISTINCT author) AS n_authors, max(created_hour) - min(created_hour) AS hour_spread, coalesce(max(n_comments), 0) AS best_comments, max(coalesce(gini, 0)) AS best_gini, max(CASE WHEN state = 'surging' THEN 1 ELSE 0 END) AS any_surging, coalesce(avg(CASE WHEN gini > 0.5 THEN 1.0 ELSE 0 END) FILTER (n_comments > 0), 0) AS high_gini_share, coalesce(avg(gini) FILTER (n_comments > 0), 0) AS avg_gini FROM lg GROUP BY 1, 2),
dx AS (SELECT *, dense_rank() OVER (ORDER BY day_no) - 1 AS day_idx FROM pe), w AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY day_idx) - 1 AS days_before, coalesce(max(n) OVER (PARTITION BY topic ORDER BY day_idx RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS future_peak FROM dx),
z AS (SELECT *, hi / greatest(total, 1) AS top_share, CASE WHEN n >= 3 THEN s3 / greatest(total, 1) ELSE 1.0 END AS top3_share, CAST(CASE WHEN lo > 0 THEN hi / lo ELSE hi END AS DOUBLE) AS best_to_worst, n_authors / n AS author_ratio FROM w WHERE n BETWEEN 2 AND 15 AND day_idx + 3 <= (SELECT max(day_idx) FROM dx))
SELECT day_no, topic, n AS n_posts, total AS total_upvotes, n_communities, days_before, hi AS best_upvotes, best_comments, any_surging, n_authors, hour_spread, CASE WHEN hour_spread <= 2 AND n >= 2 THEN 1 ELSE 0 END AS concentrated, future_peak, future_peak > n * 1.5 AS grows, {_r(*_KP)} FROM z""",
)(lambda s, d: rounded(profiles.keyword_profiles(with_words(s, d), "words", discussion(s, d), 2, 15)))
query(
    "title_diversity",
    f"""WITH {KEYWORDS_SQL}, lg AS (SELECT day_no, post_id, title_words AS w, unnest(words) AS topic FROM kp), f AS (SELECT day_no, topic, count(*) AS n FROM lg GROUP BY 1, 2 HAVING count(*) >= 2), l2 AS (SELECT lg.*, f.n FROM lg JOIN f ON f.day_no = lg.day_no AND f.topic = lg.topic),
p AS (SELECT a.day_no, a.topic, len(list_intersect(a.w, b.w)) AS x, len(list_distinct(list_concat(a.w, b.w))) AS y FROM l2 a JOIN l2 b ON a.day_no = b.day_no AND a.topic = b.topic AND a.post_id < b.post_id)
SELECT f.day_no, f.topic, f.n AS n_posts, round(coalesce((SELECT sum(1 - x / y) FROM p WHERE p.day_no = f.day_no AND p.topic = f.topic AND y > 0), 0) / greatest((SELECT count(*) FROM p WHERE p.day_no = f.day_no AND p.topic = f.topic AND y > 0), 1), 6) + 0.0 AS diversity FROM f""",
)(lambda s, d: rounded(profiles.title_diversity(with_words(s, d), "words", "title_words")))
_LIFT = ["upvotes", "parent_upvotes", "parent_alive"]
query(
    "comment_keyword_lift",
    f"""WITH {POSTS_SQL}, {COMMENTS_SQL}, j AS (SELECT c.body, c.upvotes, p.upvotes AS parent_upvotes, CASE WHEN p.state IN ('surging', 'alive') THEN 1.0 ELSE 0.0 END AS parent_alive FROM comments c JOIN posts p ON p.post_id = c.post_id WHERE trim(coalesce(c.body, '')) NOT IN ('', '[deleted]', '[removed]')), a AS (SELECT {', '.join(f'avg({c}) AS all_{c}' for c in _LIFT)} FROM j),
g AS (SELECT word, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in _LIFT)} FROM (SELECT *, unnest({_words('body')}) AS word FROM j) GROUP BY 1 HAVING count(*) >= 3) SELECT word, n, {_r(*_LIFT)}, {', '.join(f'round({c} - all_{c}, 6) + 0.0 AS lift_{c}' for c in _LIFT)} FROM g, a""",
)(lambda s, d: rounded(profiles.comment_keyword_lift(fx.comments(s, d), fx.posts(s, d), text.tokens(F.col("body")), 3)))
query("best_worst_keywords", f"WITH {DAYS_SQL}, k AS (SELECT topic, CAST(sum(total_upvotes) AS BIGINT) AS upvotes FROM days GROUP BY 1) (SELECT 'best' AS side, topic, upvotes FROM k ORDER BY upvotes DESC, topic LIMIT 20) UNION ALL (SELECT 'worst', topic, upvotes FROM k ORDER BY upvotes, topic LIMIT 20)")(lambda s, d: profiles.best_and_worst(tables.materialize(keyword_days(s, d).groupBy("topic").agg(F.sum("total_upvotes").alias("upvotes"))), "topic", "upvotes", 20))
query("first_topics", f"WITH {KEYWORDS_SQL} SELECT list_min(words) AS topic, state, count(*) AS n FROM kp WHERE len(words) > 0 GROUP BY 1, 2")(lambda s, d: profiles.first_topic(with_words(s, d), "words").groupBy("topic", "state").agg(F.count(F.lit(1)).alias("n")))
query("post_days", "WITH e AS (SELECT user_id AS post_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT post_id, CAST(day AS VARCHAR) AS day, event_id FROM e WHERE k = 1")(lambda s, d: fx.table(s, d, "events").groupBy(F.col("user_id").alias("post_id"), F.to_date("ts").cast("string").alias("day")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")))
query("distinct_authors", f"WITH {POSTS_SQL} SELECT DISTINCT community, author, listing FROM posts")(lambda s, d: fx.posts(s, d).select("community", "author", "listing").distinct())
