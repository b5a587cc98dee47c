"""Queries of baselines, regressions, classifiers and picks; registered by the registry. Fitted models are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners
from ..sources import tables
from .registry import PEAK_SQL, STATES_SQL, growth_frame, keyword_days, query, rounded, states, with_words


def latest(s, d):
    return learners.latest_status(states(s, d))


def hourly(s, d):
    """States with the growth until the next snapshot and an age bucket."""
    nxt = F.when(F.col("hours_to_next") > 0, F.lead("upvotes").over(learners_window()) - F.col("upvotes"))
    return states(s, d).withColumn("gain", nxt).withColumn("bucket", F.when(F.col("age_minutes") < 1440, "day 1").when(F.col("age_minutes") < 2880, "day 2").otherwise("later"))


def learners_window():
    from pyspark.sql import Window

    return Window.partitionBy("community", "post_id").orderBy("snapshot_no")


LATEST_SQL = STATES_SQL + """, latest AS (SELECT community, post_id, count(*) OVER p AS snapshot_count, max(hours) OVER p - min(hours) OVER p AS observed_hours, state, upvotes, coalesce(upvote_velocity, 0) AS upvote_velocity
  FROM st WINDOW p AS (PARTITION BY community, post_id) QUALIFY row_number() OVER (PARTITION BY community, post_id ORDER BY snapshot_no DESC) = 1)"""

query(
    "example_posts",
    f"WITH {LATEST_SQL} SELECT community, post_id, snapshot_count, round(observed_hours, 6) AS observed_hours, round(upvotes, 6) AS upvotes FROM latest WHERE state = 'dead' AND snapshot_count >= 2 QUALIFY row_number() OVER (PARTITION BY community ORDER BY snapshot_count DESC, observed_hours DESC, upvotes DESC, post_id) = 1",
)(lambda s, d: rounded(learners.example_of_each(latest(s, d), "dead", 2)))
query(
    "leading_example",
    f"WITH {LATEST_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY upvotes DESC, post_id) AS place FROM latest) SELECT community, post_id, snapshot_count, state, round(upvotes, 6) AS upvotes FROM r ORDER BY CASE WHEN snapshot_count < 5 THEN 1 ELSE 0 END, upvotes DESC, snapshot_count DESC, post_id LIMIT 1",
)(lambda s, d: rounded(learners.leading_example(latest(s, d).withColumn("rank", -F.col("upvotes")), "rank", 5).select("community", "post_id", "snapshot_count", "state", "upvotes")))
query(
    "active_shortlist",
    f"WITH {LATEST_SQL} SELECT community, post_id, state, round(upvote_velocity, 6) AS upvote_velocity FROM latest WHERE state IN ('surging', 'alive', 'emerging') ORDER BY latest.upvote_velocity DESC, post_id LIMIT 15",
)(lambda s, d: rounded(learners.shortlist(latest(s, d), ("surging", "alive", "emerging"), 15).select("community", "post_id", "state", "upvote_velocity")))
query(
    "naive_baseline",
    f"""WITH {STATES_SQL} SELECT community, post_id, snapshot_no, round(greatest(0, coalesce(upvote_velocity, 0) * coalesce(hours_to_next, 1)), 6) AS upvotes_next, round(greatest(0, coalesce(comment_velocity, 0) * coalesce(hours_to_next, 1)), 6) AS comments_next,
  CAST(state IN ('alive', 'surging', 'emerging', 'cooling') AS INT) AS alive_next, CAST(state = 'surging' AS INT) AS surging_next, CAST(state IN ('cooling', 'dead') AS INT) AS cooling_or_dead_next,
  CAST(coalesce(upvote_velocity, 0) >= coalesce(alive_upvotes, 0) AS INT) AS high_upvote_growth_next, CAST(coalesce(comment_velocity, 0) >= coalesce(alive_comments, 0) AS INT) AS high_comment_growth_next FROM st""",
)(lambda s, d: rounded(learners.naive_next(states(s, d))))
query(
    "confidence_filter",
    f"""WITH {PEAK_SQL}, c AS (SELECT unnest([0.3, 0.5, 0.9])::DOUBLE AS cut), g AS (SELECT cut, count(CASE WHEN alive_rate > cut THEN 1 END) AS flagged, count(CASE WHEN alive_rate > cut AND y = 1 THEN 1 END) AS correct, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS p FROM fp, c GROUP BY 1)
SELECT cut, flagged, round(flagged / n, 6) AS share, correct, flagged - correct AS wrong, round(correct / nullif(flagged, 0), 6) AS precision, round(correct / greatest(p, 1), 6) AS recall FROM g""",
)(lambda s, d: rounded(learners.confidence_filter(growth_frame(s, d), "alive_rate", "y", (0.3, 0.5, 0.9))))

NUMBERS = ["upvotes", "comments", "upvote_velocity", "comment_velocity", "age_minutes", "hours_to_next"]
TOPIC_NUMBERS = ["n_posts", "n_communities", "alive_rate"]


def _split(df, at, cut):
    return df.where(F.col(at) < cut), df.where(F.col(at) >= cut)


def _gains(s, d):
    return _split(tables.materialize(hourly(s, d).where("gain IS NOT NULL")), "snapshot_no", 16)


def _topics(s, d):
    return _split(tables.materialize(growth_frame(s, d)), "day_no", 8)


query("ridge_by_bucket")(lambda s, d: rounded(learners.ridge_by_bucket(*_gains(s, d), "gain", NUMBERS, "bucket").select("community", "post_id", "snapshot_no", "bucket", "gain", "predicted")))
query("robust_by_segment")(lambda s, d: rounded(learners.robust_by_segment(tables.materialize(hourly(s, d).where("gain IS NOT NULL")), "gain", NUMBERS, "community")))
query("tree_regression")(lambda s, d: rounded(learners.tree_regression(*_gains(s, d), "gain", NUMBERS)[0].select("community", "post_id", "snapshot_no", "gain", "predicted")))
query("feature_importance")(lambda s, d: rounded(learners.tree_regression(*_gains(s, d), "gain", NUMBERS)[1]))
query("state_classifier")(lambda s, d: rounded(learners.class_scores(*(x.withColumn("y", (F.col("state") == "surging").cast("int")) for x in _gains(s, d)), "y", NUMBERS).select("community", "post_id", "snapshot_no", "y", "score")))
query("model_comparison")(lambda s, d: rounded(learners.compare_models({"emergence": (*_topics(s, d), "y")}, TOPIC_NUMBERS)))
query("hyperparameter_search")(lambda s, d: rounded(learners.search(*_topics(s, d), "y", TOPIC_NUMBERS, "tree", {"maxDepth": [3, 6], "minInstancesPerNode": [1, 20]})))
query("k_fold")(lambda s, d: rounded(learners.k_fold(tables.materialize(growth_frame(s, d)), "y", TOPIC_NUMBERS, "topic")))
query("log_linear")(lambda s, d: rounded(learners.log_linear(keyword_days(s, d), "total_upvotes", ["n_posts", "best_upvotes", "n_communities"])))
#: vocabulary, weights and centres each read the words, so they are taken from the texts once
query("cluster_words")(lambda s, d: rounded(learners.cluster_words(tables.materialize(with_words(s, d).select("words")), "words")))
query("recursive_forecast")(lambda s, d: rounded(learners.recursive_forecast(tables.materialize(keyword_days(s, d)), "topic", "day_no", "n_posts")))
