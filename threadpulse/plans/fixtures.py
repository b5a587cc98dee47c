"""Views that give the test tables the shape of post, comment and snapshot data; SQL and DataFrame forms of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round4(c: Column) -> Column:
    """To 4 places as SQL rounds a double: times 10,000, to the nearest whole number, divided. F.round looks at the decimal digits instead, and a sum that a last bit keeps below a half goes the other way."""
    return F.round(c * 10000.0) / 10000.0


def post_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per 6-hour bucket and user: post (user), community (user mod 5), cumulated value and events as upvotes and comments."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy(((F.dayofmonth("ts") - 1) * 4 + F.floor(F.hour("ts") / 6)).cast("int").alias("snapshot_no"), F.col("user_id").alias("post_id")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("post_id").orderBy("snapshot_no").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("snapshot_no", "post_id", (F.col("post_id") % 5).alias("community"), (F.col("snapshot_no") * 6.0).alias("hours"), _round4(F.sum("v").over(w)).alias("upvotes"), F.sum("n").over(w).cast("double").alias("comments"))


SNAPSHOTS_SQL = """fx AS (SELECT snapshot_no, post_id, post_id % 5 AS community, snapshot_no * 6.0::DOUBLE AS hours,
  round(sum(v) OVER (PARTITION BY post_id ORDER BY snapshot_no), 4) AS upvotes, CAST(sum(n) OVER (PARTITION BY post_id ORDER BY snapshot_no) AS DOUBLE) AS comments
  FROM (SELECT CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6.0) AS INT) AS snapshot_no, user_id AS post_id, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2))"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    q, t = F.col("quality"), F.col("toxic")
    # a title is the first line; the body is the whole text
    state = F.when((q == 1) & (t == 0), "surging").when(q == 1, "alive").when(t == 1, "dead").when(q == 0, "dying").otherwise("cooling")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("post_id"), F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")).alias("community"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 13).alias("day_no"),
        (F.col("doc_id") % 24).alias("created_hour"), F.col("n_chars").alias("upvotes"), F.col("source").alias("author"), F.col("lang").alias("listing"), state.alias("state"),
    )


POSTS_SQL = """posts AS (SELECT d.doc_id AS post_id, 's' || CAST(d.doc_id % 5 AS VARCHAR) AS community, split_part(d.text, chr(10), 1) AS title, d.text AS body, d.doc_id % 13 AS day_no, d.doc_id % 24 AS created_hour,
  d.n_chars AS upvotes, d.source AS author, d.lang AS listing, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'surging' WHEN l.quality = 1 THEN 'alive' WHEN l.toxic = 1 THEN 'dead'
  WHEN l.quality = 0 THEN 'dying' ELSE 'cooling' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("post_id"), F.col("turn").alias("comment_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), F.col("role").alias("author"), F.col("text").alias("body"), (F.length("text") % 50).cast("long").alias("upvotes"))


COMMENTS_SQL = """comments AS (SELECT conv_id AS post_id, turn AS comment_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, role AS author, text AS body, CAST(length(text) % 50 AS BIGINT) AS upvotes FROM conversations)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import link_domain

    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("post_id"), F.col("url").alias("link"), link_domain(F.col("url")).alias("domain"))


LINKS_SQL = r"""links AS (SELECT page_id AS post_id, url AS link, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS domain FROM pages)"""


def comment_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a comment of its user's post in its 6-hour bucket."""
    e = table(spark, sf_dir, "events")
    return e.select(
        ((F.dayofmonth("ts") - 1) * 4 + F.floor(F.hour("ts") / 6)).cast("int").alias("snapshot_no"), F.col("user_id").alias("post_id"), (F.col("user_id") % 5).alias("community"), F.col("event_id").alias("comment_id"), F.col("event_type").alias("author"),
        F.floor("value").cast("double").alias("upvotes"), (F.col("event_id") % 7).alias("replies"), (F.col("event_id") % 3 == 0).cast("int").alias("is_top_level"),
    )


COMMENT_SNAPSHOTS_SQL = """cs AS (SELECT CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6.0) AS INT) AS snapshot_no, user_id AS post_id, user_id % 5 AS community, event_id AS comment_id, event_type AS author, CAST(floor(value) AS DOUBLE) AS upvotes, event_id % 7 AS replies, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS is_top_level FROM events)"""


def placed(states: DataFrame) -> DataFrame:
    """State rows with a listing, which changes every 8 snapshots, and the rank by upvotes within snapshot and community."""
    listing = F.element_at(F.array(*map(F.lit, ("new", "hot", "rising", "top_day"))), ((F.col("post_id") + F.floor(F.col("snapshot_no") / 8)) % 4 + 1).cast("int"))
    return states.withColumn("listing", listing).withColumn("rank", F.row_number().over(Window.partitionBy("community", "snapshot_no").orderBy(F.desc("upvotes"), "post_id")))


PLACED_SQL = """pl AS (SELECT st.*, list_extract(['new', 'hot', 'rising', 'top_day'], CAST((post_id + snapshot_no // 8) % 4 AS INT) + 1) AS listing, row_number() OVER (PARTITION BY community, snapshot_no ORDER BY upvotes DESC, post_id) AS rank FROM st)"""
