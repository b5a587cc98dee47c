"""Raw snapshots: JSON scans, routing, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, parsedId string, url string, username string, userId string, title string, communityName string, parsedCommunityName string, body string, html string, link string, category string, numberOfComments int, flair string, upVotes int, upVoteRatio double, isVideo boolean, isAd boolean, over18 boolean, videoUrl string, thumbnailUrl string, imageUrls array<string>, createdAt string, scrapedAt string, postId string, parentId string, numberOfreplies int, dataType string"
META = "subreddit string, listing string, top_time string, saved_at string, schedule_name string, cadence_label string, scheduled_hour string, input_file string"


def scan_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of all snapshot files: stem, pos (place in the file's array) and the item's fields. Bad JSON fails the scan; items that are no objects are dropped."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("stem"), "value").where("stem != '' AND stem NOT LIKE '%_metadata'")
    array = F.when(F.ltrim("value", F.lit(" \t\r\n")).startswith("["), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON array: "), "stem")))
    parts = text.select("stem", F.posexplode(F.from_json(array, "array<string>", {"mode": "FAILFAST"})).alias("pos", "json")).where(F.ltrim("json").startswith("{"))
    return parts.select("stem", "pos", F.from_json("json", ITEM).alias("item")).select("stem", "pos", "item.*")


def route(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts with their rank in the snapshot, and comments."""
    from pyspark.sql import Window

    posts = items.where("dataType = 'post'").withColumn("rank_within_snapshot", F.row_number().over(Window.partitionBy("stem").orderBy("pos")))
    return posts, items.where("dataType = 'comment'")


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per <stem>_metadata.json; a bad file has null fields."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_metadata\.json$", 1).alias("stem"), "value").where("stem != ''")
    return text.select("stem", F.from_json("value", META).alias("m")).select("stem", "m.*")


def snapshot_context(posts: DataFrame, metadata: DataFrame) -> DataFrame:
    """stem, community, listing, snapshot_time: from the metadata, else the first post; time also from the file name's YYYYMMDD_HHMMSS prefix."""
    first = posts.groupBy("stem").agg(F.min_by(F.struct("communityName", "scrapedAt"), "pos").alias("f"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    by_name = F.try_to_timestamp(F.nullif(F.regexp_extract("stem", r"^(\d{8}_\d{6})_", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    return first.join(metadata, "stem", "left").select("stem", F.regexp_replace(F.coalesce(blank(F.col("subreddit")), F.col("f.communityName")), "(?i)^r/", "").alias("community"), F.coalesce(blank(F.col("listing")), F.lit("new")).alias("listing"), F.coalesce(F.try_to_timestamp("saved_at"), by_name, F.try_to_timestamp("f.scrapedAt")).alias("snapshot_time"))


def full_context(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row for each stem of items or metadata: community, listing, top_time, listing_type, snapshot_time, schedule fields and numbers of posts and comments.

    Each field falls back by itself: the metadata, then the name of the config file that it cites (reddit_r_<community>_<listing>.json), then, for the community, the first post's parsed
    name, name and category. The time falls back to the file name's YYYYMMDD_HHMMSS_ and then to the first post's scrape. Bad times are null."""
    from ..functions.text import _first_known, community_name, listing_type

    is_post = F.col("dataType") == "post"
    per = items.groupBy("stem").agg(F.min_by(F.struct("parsedCommunityName", "communityName", "category", "scrapedAt"), F.when(is_post, F.col("pos"))).alias("f"), F.count_if(is_post).alias("n_posts"), F.count_if(F.col("dataType") == "comment").alias("n_comments"))
    name = F.element_at(F.split(F.coalesce("input_file", F.lit("")), r"[/\\\\]"), -1)
    part = lambda k: F.nullif(F.regexp_extract(name, r"(?i)reddit_r_(.+)_(new|hot|rising|top_day|top_week)\.json$", k), F.lit(""))
    suffix = F.lower(part(2))
    top = suffix.startswith("top_")
    j = per.join(metadata, "stem", "full")
    names = [F.when(F.trim(c) != "", community_name(c)) for c in (F.col("subreddit"), part(1), F.col("f.parsedCommunityName"), F.col("f.communityName"), F.col("f.category"))]
    listing = F.coalesce(_first_known(F.col("listing"), F.when(top, "top").otherwise(suffix)), F.lit(""))
    period = F.coalesce(_first_known(F.col("top_time"), F.when(top, F.substring(suffix, 5, 10))), F.lit(""))
    by_name = F.try_to_timestamp(F.nullif(F.regexp_extract("stem", r"^(\d{8}_\d{6})_", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return j.select(
        "stem", F.coalesce(_first_known(*names), F.lit("")).alias("community"), listing.alias("listing"), period.alias("top_time"), listing_type(listing, period).alias("listing_type"), F.coalesce(F.try_to_timestamp("saved_at"), by_name, F.try_to_timestamp("f.scrapedAt")).alias("snapshot_time"),
        *[blank(c).alias(c) for c in ("schedule_name", "cadence_label", "scheduled_hour", "input_file")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_posts", "n_comments")],
    )


def flatten_comments(trees: DataFrame, json: str, key: str) -> DataFrame:
    """Comments of nested listing trees, depth first: key, path (places from the root), id, parent_id, body, depth. One explode per level until none is left."""
    from ..sources.tables import materialize

    kids = lambda c: F.from_json(F.get_json_object(c, "$.data.children"), "array<string>")
    now = trees.select(key, F.array().cast("array<int>").alias("path"), F.posexplode(kids(F.col(json))).alias("pos", "node"))
    out = None
    while True:
        now = materialize(now.select(key, F.concat("path", F.array("pos")).alias("path"), "node"))
        if now.isEmpty():
            break
        rows = now.select(key, "path", *[F.get_json_object("node", f"$.data.{f}").alias(f) for f in ("id", "parent_id", "body")], F.size("path").alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        now = now.select(key, "path", F.posexplode(kids(F.get_json_object("node", "$.data.replies"))).alias("pos", "node"))
    return (out if out is not None else now.select(key, "path", *[F.lit(None).cast("string").alias(f) for f in ("id", "parent_id", "body")], F.size("path").alias("depth"))).orderBy(key, "path")
