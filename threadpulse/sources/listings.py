"""Raw listings of posts and comments to items, CSV tables, the catalog and SQL over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import author_name, clean_text

#: fields of a listing's post and comment that are read; what a document lacks is null
POST = "id string, permalink string, url string, author string, title string, selftext string, selftext_html string, num_comments int, link_flair_text string, score int, upvote_ratio double, is_video boolean, promoted boolean, over_18 boolean, created_utc double, thumbnail string, preview struct<images:array<struct<source:struct<url:string>>>>, media struct<reddit_video:struct<fallback_url:string>>"
COMMENT = "id string, permalink string, parent_id string, author string, body string, created_utc double, score int"
#: Thumbnails that are no pictures, and hosts whose links are no external ones
NO_PICTURE = ("", "self", "default", "nsfw", "spoiler", "image")
OWN_HOSTS = ("www.reddit.com", "reddit.com", "")


def prefixed(prefix: str, c: Column) -> Column:
    """An id with its prefix; blank stays blank."""
    v = F.trim(F.coalesce(c, F.lit("")))
    return F.when(v == "", "").otherwise(F.concat(F.lit(prefix), v))


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC; null is blank. The session's zone must be UTC."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def external_link(url: Column) -> Column:
    """The url where its host is another one, else blank."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(host.isin(*OWN_HOSTS), "").otherwise(url)


def media(post: Column) -> dict[str, Column]:
    """Preview images' urls (those that aren't blank, in order), the video's and the thumbnail's."""
    urls = F.transform(F.coalesce(post["preview"]["images"], F.array().cast("array<struct<source:struct<url:string>>>")), lambda i: F.trim(F.coalesce(i["source"]["url"], F.lit(""))))
    thumb = F.trim(F.coalesce(post["thumbnail"], F.lit("")))
    return {"imageUrls": F.filter(urls, lambda u: u != ""), "videoUrl": F.trim(F.coalesce(post["media"]["reddit_video"]["fallback_url"], F.lit(""))), "thumbnailUrl": F.when(thumb.isin(*NO_PICTURE), "").otherwise(thumb)}


def post_items(listing: DataFrame, json: str, community: str, scraped_at: str, base: str) -> DataFrame:
    """Items of posts from a column of JSON objects, with the community's and the scrape's columns; defaults 0, false and [deleted]."""
    p = F.col("_item")
    text = lambda f: clean_text(p[f])
    parsed = listing.withColumn("_item", F.from_json(json, POST))
    link = F.trim(F.coalesce(p["permalink"], F.lit("")))
    return parsed.select(
        prefixed("t3_", p["id"]).alias("id"), F.trim(F.coalesce(p["id"], F.lit(""))).alias("parsedId"), F.when(link == "", "").otherwise(F.concat(F.lit(base), link)).alias("url"), author_name(p["author"]).alias("username"), text("title").alias("title"), F.concat(F.lit("r/"), F.col(community)).alias("communityName"),
        F.col(community).alias("parsedCommunityName"), text("selftext").alias("body"), text("selftext_html").alias("html"), external_link(F.trim(F.coalesce(p["url"], F.lit("")))).alias("link"), F.coalesce(p["num_comments"], F.lit(0)).alias("numberOfComments"), F.trim(F.coalesce(p["link_flair_text"], F.lit(""))).alias("flair"),
        F.coalesce(p["score"], F.lit(0)).alias("upVotes"), p["upvote_ratio"].alias("upVoteRatio"), F.coalesce(p["is_video"], F.lit(False)).alias("isVideo"), F.coalesce(p["promoted"], F.lit(False)).alias("isAd"), F.coalesce(p["over_18"], F.lit(False)).alias("over18"), *[c.alias(k) for k, c in media(p).items()],
        iso_utc(p["created_utc"]).alias("createdAt"), F.col(scraped_at).alias("scrapedAt"), F.lit("post").alias("dataType"),
    )


def comment_items(listing: DataFrame, json: str, submission: str, community: str, scraped_at: str, base: str) -> DataFrame:
    c = F.col("_item")
    link = F.trim(F.coalesce(c["permalink"], F.lit("")))
    return listing.withColumn("_item", F.from_json(json, COMMENT)).select(
        prefixed("t1_", c["id"]).alias("id"), F.trim(F.coalesce(c["id"], F.lit(""))).alias("parsedId"), F.when(link == "", "").otherwise(F.concat(F.lit(base), link)).alias("url"), prefixed("t3_", F.col(submission)).alias("postId"), F.trim(F.coalesce(c["parent_id"], F.lit(""))).alias("parentId"), author_name(c["author"]).alias("username"),
        F.col(community).alias("category"), F.concat(F.lit("r/"), F.col(community)).alias("communityName"), clean_text(c["body"]).alias("body"), F.coalesce(c["score"], F.lit(0)).alias("upVotes"), F.lit(0).alias("numberOfreplies"), iso_utc(c["created_utc"]).alias("createdAt"), F.col(scraped_at).alias("scrapedAt"), F.lit("comment").alias("dataType"),
    )


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with a header as text columns, cast where they are used; a missing file or column is an error. Quoted fields may span lines."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*columns)


def export_catalog(frames: dict[str, DataFrame], database: str, cluster_by: dict[str, str] | None = None, buckets: int = 64) -> None:
    """Each frame as a table of the database, made anew; those with a key in `cluster_by` are bucketed and sorted by it, so that joins on it need no shuffle."""
    spark = next(iter(frames.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in frames.items():
        w = df.write.mode("overwrite").format("parquet")
        key = (cluster_by or {}).get(name)
        (w.bucketBy(buckets, key).sortBy(key) if key else w).saveAsTable(f"{database}.{name}")


def with_views(frames: dict[str, DataFrame], sql: str) -> DataFrame:
    """The result of Spark SQL over frames by name."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def due_rows(schedule: DataFrame, hour: int) -> DataFrame:
    """Rows of a schedule whose run_hours is * or lists the hour."""
    hours = F.transform(F.split("run_hours", ","), lambda h: F.trim(h))
    return schedule.where((F.trim("run_hours") == "*") | F.array_contains(hours, str(hour)))
