"""Queries on sources: listings to items, CSV, SQL over views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..sources import listings, raw, tables
from . import fixtures as fx
from .fixtures import LINKS_SQL, POSTS_SQL
from .registry import _r, query, rounded


def raw_listing(s, d):
    """Posts with their links as JSON objects of a listing, and the community and the time of the scrape beside them."""
    j = fx.posts(s, d).join(fx.links(s, d), "post_id", "left")
    post = F.struct(
        F.col("post_id").cast("string").alias("id"), F.concat(F.lit("/r/x/comments/"), F.col("post_id").cast("string")).alias("permalink"), F.col("link").alias("url"), F.col("author"), F.col("title"), F.col("body").alias("selftext"), F.col("upvotes").cast("int").alias("score"), (F.col("post_id") % 3 == 0).alias("is_video"),
        F.when(F.col("post_id") % 2 == 0, "self").otherwise(F.col("link")).alias("thumbnail"), (F.col("created_hour") * 3600).cast("double").alias("created_utc"), F.struct(F.array(F.struct(F.struct(F.col("link").alias("url")).alias("source")), F.struct(F.struct(F.lit("").alias("url")).alias("source"))).alias("images")).alias("preview"),
    )
    return j.select(F.to_json(post).alias("json"), "community", F.lit("2024-01-31T00:00:00Z").alias("scraped"))


query(
    "listing_items",
    f"""WITH {POSTS_SQL}, {LINKS_SQL}, j AS (SELECT p.*, coalesce(l.link, '') AS link FROM posts p LEFT JOIN links l ON l.post_id = p.post_id)
SELECT 't3_' || post_id AS id, '/r/x/comments/' || post_id AS url, coalesce(nullif(trim(author), ''), '[deleted]') AS username, 'r/' || community AS "communityName", length(trim(title, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS title_chars, link, 0 AS "numberOfComments", CAST(upvotes AS INT) AS "upVotes", post_id % 3 = 0 AS "isVideo", CASE WHEN post_id % 2 = 0 THEN '' ELSE link END AS "thumbnailUrl",
  CASE WHEN link = '' THEN 0 ELSE 1 END AS n_images, '1970-01-01T' || lpad(CAST(created_hour AS VARCHAR), 2, '0') || ':00:00Z' AS "createdAt" FROM j""",
)(lambda s, d: listings.post_items(raw_listing(s, d), "json", "community", "scraped", "").select("id", "url", "username", "communityName", F.length("title").alias("title_chars"), "link", "numberOfComments", "upVotes", "isVideo", "thumbnailUrl", F.size("imageUrls").alias("n_images"), "createdAt"))


def csv_numbers(s, d):
    """Posts through a CSV file in the shared folder and back: text columns, cast on use."""
    path = f"{tables.shared_folder(s)}/csv-{uuid.uuid4().hex}"
    fx.posts(s, d).select("post_id", "community", "title", (F.col("upvotes") / 4).alias("score")).write.options(header=True, escape='"').csv(path)
    t = listings.scan_csv(s, path, ["post_id", "community", "title", "score"])
    return t.select(text.number(F.col("post_id"), whole=True).alias("post_id"), text.community_name(F.col("community")).alias("community"), text.number(F.col("score")).alias("score"), text.number(F.col("score"), whole=True).alias("whole_score"), text.number(F.col("community")).alias("bad"))


query("csv_scan", f"WITH {POSTS_SQL} SELECT post_id, community, {_r('score')}, CAST(floor(score) AS BIGINT) AS whole_score, NULL::DOUBLE AS bad FROM (SELECT *, upvotes / 4 AS score FROM posts)")(lambda s, d: rounded(csv_numbers(s, d)))
_SQL = "SELECT community, state, count(*) AS n, max(upvotes) AS best FROM catalog_posts GROUP BY community, state"
query("sql_surface", f"WITH {POSTS_SQL}, catalog_posts AS (SELECT * FROM posts) {_SQL}")(lambda s, d: listings.with_views({"catalog_posts": fx.posts(s, d)}, _SQL))


def keyed(s, d):
    """Posts with urls, names and ids that miss or contradict each other in turn."""
    k, p = F.col("post_id") % 7, F.col("post_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://www.reddit.com/r/News/comments/"), p, F.lit("/a_title/"))).when(k == 1, F.concat(F.lit("/r/Tech/comments/"), p)).when(k == 2, F.concat(F.lit("https://old.reddit.com/R/Games/Comments/x_"), p, F.lit("/"))).when(k == 3, "").otherwise(F.concat(F.lit("https://example.org/"), p))
    name = F.when(k == 4, F.concat(F.lit(" R/"), F.col("community"))).when(k == 5, " ").when(k == 6, None).otherwise(F.col("community"))
    given = F.when(k == 3, F.concat(F.lit("T3_"), p)).when(k == 4, F.concat(F.lit(" "), p, F.lit(" ")))
    parsed = F.when(k == 6, F.concat(F.lit("t3_"), p)).when(k == 5, "")
    return fx.posts(s, d).select("post_id", url.alias("url"), name.alias("name"), given.alias("given"), parsed.alias("parsed"))


query(
    "post_keys",
    f"""WITH {POSTS_SQL}, k AS (SELECT post_id, post_id % 7 AS k, CAST(post_id AS VARCHAR) AS p, community FROM posts) SELECT post_id, CASE k WHEN 0 THEN 'News' WHEN 1 THEN NULL WHEN 2 THEN 'Games' WHEN 3 THEN community WHEN 4 THEN community END AS community,
  CASE k WHEN 0 THEN 't3_' || p WHEN 1 THEN NULL WHEN 2 THEN 't3_x_' || p WHEN 3 THEN 'T3_' || p WHEN 4 THEN 't3_' || p END AS key, CASE k WHEN 0 THEN 't3_' || p WHEN 2 THEN 't3_x_' || p WHEN 3 THEN 'T3_' || p WHEN 4 THEN 't3_' || p WHEN 6 THEN 't3_' || p END AS chained_id, CASE k WHEN 0 THEN 'News' WHEN 2 THEN 'Games' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE community END AS named,
  CASE k WHEN 3 THEN 't1_T3_' || p WHEN 4 THEN 't1_' || p WHEN 6 THEN 't1_t3_' || p END AS comment_id FROM k""",
)(lambda s, d: keyed(s, d).select("post_id", text.post_key(*map(F.col, ("url", "name", "given", "parsed"))).alias("k"), text.chained_post_id(F.col("given"), F.col("parsed"), F.col("url")).alias("chained_id"), text.post_community(F.col("url"), F.col("name")).alias("named"), text.chained_comment_id(F.col("given"), F.col("parsed")).alias("comment_id")).select("post_id", "k.community", F.col("k.post_id").alias("key"), "chained_id", "named", "comment_id"))


def contexts(s, d):
    """A file for each community and day; metadata, file names, config names and posts' names are there in turn."""
    p = fx.posts(s, d).withColumn("c", F.substring("community", 2, 3).cast("int"))
    stem = F.when(F.col("day_no") % 3 != 0, F.concat(F.lit("202401"), F.lpad((F.col("day_no") + 1).cast("string"), 2, "0"), F.lit("_101500_"), F.col("community"))).otherwise(F.concat(F.lit("file_"), F.col("community"), F.lit("_"), F.col("day_no").cast("string")))
    p = p.withColumn("stem", stem)
    kind = F.when(F.col("post_id") % 4 == 0, "comment").when(F.col("post_id") % 11 == 0, None).otherwise("post")
    items = p.select("stem", F.col("post_id").alias("pos"), kind.alias("dataType"), F.when(F.col("c") == 0, F.concat(F.lit("r/"), F.col("community"))).alias("parsedCommunityName"), F.when(F.col("c") == 1, F.col("community")).alias("communityName"), F.when(F.col("c") < 3, "cat").alias("category"), F.lit("2024-02-01T00:00:00Z").alias("scrapedAt"))
    meta = p.where("c >= 2 OR day_no % 2 = 0").select("stem", "c", "day_no", "community").distinct()
    config = F.concat(F.lit("configs/x/reddit_r_"), F.col("community"), F.element_at(F.array(*map(F.lit, ("_new.json", "_top_day.json", "_hot.json", "_odd.json"))), (F.col("day_no") % 4 + 1).cast("int")))
    meta = meta.select("stem", F.when(F.col("c") == 2, "R/Named").alias("subreddit"), F.when(F.col("c") == 3, " rising ").alias("listing"), F.when(F.col("c") == 4, "week").alias("top_time"), F.when(F.col("day_no") % 5 == 0, "2024-03-01T01:02:03Z").when(F.col("day_no") % 5 == 1, "bad").alias("saved_at"), F.lit("plan ").alias("schedule_name"), F.lit(None).cast("string").alias("cadence_label"), F.lit("7").alias("scheduled_hour"), F.when(F.col("c") != 2, config).alias("input_file"))
    return raw.full_context(items, meta).withColumn("snapshot_time", F.date_format("snapshot_time", "yyyy-MM-dd HH:mm:ss"))


query(
    "snapshot_contexts",
    f"""WITH {POSTS_SQL}, p AS (SELECT *, CAST(substr(community, 2) AS INT) AS c, CASE WHEN day_no % 3 <> 0 THEN '202401' || lpad(CAST(day_no + 1 AS VARCHAR), 2, '0') || '_101500_' || community ELSE 'file_' || community || '_' || CAST(day_no AS VARCHAR) END AS stem, CASE WHEN post_id % 4 = 0 THEN 'comment' WHEN post_id % 11 = 0 THEN NULL ELSE 'post' END AS kind FROM posts),
i AS (SELECT stem, any_value(c) AS c, any_value(day_no) AS day_no, any_value(community) AS community, count(*) FILTER (kind = 'post') AS n_posts, count(*) FILTER (kind = 'comment') AS n_comments FROM p GROUP BY 1),
m AS (SELECT *, c >= 2 OR day_no % 2 = 0 AS has, CASE WHEN c <> 2 THEN 'configs/x/reddit_r_' || community || list_extract(['_new.json', '_top_day.json', '_hot.json', '_odd.json'], CAST(day_no % 4 AS INT) + 1) END AS f, n_posts > 0 AS known FROM i),
n AS (SELECT *, has AND f IS NOT NULL AND day_no % 4 < 3 AS named FROM m),
o AS (SELECT stem, CASE WHEN has AND c = 2 THEN 'Named' WHEN named THEN community WHEN NOT known THEN '' WHEN c <= 1 THEN community WHEN c = 2 THEN 'cat' ELSE '' END AS community, CASE WHEN has AND c = 3 THEN 'rising' WHEN named THEN list_extract(['new', 'top', 'hot'], CAST(day_no % 4 AS INT) + 1) ELSE '' END AS listing,
  CASE WHEN has AND c = 4 THEN 'week' WHEN named AND day_no % 4 = 1 THEN 'day' ELSE '' END AS top_time, CASE WHEN has AND day_no % 5 = 0 THEN '2024-03-01 01:02:03' WHEN day_no % 3 <> 0 THEN '2024-01-' || lpad(CAST(day_no + 1 AS VARCHAR), 2, '0') || ' 10:15:00' WHEN known THEN '2024-02-01 00:00:00' END AS snapshot_time, CASE WHEN has THEN 'plan' ELSE '' END AS schedule_name, '' AS cadence_label, CASE WHEN has THEN '7' ELSE '' END AS scheduled_hour, CASE WHEN has THEN coalesce(f, '') ELSE '' END AS input_file, n_posts, n_comments FROM n)
SELECT *, CASE WHEN listing = 'top' AND top_time <> '' THEN 'top_' || top_time ELSE listing END AS listing_type FROM o""",
)(contexts)

_flag = lambda words: "regexp_matches(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '" + "|".join(w.replace("-", "\\-") for w in words) + "')"
query("content_flags", f"WITH {POSTS_SQL} SELECT post_id, {', '.join(f'{_flag(w)} AS has_{k}_word' for k, w in text.CONTENT_FLAGS.items())} FROM posts")(lambda s, d: fx.posts(s, d).select("post_id", *[c.alias(k) for k, c in text.content_flags(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).items()]))
query("excerpts", f"WITH {POSTS_SQL}, x AS (SELECT post_id, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) AS t FROM posts) SELECT post_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substr(t, 1, 160)) || '...' END AS excerpt FROM x")(lambda s, d: fx.posts(s, d).select("post_id", text.truncate(F.col("body")).alias("excerpt")))
query("listing_types", "SELECT source, lang, CASE WHEN lang = 'en' THEN 'top_' || lower(source) ELSE lower(lang) END AS listing_type, count(*) AS n FROM documents GROUP BY 1, 2")(lambda s, d: fx.table(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("listing_type", text.listing_type(F.when(F.col("lang") == "en", " Top ").otherwise(F.col("lang")), F.col("source"))))
