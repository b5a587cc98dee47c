"""Snapshot files, listings, CSV and catalog on small files."""

import json

import pytest
from pyspark.sql import functions as F

from threadpulse.sources import listings, raw


def test_snapshot_files(spark, tmp_path):
    items = [{"dataType": "post", "id": "t3_a", "communityName": "r/News", "scrapedAt": "2024-01-01T10:00:00Z", "isAd": True, "html": "h"}, "junk", {"dataType": "comment", "id": "t1_b", "category": "c"}, {"dataType": "post", "id": "t3_c"}]
    (tmp_path / "20240101_100500_x.json").write_text(json.dumps(items))
    (tmp_path / "20240101_110500_y.json").write_text(json.dumps([{"dataType": "post", "id": "t3_d", "communityName": "r/other"}]))
    (tmp_path / "20240101_110500_y_metadata.json").write_text(json.dumps({"subreddit": "R/Tech", "listing": "hot", "saved_at": "2024-01-01T11:06:00Z"}))
    posts, comments = raw.route(raw.scan_items(spark, str(tmp_path)))
    got = {r.id: (r.stem, r.rank_within_snapshot, r.isAd, r.html) for r in posts.collect()}
    assert got == {"t3_a": ("20240101_100500_x", 1, True, "h"), "t3_c": ("20240101_100500_x", 2, None, None), "t3_d": ("20240101_110500_y", 1, None, None)}
    assert [r.category for r in comments.collect()] == ["c"]
    context = {r.stem[9:15]: (r.community, r.listing, str(r.snapshot_time)) for r in raw.snapshot_context(posts, raw.scan_metadata(spark, str(tmp_path))).collect()}
    assert context == {"100500": ("News", "new", "2024-01-01 10:05:00"), "110500": ("Tech", "hot", "2024-01-01 11:06:00")}


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": ')
    with pytest.raises(Exception):
        raw.scan_items(spark, str(tmp_path)).collect()


def test_listing_items(spark):
    post = {"id": "ab", "permalink": "/r/x/comments/ab", "url": "https://example.org/p", "author": " ", "title": " A &amp;amp; B ", "score": 5, "created_utc": 0, "thumbnail": "self", "preview": {"images": [{"source": {"url": "i1"}}, {"source": {}}, {"source": {"url": "i2"}}]}, "media": {"reddit_video": {"fallback_url": "v"}}}
    rows = [(json.dumps(post), "x", "t"), (json.dumps({"url": "https://www.reddit.com/r/x", "thumbnail": "http://t"}), "x", "t")]
    a, b = listings.post_items(spark.createDataFrame(rows, "j string, c string, s string"), "j", "c", "s", "https://base").collect()
    assert (a.id, a.url, a.username, a.title, a.link, a.upVotes, a.numberOfComments, a.createdAt, a.imageUrls, a.videoUrl, a.thumbnailUrl) == ("t3_ab", "https://base/r/x/comments/ab", "[deleted]", "A & B", "https://example.org/p", 5, 0, "1970-01-01T00:00:00Z", ["i1", "i2"], "v", "")
    assert (b.id, b.url, b.link, b.isVideo, b.thumbnailUrl, b.createdAt, b.imageUrls) == ("", "", "", False, "http://t", "", [])
    c = listings.comment_items(spark.createDataFrame([(json.dumps({"id": "z", "parent_id": "t3_ab", "body": "x &lt; y"}), "ab", "x", "t")], "j string, p string, c string, s string"), "j", "p", "c", "s", "").first()
    assert (c.id, c.postId, c.parentId, c.body, c.upVotes, c.username) == ("t1_z", "t3_ab", "t3_ab", "x < y", 0, "[deleted]")


def test_csv_and_schedule(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"two\nlines, ""quoted"""\n ,x\n')
    got = [tuple(r) for r in listings.scan_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()]
    assert got == [("1", 'two\nlines, "quoted"'), (" ", "x")]
    with pytest.raises(ValueError):
        listings.scan_csv(spark, str(tmp_path / "a.csv"), ["c"])
    with pytest.raises(Exception):
        listings.scan_csv(spark, str(tmp_path / "none.csv"), ["a"])
    plan = spark.createDataFrame([("all", "*"), ("some", "1, 13"), ("other", "3,11")], "name string, run_hours string")
    assert {r.name for r in listings.due_rows(plan, 1).collect()} == {"all", "some"}


def test_export_and_sql(spark):
    frames = {"export_a": spark.range(10).withColumn("k", F.col("id") % 3), "export_b": spark.range(3).withColumnRenamed("id", "k")}
    listings.export_catalog(frames, "threadpulse_test", {"export_a": "k", "export_b": "k"}, 4)
    n = spark.sql("SELECT count(*) AS n FROM threadpulse_test.export_a a JOIN threadpulse_test.export_b b USING (k)").first().n
    assert n == 10
    assert listings.with_views({"v": spark.range(4)}, "SELECT sum(id) AS s FROM v").first().s == 6
    spark.sql("DROP DATABASE threadpulse_test CASCADE")
