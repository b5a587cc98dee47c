"""Streaming forms: files are ingested once, sessions and interval joins give the batch answer."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadpulse.streaming import ingest, state


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_files_are_ingested_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    first = spark.range(5)
    first.write.parquet(src)
    for _ in range(2):
        ingest.ingest(spark, src, first.schema, out, ck)
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    ingest.ingest(spark, src, first.schema, out, ck, lambda df: df.where("id != 6"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 7]


def test_silence_windows(spark):
    e = spark.createDataFrame([("a", at(1)), ("a", at(2)), ("a", at(9)), ("b", at(3))], "k string, ts timestamp")
    got = {(r.k, r.start, r.end, r.n) for r in ingest.silence_windows(e, "k").collect()}
    assert got == {("a", at(1), at(4), 2), ("a", at(9), at(11), 1), ("b", at(3), at(5), 1)}


def test_sliding_repeats(spark):
    rows = spark.createDataFrame([("x", 1, at(1)), ("x", 2, at(1, 12)), ("y", 3, at(1)), ("x", 4, at(3))], "key string, id long, ts timestamp")
    got = sorted((r.id, r.id1) for r in ingest.sliding_repeats(rows, rows).collect())
    assert got == [(2, 1)]


def test_with_previous_equals_the_batch_form_over_two_runs(spark, tmp_path):
    schema = "community string, post_id long, snapshot_time timestamp, upvotes double"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    a = [("x", 1, at(1), 5.0), ("x", 1, at(1, 2), 9.0), ("x", 2, at(1), None), ("y", 1, at(1), 1.0)]
    b = [("x", 1, at(1, 4), 8.0), ("x", 2, at(1, 4), 3.0), ("y", 7, at(1, 4), 2.0)]
    for rows in (a, b):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(spark, src, spark.createDataFrame([], schema).schema, out, ck, state.with_previous)
    w = Window.partitionBy("community", "post_id").orderBy("snapshot_time")
    want = spark.createDataFrame(a + b, schema).select("*", F.lag("upvotes").over(w).alias("p"), ((F.unix_micros("snapshot_time") - F.unix_micros(F.lag("snapshot_time").over(w))) / 3.6e9).alias("h"))
    want = {(r.community, r.post_id, r.snapshot_time, r.upvotes, r.p, None if None in (r.upvotes, r.p) else (r.upvotes - r.p) / r.h) for r in want.collect()}
    got = {(r.community, r.post_id, r.snapshot_time, r.upvotes, r.previous_upvotes, r.upvote_velocity) for r in spark.read.parquet(out).collect()}
    assert got == want


def test_prediction_cohort_carries_admits_and_expires(spark, tmp_path):
    schema = "community string, post_id long, created timestamp, seen timestamp, upvotes double"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    batches = [
        [("x", 1, at(1), at(1, 1), 5.0), ("x", 2, at(1), at(1, 1), 9.0), ("x", 3, at(1), at(1, 1), 7.0), ("y", 4, at(1), at(1, 1), 1.0)],
        [("x", 1, at(1), at(1, 3), 50.0), ("x", 2, at(1), at(1, 3), 11.0), ("y", 5, at(1, 2), at(1, 3), 1.0), ("y", 6, at(1, 2), at(1, 3), 0.0)],
        [("x", 8, at(2, 1), at(2, 2), 1.0), ("y", 9, at(1, 20), at(2, 2), 1.0)],
    ]
    want = [{2: 9.0, 3: 7.0, 4: 1.0}, {2: 11.0, 3: 7.0, 4: 1.0, 5: 1.0}, {5: 1.0, 8: 1.0}]
    for rows, members in zip(batches, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        state.prediction_cohort(spark, stream, out, ck, [F.col("upvotes").desc(), F.col("post_id")], 2)
        assert {r.post_id: r.upvotes for r in state.cohort(spark, out).collect()} == members
