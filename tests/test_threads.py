"""Threads deeper than any fixed number of levels."""

import json

from threadpulse.operators import groups
from threadpulse.sources import raw


def test_thread_depth_of_long_replies_and_circles(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(300)] + [(2, 0, None), (2, 1, 2), (2, 2, 1), (2, 3, 9)]
    got = {(r.post_id, r.comment_id): r.depth for r in groups.thread_depth(spark.createDataFrame(rows, "post_id long, comment_id long, parent_id long")).collect()}
    assert got == {(1, k): k + 1 for k in range(300)} | {(2, 0): 1, (2, 1): None, (2, 2): None, (2, 3): None}


def test_flatten_comments_below_64_levels(spark):
    node = ""
    for k in range(70, 0, -1):
        node = {"data": {"children": [{"data": {"id": f"c{k}", "parent_id": f"c{k - 1}", "body": "x", "replies": node}}]}}
    out = raw.flatten_comments(spark.createDataFrame([(1, json.dumps(node))], "k long, j string"), "j", "k").collect()
    assert [(r.id, r.depth) for r in out] == [(f"c{k}", k) for k in range(1, 71)]
