"""The LSH forest against all pairs: recall of links near the threshold, crowded nodes, several texts under one id."""

import random
from collections import defaultdict

import pytest

from threadpulse.llm import jaccard

SCHEMA = "doc_id long, text string"


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def links_of(rows, threshold=0.8):
    sets, links = sets_of(rows), defaultdict(set)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b), links[b].add(a)
    return links


def changed(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.random()}"
    return out


def test_recall_of_links_between_080_and_090(spark):
    """400 pairs whose index lies in that range and 100 below: of the former at least 0.999 are linked, of the latter none."""
    rng, rows = random.Random(4), []
    while len(rows) < 1000:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 400))]
        n = len(words)
        other = changed(words, max(1, round(n * rng.uniform(0.01, 0.028))), rng)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    sets = sets_of(rows)
    true = {k for k in range(0, len(rows), 2) if 0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.9}
    below = {k for k in range(0, len(rows), 2) if len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.8}
    got = {r.doc_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.n_links}
    assert len(true) > 150 and len(below) > 50
    assert len(true & got) >= 0.999 * len(true) - 1 and not below & got


@pytest.mark.parametrize("crowd", [8, 10_000])
def test_crowded_nodes_lose_no_link(spark, monkeypatch, crowd):
    """A tight cluster, a looser one and loners: the same links whether full-depth nodes are searched first or not."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    texts = [changed(base, 1, rng) for _ in range(70)] + [changed(base, rng.randrange(1, 9), rng) for _ in range(30)] + [[f"l{rng.random()}" for _ in range(60)] for _ in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    links = links_of(rows)
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(abs(got[i].n_links - len(links[i])) for i, _ in rows) <= 0.001 * sum(map(len, links.values()))


def test_complete_sets_stop_descending():
    """The estimate: many close links make a set complete at full depth, a few don't."""
    unseen = 1 / jaccard.chance(0.8, jaccard.DEPTH) - 1
    missed = lambda n, s: n * (1 / jaccard.chance(s, jaccard.DEPTH) - 1)
    done = lambda n, s: missed(n, s) + unseen <= (1 - jaccard.RECALL) * (n + missed(n, s) + unseen)
    assert done(1000, 0.97) and not done(50, 0.97) and not done(100_000, 0.85)
    assert jaccard.prefix_depth() == 4 and jaccard.chance(0.8, 4) >= jaccard.RECALL


def test_keep_one_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, a), (None, a), (3, ""), (4, None), (4, None), (2**60 + 1, c), (5, b + " more")]
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, a), (None, a), (3, ""), (4, None), (2**60 + 1, c)], key=repr)
