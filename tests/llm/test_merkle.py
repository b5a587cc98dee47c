"""The manifest against a plain loop over all nodes, at sizes around the tree's runs and bundles."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from threadpulse.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows):
    """All result columns, node by node."""
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by[lang]])
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(by[lang]):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            folded, proof = leaf(r, changed), []
            for levels, at in ((trees[lang], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += run[: at % 8] + run[at % 8 + 1 :]
                    run[at % 8] = folded
                    folded, at = digest("".join(run)), at // 8
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], digest("".join(proof)), folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, idx int, n string, node int"


def check(spark, rows):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.verify_manifest(df).collect()]
    want = plain([dict(zip(names, r)) for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_sizes_around_runs_and_bundles(spark):
    rows = []
    for lang, n in (("a", 1), ("b", 8), ("c", 9), (None, 65), ("d", 512), ("e", 513), ("é", 4097), ("", 2)):
        rows += [(len(rows) + i, f"Text {i} of {lang}", lang, "S", i) for i in range(n)]
    got = check(spark, rows)
    assert 0.2 < sum(not r[-1] for r in got) / len(got) < 0.5


def test_many_langs(spark):
    check(spark, [(i, f"Body {i}", f"l{i % 600}", "s", 1) for i in range(1300)])


@pytest.mark.parametrize("rows", [[(5, "Only", "en", "s", 4)], [(5, "Only", None, None, None), (6, None, None, None, None)]])
def test_small(spark, rows):
    check(spark, rows)


def test_odd_rows(spark):
    long = "Ab ć 🙂" * 40_000
    rows = [(None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (None, None, None, None, None), (3, "", "en", "", 0), (3, "X", "en", "", 0), (3, "X", "en", "", 0), (2**60 + 1, long, "de", "1:2", 7), (-4, long, "de", "-", -1)]
    check(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.verify_manifest(df).collect() == []
