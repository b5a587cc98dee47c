"""Suffix arrays against sorting, and the removal of repeats against a dictionary of all strings of 100 bytes."""

import hashlib
import random
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadpulse.llm import suffixes

N = suffixes.LENGTH


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.integers(1, 4))
def test_suffix_places(symbols, times):
    s = [*symbols * times, 0]
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert np.argsort(suffixes.suffix_places(np.array(s, np.int64))).tolist() == want


def test_repeated_windows():
    rng = random.Random(3)
    parts = [bytes(rng.choices(b"ab", k=30)) for _ in range(6)]
    segments = [b"".join(rng.choices(parts, k=5)) for _ in range(60)] + [b"a" * 150, b"a" * 160]
    keys = list(range(len(segments)))
    rng.shuffle(keys)
    size = np.array([len(x) for x in segments])
    got = suffixes.repeated_windows(np.frombuffer(b"".join(segments), np.uint8), size, np.array(keys) << 32)
    seen, want = {}, np.zeros(len(got), bool)
    at = np.cumsum(size) - size
    for i in sorted(range(len(segments)), key=keys.__getitem__):
        for p in range(len(segments[i]) - N + 1):
            w = segments[i][p : p + N]
            want[at[i] + p] = w in seen
            seen[w] = True
    assert (got == want).all() and want.any()


def plain(rows):
    """Result columns; of equal rows any may be the first."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, int.from_bytes(hashlib.sha256((r[1] or "").encode()).digest()[:8], "little", signed=True)))
    seen, out = set(), []
    for doc_id, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - N + 1):
            w = raw[i : i + N]
            if w in seen:
                gone[i : i + N] = b"\1" * N
            seen.add(w)
        out.append((doc_id, len(raw), sum(gone), sum(k for k, _ in groupby(gone)), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def check(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, chunk int, keys string").repartition(parts)
    got = [tuple(r) for r in suffixes.remove_repeats(df, **options).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    return got


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrd", k=rng.randint(2, 7))) for _ in range(n))


def corpus(rng, n):
    """Fresh prose, shared passages, near and exact copies, periodic texts, common lines before and behind fresh text."""
    passages = [words(rng, rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            text = rng.choice(rows)[1]
            k = rng.randrange(len(text) + 1)
            text = text[:k] + words(rng, 2) + text[k + rng.randrange(20) :]
        elif kind == 2:
            text = ("".join(rng.choices("ab", k=rng.randint(1, 9))) * 200)[: rng.randint(90, 500)]
        else:
            text = words(rng, rng.randint(0, 40)) + rng.choice(["", passages[0], passages[1], *passages]) + words(rng, rng.randint(0, 40)) + rng.choice(["", passages[0]])
        rows.append((i * 3 % n, text))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 2000}, {"chunk_bytes": 3000, "hot": 3}, {"chunk_bytes": 1500, "hot": 0, "shard_bytes": 500}])
def test_corpus(spark, options):
    got = check(spark, corpus(random.Random(11), 150), **options)
    assert sum(r[2] for r in got) > 10_000


def test_shared_slices(spark, monkeypatch):
    """Texts longer than a slice of hashed windows, whose repeats lie over the slices' border."""
    rng = random.Random(5)
    long = words(rng, 260_000)
    assert len(long) > suffixes.SLICE + 10_000
    check(spark, [(1, long), (2, long[suffixes.SLICE - 5000 :]), (3, "é" + long[100:2_000])])


def test_odd_rows(spark):
    rng = random.Random(8)
    a, b = words(rng, 60), "ü🙂" * 80
    check(spark, [(5, a), (5, a), (5, b), (5, b + a), (None, a), (None, a[:99]), (None, None), (2, ""), (2**60 + 1, a[10:130]), (-3, b), (7, a[:100]), (8, "x" * 99), (9, "x" * 100), (10, "y" * 5000)])


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
