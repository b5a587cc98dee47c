"""Alignment against a loop over tokens and byte offsets, with the libraries' plain calls; the merge against a counter."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadpulse.llm import alignment
from threadpulse.llm.queries import piece_model_path, tokenizer_path


@pytest.fixture(scope="module")
def libs():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=piece_model_path())
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in seen]
    byte_of = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(rest)}
    raw_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, raw_a, raw_b


def plain(libs, rows):
    a, b, raw_a, raw_b = libs
    docs, count = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if not text or b"".join(map(raw_a, ia)) != want or b"".join(map(raw_b, ib)) != want:
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, raw in ((ia, raw_a), (ib, raw_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(raw(i)), i))
                at = out[-1][1]
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [[[str(x[2]) for x in side if lo < x[1] <= hi] for side in spans] for lo, hi in zip([0, *common], common)]
        count.update(links)
        docs.append((doc_id, ia, ib, groups, links))
    best = {}
    for (x, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, len(ia), len(ib), len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(f"{','.join(p)}|{','.join(q)}" for p, q in g).encode()).hexdigest() if g else "") for d, ia, ib, g, ls in docs]


def check(spark, libs, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id long, text string, chunk long, runs string").repartition(parts)
    got = [tuple(r) for r in alignment.align_tokenizers(df, tokenizer_path(), piece_model_path(), **options).collect()]
    assert sorted(got, key=repr) == sorted(plain(libs, rows), key=repr)
    return got


def test_documents(spark, libs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    got = check(spark, libs, [(d, t[:3000]) for d, t in rows], parts=5)
    assert sum(r[1] > 0 for r in got) > 50


def test_odd_texts(spark, libs):
    texts = [None, "", " ", "  two  spaces ", "end ", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x0A>", "tab\tand\nline\r\n\n", "naïve Straße 東京 🙂🙂 é", "ﬁ Ａ ½", "x" * 5000, "   .", "ab " * 3000, "same text", "same text", "\u0000\u0001", "don't 12345 !!!???"]
    got = check(spark, libs, [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(2**60 + 1, "same text")])
    assert sum(r[1] > 0 for r in got) > 10


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(df, tokenizer_path(), piece_model_path()).collect() == []


def test_small_chunks(spark, libs):
    rows = [(i, f"The cat {i} sat on the mat, and the {w} ran.") for i, w in enumerate(["dog", "antelope", "xylophone"] * 40)]
    check(spark, libs, rows, chunk_bytes=100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z.,'\t\n éß東🙂▁<>0x1")), max_size=40), max_size=5))
def test_piece_encoder_equals_library(texts):
    enc = alignment.aligner(tokenizer_path(), piece_model_path()).b
    ids, each = enc.encode(pa.array(texts, pa.large_string()))
    at = np.r_[0, np.cumsum(each)]
    for i, t in enumerate(texts):
        if "▁" not in t:  # its tokens are not the text's bytes, so they don't count
            assert ids[at[i] : at[i + 1]].tolist() == enc.lib.encode(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2**45), st.integers(1, 2**40), max_size=60), min_size=1, max_size=9), st.sampled_from([1, 3, 100]))
def test_merge(runs, frame):
    import unittest.mock as mock

    with mock.patch.object(alignment, "FRAME", frame), mock.patch.object(alignment, "FAN_IN", 3):
        raw = [alignment.write_run(np.array(sorted(r), np.int64), np.array([r[k] for k in sorted(r)], np.int64)) for r in runs]
        got = [(int(k), int(c)) for key, count in alignment.read_run(alignment.one_run(raw)) for k, c in zip(key, count)]
    want = Counter()
    for r in runs:
        want.update(r)
    assert got == sorted(want.items())
