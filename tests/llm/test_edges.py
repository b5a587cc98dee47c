"""Values, not counts, for odd rows: ids beside nulls, empty and long texts, repeats, clashing columns; and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadpulse.llm import binary, fingerprints, html_extract, jaccard, mixing, packing, quality, secrets, toxicity
from threadpulse.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
BIG = 2**60 + 1
LONG = "lorem ipsum dolor " * 20_000
SAME = " ".join(f"s{i}" for i in range(80))
ROWS = [(1, None, "en", "a"), (2, "", None, None), (3, LONG, "de", "b"), (4, SAME, "en", "b"), (4, SAME, "en", "b"), (BIG, SAME, "en", "a"), (None, "word " * 60, "fr", None), (None, None, None, None)]
# names that the operators use inside
CLASHING = "score double, part int, node string, key long, level int, bin int, n long, p double, kept boolean, stratum string, name string, copies int, piece int, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *[None] * 14) for r in ROWS], "doc_id long, text string, lang string, source string, " + CLASHING).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (BIG, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x or 0))


def test_quality(odd, labels):
    got = quality.quality_rules(odd, labels).collect()
    assert ids(got) == [1, 2, 3, 4, 4, BIG, None, None]
    by = {(r.doc_id, r.n_words): r for r in got}
    assert {k for k in by} == {(1, 0), (2, 0), (3, 60_000), (4, 80), (BIG, 80), (None, 60), (None, 0)}
    assert by[3, 60_000].n_repeat_words == 60_000 and by[3, 60_000].base_failed and by[4, 80].kept and not by[1, 0].kept
    assert by[None, 60].base_failed and by[None, 60].word_chars == 240
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and ids(kept.collect()) == [4, 4, BIG]


def test_keep_good_judges_each_text_under_one_id(spark, labels):
    d = spark.createDataFrame([(1, SAME, "en"), (1, "few words", "en")], "doc_id long, text string, lang string")
    assert [r.text for r in quality.keep_good(d, labels).collect()] == [SAME]


def test_joint_risk_of_quality_rules(spark):
    """A stratum whose bad documents shout: cutoffs are found; the rules together reject at most alpha of the good ones of new data, and languages with few labels reject nothing."""
    rng = np.random.default_rng(0)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    rows, lab = [], []
    for i in range(3000):
        bad, lang = i % 5 == 0, "en" if i % 10 else "xx"
        w = words(60)
        for k in range(int(rng.integers(8, 15)) if bad else int(rng.random() < 0.1)):
            w[k] = w[k].upper() + "#" * (bad and k % 2)
        rows.append((i, " ".join(w), lang))
        lab.append((i, int(not bad), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.quality_rules(d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).collect()
    en = [r for r in got if r.stratum == "=en"]
    good, bad = [r for r in en if lab[r.doc_id][1]], [r for r in en if not lab[r.doc_id][1]]
    assert np.mean([not r.kept for r in good]) <= 0.02 and np.mean([not r.kept for r in bad]) > 0.9
    assert all(r.kept for r in got if r.stratum == "others")
    assert quality.least_good(0.02, 0.025) == math.ceil(math.log(0.025) / math.log(0.98)) == 183


def test_fingerprints(odd):
    got = fingerprints.fingerprint_documents(odd).collect()
    assert ids(got) == [1, 2, 3, 4, 4, BIG, None, None]
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[BIG][0].n_chars == len(SAME) and by[BIG][0].fingerprint == by[4][0].fingerprint == by[4][1].fingerprint
    assert by[BIG][0].near_next == 1.0 and sorted(r.near_next for r in by[4]) == [0.0, 1.0]
    assert {r.n_chars for r in by[None]} == {300, 0} and by[3][0].n_chars == len(LONG)
    for r in got:
        assert r.near_edited == fingerprints.likeness_of_strings(r.fingerprint, r.edited_fingerprint)
    assert fingerprints.likeness_of_strings(by[1][0].fingerprint, by[2][0].fingerprint) == 1.0  # both empty


def test_fingerprints_of_large_unlike_texts():
    rng = np.random.default_rng(1)
    sentence = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10**6, 8)) + ". "
    a, b = ["".join(sentence() for _ in range(n)) for n in (700, 90)]
    shared = a[: len(a) // 2] + b
    fa, fb, fs = (fingerprints.Fingerprints.of(*fingerprints.digests([t])).strings()[0] for t in (a, b, shared))
    for x, y, tx, ty in ((fa, fb, a, b), (fa, fs, a, shared), (fs, fb, shared, b), (fa, fa, a, a)):
        u, v = (set(fingerprints.digests([t])[0].tolist()) for t in (tx, ty))
        assert fingerprints.likeness_of_strings(x, y) == pytest.approx(2 * len(u & v) / (len(u) + len(v)))


def test_near_duplicates(odd):
    got = jaccard.near_duplicates(odd).collect()
    assert ids(got) == [1, 2, 3, 4, 4, BIG, None, None]
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (BIG, 4, 2), (None, None, 0)}


def test_packing_and_token_files(odd, lib):
    texts = defaultdict(list)
    for d, t, *_ in ROWS:
        texts[d].append(lib(t))
    got = packing.pack_documents(odd, tokenizer_path()).collect()
    whole = defaultdict(list)
    for r in got:
        assert r.length <= 1024
        whole[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for d, lists in texts.items():
        want = []
        for x in lists:
            first = len(x) if len(x) <= 1024 else len(x) % 1024 or 1024
            cuts = [0, *range(first, len(x) + 1, 1024)]
            want += [(a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]
        assert sorted(whole[d]) == sorted(want)
    at, files = 0, sorted(binary.token_files(odd, tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in files] == [None, None, 1, 2, 3, 4, 4, BIG]
    for r in files:
        assert r.start == at and r.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in texts[r.doc_id]}
        at += r.n_tokens


def test_genetic_packing_beats_best_fit():
    import random

    for low, high in ((150, 650), (200, 500), (260, 420)):
        rng = random.Random(low)
        sizes = [rng.randint(low, high) for _ in range(600)]
        bins = packing.evolve(sizes, 1024, 1)
        used = Counter()
        for s, b in zip(sizes, bins):
            used[b] += s
        assert max(used.values()) <= 1024
        assert len(used) < len(packing.best_fit_decreasing(sizes, 1024).items)


def test_sequence_ids_are_unique(spark):
    rows = [(i, 0, 0, 100 + i * 37 % 900, i) for i in range(3000)] + [(i, 1, 1024, 1024, i) for i in range(50)]
    got = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), deme=200).collect()
    assert len(got) == 3050
    place = defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for x in place.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(x[-1]) <= 1024


def test_toxicity(odd, labels):
    got = toxicity.score_toxicity(odd, labels).collect()
    assert ids(got) == [1, 2, 3, 4, 4, BIG, None, None]
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert all(r.score == 0 for r in got if r.doc_id in (1, 2)) and len({r.score for r in got if r.doc_id in (4, BIG)}) == 1


def test_mixing(spark, odd):
    got = mixing.mix_documents(odd).collect()
    assert ids(got) == [1, 2, 3, 4, 4, BIG, None, None]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter({(1, 0): 1, (2, 0): 1, (3, 60_000): 1, (4, 80): 2, (BIG, 80): 1, (None, 60): 1, (None, 0): 1})
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    alike = spark.createDataFrame([(7, "one two three", "a")] * 1000 + [(8, "x " * 3000, "b")], "doc_id long, text string, source string").repartition(4)
    some = mixing.mix_documents(alike).collect()
    of = [r for r in some if r.doc_id == 7]
    assert len(of) == 1000 and abs(sum(r.taken for r in of) - of[0].target) <= 3


def test_html(spark):
    deep = lambda w: "<div>" * 1500 + f"<p>{w}</p>" + "</div>" * 1500
    cases = {
        '<p title="a hidden gem of">text</p>': "text", '<div data-hidden="false">text</div>': "text", '<body class="layout has-sidebar"><div class="layout has-sidebar"><p>text</p></div>': "text",
        '<article><div class="post-header"><h1>Head</h1></div><p>a <math>x+1</math> b</p></article>': "Head\na x+1 b", '<div class="sidebar">x</div><p>y</p><div hidden>z</div>': "y", "<p>a<b>b<p>c": "ab\nc", "": "", "<": "<", "a &amp; b &lt;c&gt;": "a & b <c>",
        '<main><p>One</p><div class="comments"><p>no</p></div></main><footer>f</footer>': "One", '<p>x <a href="a>b">y</a></p>': "x y", "<script>if (a < b) {}</script><p>t</p>": "t",
    }
    for html, want in cases.items():
        assert html_extract.main_text(html) == want, html
    rows = [(BIG, "http://d/1", deep("one")), (2, "http://d/2", deep("two")), (None, "http://d/3", deep("three")), (4, None, None)] + [(10 + i, "http://d/x", deep(f"n{i}")) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[BIG] == "one" and got[2] == "two" and got[None] == "three" and got[4] == ""
    for bad in ("<a " * 60_000, '<a "' * 60_000, "<!--" * 60_000, "<b>" * 60_000 + "x" + "</i>" * 60_000, "<script>" * 60_000):
        html_extract.main_text(bad)


def test_pipeline_against_brute_force(spark, lib):
    """Stage by stage on the small tables: base rules (no language has labels enough for a cutoff), all pairs, the base patterns' spans, copies within bounds, pieces and sequences."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got, kept = corpus_pipeline.quality_stage(spark, docs, SF), {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        win = Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if win[x] > 1 for k in range(3)}
        if len(w) >= 50 and 100 * len(inside) <= 50 * len(w):
            kept[r.doc_id] = r
    assert {r.doc_id for r in got.collect()} == set(kept)
    one = corpus_pipeline.near_duplicate_stage(spark, got, SF)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, r in kept.items() for w in [r.text.split()]}
    label = {}
    for a in sorted(sets):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = a
                todo += [y for y in sets if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    assert {r.doc_id for r in one.collect()} == set(label.values())
    base = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2), (re.compile("AKIA[A-Z0-9]+"), 20, 0), (re.compile("[0-9a-f]+"), 24, 0)]
    clean = {r.doc_id: r.text for r in corpus_pipeline.secret_stage(spark, one, SF).collect()}
    for d, text in clean.items():
        original, hidden = kept[d].text, set()
        for rx, n, g in base:
            for m in rx.finditer(original):
                if len(m[g]) >= n:
                    hidden |= set(range(*m.span()))
        assert all(len(m[g]) < n for rx, n, g in base for m in rx.finditer(text))
        if not hidden and not secrets.method_spans(original):
            assert text == original
    cleaned = corpus_pipeline.secret_stage(spark, one, SF)
    mixed = corpus_pipeline.mixing_stage(spark, cleaned, SF)
    n = Counter(r.doc_id for r in mixed.collect())
    assert max(n.values()) <= 2 and set(n) <= set(clean)
    pieces = corpus_pipeline.packing_stage(spark, mixed, SF).collect()
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert tokens == {d: k * len(lib(clean[d])) for d, k in n.items()}
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces)
