"""Sentiment rules on hand-scored sentences."""

import math

import pytest

from threadpulse.operators import sentiment

LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("hate", -2.7)]


def norm(s):
    return s / math.sqrt(s * s + 15)


CASES = [
    ("The book was good.", norm(1.9)),
    ("The book was very good", norm(1.9 + 0.293)),
    ("very the good", norm(1.9 + 0.293 * 0.95)),
    ("very one two good", norm(1.9 + 0.293 * 0.9)),
    ("very one two three good", norm(1.9)),
    ("slightly bad", norm(-2.5 + 0.293)),
    ("very bad", norm(-2.5 - 0.293)),
    ("not good", norm(1.9 * -0.74)),
    ("not a very good", norm((1.9 + 0.293) * -0.74)),
    ("It is GOOD here", norm(1.9 + 0.733)),
    ("GOOD", norm(1.9)),
    ("good but bad", norm(1.9 * 0.5 - 2.5 * 1.5)),
    ("good!!!", norm(1.9 + 3 * 0.292)),
    ("bad!!!!!!", norm(-2.5 - 4 * 0.292)),
    ("good??", norm(1.9 + 0.36)),
    ("good????", norm(1.9 + 0.96)),
    ("I hate it, VERY bad", norm(-2.7 - 2.5 - 0.293 - 0.733)),
    ("nothing to see", 0.0),
    ("", 0.0),
    (None, 0.0),
    ("good! \"great\"", norm(1.9 + 3.1 + 0.292)),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "k int, t string")
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    got = {r.k: r.compound for r in sentiment.rule_scores(df, lexicon, "k", "t").collect()}
    for i, (t, want) in enumerate(CASES):
        assert got[i] == pytest.approx(want), t
