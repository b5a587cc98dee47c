"""Sentiment of short texts by published lexicon rules: boosters, negation within three words, capitals, contrast, punctuation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published rules: weight of a booster and how it fades with distance, negation, capitals, sides of a contrast, exclamation and question marks, normalization
BOOST, FADE, NEGATION, CAPITALS = 0.293, (1.0, 0.95, 0.9), -0.74, 0.733
BEFORE, BEHIND, EXCLAMATION, QUESTION, MANY_QUESTIONS, ALPHA = 0.5, 1.5, 0.292, 0.18, 0.96, 15.0
BOOSTERS = {w: BOOST for w in ("absolutely", "completely", "deeply", "entirely", "extremely", "fully", "greatly", "highly", "incredibly", "more", "most", "really", "so", "totally", "truly", "very")} | {w: -BOOST for w in ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat")}
NEGATORS = ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "without", "cannot", "can't", "don't", "doesn't", "didn't", "won't", "wouldn't", "isn't", "aren't", "wasn't", "weren't")
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def words_of(text: Column) -> Column:
    """White-space words without punctuation at either end; of two characters or fewer once stripped they stay whole (emoticons)."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")
    return F.transform(raw, lambda w: F.when(F.length(F.regexp_replace(w, _EDGE, "")) <= 2, w).otherwise(F.regexp_replace(w, _EDGE, "")))


def _is_capital(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def rule_scores(texts: DataFrame, lexicon: DataFrame, key: str, text: str, boosters: dict[str, float] = BOOSTERS, negators: tuple[str, ...] = NEGATORS, contrast: str = "but") -> DataFrame:
    """key, compound in [-1, 1], n_hits: 0 for texts without a word of the lexicon (token in lower case, valence).

    Each word carries the three before it and its place along, so the only shuffles are the join with the lexicon (broadcast by Spark where that is small)
    and the sum of a text's hits. Boosters and negators count as such even where the lexicon has them."""
    w = words_of(F.col(text))
    base = texts.select(key, F.col(text).alias("_text"), w.alias("_w"), F.transform(w, F.lower).alias("_low"), F.transform(w, _is_capital).alias("_cap"))
    n_caps = F.size(F.filter("_cap", lambda c: c))
    base = base.select(key, "_w", "_low", "_cap", ((n_caps > 0) & (n_caps < F.size("_w"))).alias("mixed"), F.array_position("_low", contrast).alias("turn"), _emphasis(F.col("_text")).alias("emphasis"))
    before = lambda name, i, d: F.when(i >= d, F.get(F.col(name), i - d))
    each = F.transform("_low", lambda x, i: F.struct(x.alias("token"), F.get("_cap", i).alias("cap"), (i + 1).alias("place"), *[F.struct(before("_low", i, d).alias("w"), before("_cap", i, d).alias("c")).alias(f"b{d}") for d in (1, 2, 3)]))
    hits = base.select(key, "mixed", "turn", "emphasis", F.explode(each).alias("x")).select(key, "mixed", "turn", "emphasis", "x.*").join(lexicon.select("token", "valence"), "token")
    boost = F.create_map(*[F.lit(x) for x in chain(*boosters.items())])
    v = F.col("valence") + F.when(F.col("mixed") & F.col("cap"), F.signum("valence") * CAPITALS).otherwise(0.0)
    for d, fade in zip((1, 2, 3), FADE):
        p, c = F.col(f"b{d}.w"), F.col(f"b{d}.c")
        up = F.when(v < 0, -boost[p]).otherwise(boost[p]) + F.when(F.col("mixed") & c, F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(0.0)
        hits = hits.withColumn("v", (v + F.coalesce(up * fade, F.lit(0.0))) * F.when(p.isin(*negators), NEGATION).otherwise(1.0))
        v = F.col("v")
    side = F.when(F.col("turn") == 0, 1.0).when(F.col("place") < F.col("turn"), BEFORE).when(F.col("place") > F.col("turn"), BEHIND).otherwise(1.0)
    per = hits.groupBy(key).agg(F.sum(v * side).alias("s"), F.first("emphasis").alias("e"), F.count(F.lit(1)).alias("n_hits"))
    s = F.col("s") + F.signum("s") * F.col("e")
    per = per.select(key, (s / F.sqrt(s * s + ALPHA)).alias("compound"), "n_hits")
    return texts.select(key).join(per, key, "left").select(key, F.coalesce("compound", F.lit(0.0)).alias("compound"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def _emphasis(text: Column) -> Column:
    """What exclamation marks (four count at most) and question marks (from two on) add to a score's size."""
    q = F.regexp_count(text, F.lit(r"\?"))
    asked = F.when(q <= 1, 0.0).when(q <= 3, q * QUESTION).otherwise(MANY_QUESTIONS)
    return F.least(F.regexp_count(text, F.lit("!")), F.lit(4)) * EXCLAMATION + asked
