"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, in_batches, in_groups, text_of

SYMBOLS = "#*$%&|<>"
#: rules: a document whose measure is above the cutoff of its stratum is rejected
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")
GRID = 100
#: levels of strictness: the share of good documents that a rule may reject where it is proposed
LEVELS = (0.0, 0.0005, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.005, 0.006, 0.008, 0.01, 0.0125, 0.015)
MEASURES = ", ".join(f"{r} double" for r in RULES)


def text_stats(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the measure of each rule."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - spaces
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            inside = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            cover = np.zeros(n, bool)
            for i in range(3):
                cover[i : i + len(windows)] |= inside
            repeat = int(cover.sum())
    upper = sum(map(str.isupper, text.split()))
    return (n, chars, symbols, dup, repeat, symbols / max(chars, 1), dup / max(len(lines), 1), repeat / max(n, 1), upper / max(n, 1), text.count("!") / max(n, 1))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, name (a hash of the text) and the statistics of each document's whole text; a null text is empty."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([text_stats(text_of(t)) for t in frame["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES])
        return out.assign(doc_id=frame["doc_id"], lang=frame["lang"], name=frame["name"])

    return in_batches(docs.select("doc_id", "lang", "text", text_name().alias("name")), f, f"doc_id long, lang string, name long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, {MEASURES}")


def text_name() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms; at most delta where the Clopper-Pearson upper bound is at most p."""
    if k >= n:
        return 1.0
    i = np.arange(0, k + 1, dtype=float)
    steps = np.log(n - i[:-1]) - np.log(i[1:]) if k else np.empty(0)
    logs = np.concatenate([[0.0], np.cumsum(steps)]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def least_good(alpha: float, delta: float) -> int:
    """Good documents that a stratum needs before even no false rejection among them is proof enough."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def propose_levels(counts: DataFrame, levels: tuple[float, ...] = LEVELS, lift: float = 4.0) -> DataFrame:
    """stratum, rule, cuts: for each level of strictness the rule's cutoff (null: the rule rejects nothing), from the selection half.

    counts: stratum, rule, bin, good, bad. At level q a rule rejects at most q of the good documents seen here, and only if it rejects `lift`
    times as large a share of the bad ones; a stricter level keeps what laxer ones reject, so the levels are nested."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(GRID + 2), np.zeros(GRID + 2)
        np.add.at(good, frame["bin"].to_numpy(int), frame["good"].to_numpy(float))
        np.add.at(bad, frame["bin"].to_numpy(int), frame["bad"].to_numpy(float))
        over_good, over_bad = (x.sum() - np.cumsum(x) for x in (good, bad))  # documents above each bin
        n, m, best, cuts = good.sum(), bad.sum(), None, []
        for q in levels:
            b = int(np.argmax(over_good <= q * n))
            if n and m and over_bad[b] / m > lift * over_good[b] / n and (best is None or b < best):
                best = b
            cuts.append(best)
        key = frame.iloc[0]
        return pd.DataFrame({"stratum": [key["stratum"]], "rule": [key["rule"]], "cuts": [cuts]})

    return in_groups(counts.groupBy("stratum", "rule"), f, "stratum string, rule string, cuts array<int>")


def test_levels(counts: DataFrame, alpha: float, delta: float, n_levels: int) -> DataFrame:
    """stratum, level, n_good, p_value: the strictest level whose joint verdict surely rejects at most alpha of the stratum's good documents.

    counts: stratum, first, good: good documents of the holdout by the first level that rejects them by any rule (n_levels: none does).
    Levels go from lax to strict, each tested at delta, and the first that fails ends the series: fixed-sequence testing, which needs no
    further correction within the stratum. No row where none passes."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        good = np.zeros(n_levels + 1, int)
        np.add.at(good, frame["first"].to_numpy(int), frame["good"].to_numpy(int))
        n, rows = int(good.sum()), []
        for level, false in enumerate(np.cumsum(good[:-1]).tolist()):
            p = binomial_tail(false, n, alpha) if n else 1.0
            if p > delta:
                break
            rows = [(frame["stratum"].iloc[0], level, n, p)]
        return pd.DataFrame(rows, columns=["stratum", "level", "n_good", "p_value"])

    return in_groups(counts.groupBy("stratum"), f, "stratum string, level int, n_good long, p_value double")


def judge(stats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stats with base_failed and kept, the stratum, its cutoffs (cut_...), n_good and p_value.

    Labelled documents are parted by a hash of their text: one half proposes nested levels of strictness, the other, the holdout, tests the joint
    verdict of all rules at each level. Of equal texts only one counts, as copies are no trials of their own. Strata are languages: each with
    enough labels for the test has its own, all others (and null) share one. The error delta is dealt over strata (Bonferroni). Labels
    that are null or of unknown documents are not used; of a text labelled twice the worst counts. Without labels only the base rules decide.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    lab = stats.where(F.col("doc_id").isNotNull() & ~base_failed()).join(marked, "doc_id")
    lab = lab.groupBy("name", F.coalesce("lang", F.lit("")).alias("_l")).agg(F.min("_quality").alias("_quality"), *[F.first(r).alias(r) for r in RULES])
    lab = cut_lineage(lab.withColumn("holdout", F.pmod(F.xxhash64("name", F.lit(7)), F.lit(2)) == 1))
    size = lab.where("holdout and _quality = 1").groupBy("_l").count()
    # a language that can prove anything when the error is dealt over at most this many strata
    strata = size.where(F.col("count") >= least_good(alpha, delta)).count() + 1
    own = cut_lineage(size.where(F.col("count") >= least_good(alpha, delta / strata)).select("_l", F.concat(F.lit("="), "_l").alias("stratum")))
    with_stratum = lambda df: df.join(own, "_l", "left").withColumn("stratum", F.coalesce("stratum", F.lit("others")))
    lab = with_stratum(lab)
    bins = [F.least(F.ceil(F.col(r) * GRID), F.lit(GRID)).cast("int").alias("bin") for r in RULES]
    long = lab.where("not holdout").select("stratum", "_quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), b) for r, b in zip(RULES, bins)])).alias("x"))
    counts = long.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.bin").alias("bin")).agg(F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_quality") == 0).alias("bad"))
    levels = cut_lineage(propose_levels(counts).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cuts"))).alias(f"cuts_{r}") for r in RULES]))
    spared = lambda r: F.size(F.filter(F.coalesce(f"cuts_{r}", F.array_repeat(F.lit(None).cast("int"), len(LEVELS))), lambda c: c.isNull() | (F.least(F.ceil(F.col(r) * GRID), F.lit(GRID)) <= c)))
    first = lab.where("holdout and _quality = 1").join(levels, "stratum").select("stratum", F.least(*[spared(r) for r in RULES]).alias("first"))
    chosen = test_levels(first.groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("good")), alpha, delta / strata, len(LEVELS))
    cut = [(F.col(f"cuts_{r}")[F.col("level")] / float(GRID)).alias(f"cut_{r}") for r in RULES]
    wide = cut_lineage(chosen.join(levels, "stratum").select("stratum", "level", "n_good", "p_value", *cut))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.ceil(F.col(r) * GRID) / float(GRID) > F.col(f"cut_{r}"), F.lit(False))
    failed = base_failed()
    judged = with_stratum(stats.withColumn("_l", F.coalesce("lang", F.lit("")))).drop("_l").join(wide, "stratum", "left")
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, its counts, base_failed, kept, the measures and cutoffs.

    kept is false where the base rules fail or a measure is above the cutoff that labelled documents of its stratum allow: at confidence
    1 - delta over all strata together, the rules between them reject at most alpha of a stratum's good documents. Null text is
    empty (and fails the base rules); texts of any length are measured whole; repeated rows each give a row and equal texts of one
    language one verdict; a measure equal to its cutoff passes; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    return judge(cut_lineage(measure(docs)), labels, alpha, delta).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES, "stratum", "level", "n_good", "p_value", *[f"cut_{r}" for r in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that pass, with their columns as they were; each row is judged by its own text and language, also where ids repeat or are null."""
    verdict = judge(cut_lineage(measure(docs)), labels, alpha, delta).where("kept")
    kept = verdict.select(F.col("doc_id").alias("_llm_id"), F.col("lang").alias("_llm_lang"), F.col("name").alias("_llm_kept")).distinct()
    same = (F.col("_llm_name") == F.col("_llm_kept")) & F.col("doc_id").eqNullSafe(F.col("_llm_id")) & F.col("lang").eqNullSafe(F.col("_llm_lang"))
    return docs.withColumn("_llm_name", text_name()).join(kept, same, "left_semi").select(*docs.columns)
