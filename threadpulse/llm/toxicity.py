"""Toxicity by multiple-instance learning: sentences are scored, a document is their noisy-or."""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_frames, text_of, word_hashes, WordHashes

#: training rows of each label at most: the documented bound of the sample that the model is fitted on
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 5000
BITS = 18
SENTENCE = re.compile(r"[^.!?\n]+")
BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sentence_words(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words (lower case, without punctuation) and the numbers of words in each sentence that has any."""
    words, counts = [], []
    for s in text.lower().translate(_SENTENCE_ENDS).split("\n"):
        got = s.encode("utf-8", "surrogatepass").translate(BLANK).split()
        if got:
            words += got
            counts.append(len(got))
    return (hashes(words) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.array(counts, np.int64)


_SENTENCE_ENDS = str.maketrans(".!?", "\n\n\n")


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.25, decay: float = 1e-6) -> np.ndarray:
    """Word weights and (last) the bias of p(sentence) = sigmoid(bias + sum of its words' weights), trained by Adam on the
    likelihood of the documents' labels under p(document) = 1 - product of (1 - p(sentence))."""
    hashes = word_hashes()
    bags = [sentence_words(t, hashes) for t in texts]
    keep = [i for i, (w, _) in enumerate(bags) if len(w)]
    out = np.zeros((1 << BITS) + 1)
    out[-1] = -6.0
    if not keep or not toxic[keep].any():
        return out
    words = np.concatenate([bags[i][0] for i in keep])
    per = np.concatenate([bags[i][1] for i in keep])
    docs = np.array([len(bags[i][1]) for i in keep])
    y, wt = toxic[keep].astype(float), weight[keep]
    feature, words = np.unique(words, return_inverse=True)
    live = telling(words, np.repeat(np.arange(len(docs)), np.add.reduceat(per, _starts(docs))), y, len(feature))
    theta, bias = np.zeros(len(feature)), -6.0
    m, v = np.zeros(len(feature) + 1), np.zeros(len(feature) + 1)
    at, doc_at = _starts(per), _starts(docs)
    for step in range(1, steps + 1):
        z = bias + np.add.reduceat(theta[words], at)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.add.reduceat(np.logaddexp(0, z), doc_at)
        pull = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0) * wt
        g = np.repeat(pull, docs) * p
        grad = np.append(np.bincount(words, np.repeat(g, per), len(feature)) * live + decay * wt.sum() * theta, g.sum()) / wt.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        theta, bias = (theta - move[:-1]) * live, bias - move[-1]
    out[feature], out[-1] = theta, bias
    return out


def telling(words: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int, least: int = 4, z: float = 4.0) -> np.ndarray:
    """1 for words in at least `least` documents whose share of toxic ones differs from all documents' by `z` standard errors or more, else 0: what is left out would only be learnt by heart."""
    pair = np.unique(doc.astype(np.int64) * n + words)
    word, toxic = pair % n, y[pair // n]
    df, hit = np.bincount(word, minlength=n), np.bincount(word, toxic, n)
    p = y.mean()
    return np.where((df >= least) & (np.abs(hit - df * p) >= z * np.sqrt(df * p * (1 - p))), 1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN) -> np.ndarray:
    """The model fitted on labelled documents outside the held-out quarter: at most `most_toxic` and `most_clean` of them, chosen by hash, weighed
    as in all labelled rows. One task fits it; what comes to the driver is the weights (2 MB at most)."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    pick = lambda label, n: lab.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, most_toxic).unionByName(pick(0, most_clean))
    weight = {1: max(1.0, count.get(1, 0) / most_toxic), 0: max(1.0, count.get(0, 0) / most_clean)}
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        y = frame["toxic"].to_numpy()
        return pd.DataFrame({"model": [fit([text_of(t) for t in frame["text"]], y, np.where(y > 0, weight[1], weight[0])).astype("<f8").tobytes()]})

    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(f, "model binary").collect()
    return np.frombuffer(got[0]["model"], "<f8") if got else fit([], np.empty(0), np.empty(0))


def sentence_scores(text: str, model: np.ndarray, hashes: WordHashes) -> np.ndarray:
    words, n = sentence_words(text, hashes)
    return 1 / (1 + np.exp(-np.clip(model[-1] + np.add.reduceat(model[words], _starts(n)), -30, 30))) if len(n) else np.empty(0)


def locate(text: str, model: np.ndarray, hashes: WordHashes, least: float = 0.3) -> list[tuple[int, int]]:
    """Code point spans of the sentences scored at least `least`."""
    out = []
    for m in SENTENCE.finditer(text):
        p = sentence_scores(m[0], model, hashes)
        if len(p) and p.max() >= least:
            a = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((a, m.end()))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, sentences (spans of offending ones, start:end, comma-joined).

    score is the noisy-or over the whole text's sentences; null and empty texts, without sentences, score 0. Without toxic
    labels to learn from all scores are near 0. Repeated rows score alike; null ids are scored, not held out; labels, lang, source and ids
    are no inputs of a score; equal texts score alike; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    model = train(docs, labels)
    used = np.flatnonzero(model[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((used.astype("<i4").tobytes(), model[used].astype("<f8").tobytes(), float(model[-1])))

    def run(frames):
        where, what, bias = sent.value
        full = np.zeros((1 << BITS) + 1)
        full[np.frombuffer(where, "<i4")], full[-1] = np.frombuffer(what, "<f8"), bias
        hashes = word_hashes()
        for frame in frames:
            texts = [text_of(t) for t in frame["text"]]
            bags = [sentence_words(t, hashes) for t in texts]
            score = np.zeros(len(texts))
            has = [i for i, (_, n) in enumerate(bags) if len(n)]
            if has:
                per, docs_ = np.concatenate([bags[i][1] for i in has]), np.array([len(bags[i][1]) for i in has])
                z = full[-1] + np.add.reduceat(full[np.concatenate([bags[i][0] for i in has])], _starts(per))
                score[has] = -np.expm1(-np.add.reduceat(np.logaddexp(0, z), _starts(docs_)))
            spans = [",".join(f"{a}:{b}" for a, b in locate(t, full, hashes, threshold)) if s >= threshold else "" for t, s in zip(texts, score)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": score, "sentences": spans})

    scored = in_frames(docs.select("doc_id", "text"), run, "doc_id long, score double, sentences string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
