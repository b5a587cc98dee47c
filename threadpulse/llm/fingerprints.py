"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_frames, MIX, partitions_for, scramble, sha256, text_of

HASHES, LEVELS = 3, 3
#: A paragraph's pieces: its sentences, up to a line feed or the marks that end them; a longer one is cut at the first word end after 96 characters.
PIECE = re.compile(r"[^\n.!?]{96,}?(?=\s)\s|[^\n.!?]*[.!?]+\s*|[^\n.!?]*\n\s*|[^\n.!?]+$|\s+")


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all paragraph pieces of the texts, and where each text begins (and the end).

    The k-th occurrence of a piece in its text has a digest of its own, so the digests of a text are a set."""
    import xxhash

    f, out, which, at = xxhash.xxh3_64_intdigest, [], [], [0]
    for t in texts:
        seen: dict[str, int] = {}
        for p in PIECE.findall(t):
            k = seen.get(p, 0)
            seen[p] = k + 1
            out.append(f(p.encode("utf-8", "surrogatepass")))
            which.append(k)
        at.append(len(out))
    with np.errstate(over="ignore"):
        return scramble(np.array(out, np.uint64) + scramble(np.array(which, np.uint64) + MIX)), np.array(at, np.int64)


def _checks(d: np.ndarray) -> np.ndarray:
    return (scramble(d ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _places(d: np.ndarray, level: int) -> np.ndarray:
    """HASHES cells for each digest, one in each part of the sketch. A part has 2^level cells and a place is the hash's low bits, so that
    halves of a part added up are the part of the level below."""
    return np.stack([(scramble(d + np.uint64(i + 1)) & np.uint64((1 << level) - 1)).astype(np.int64) + (i << level) for i in range(HASHES)], 1)


class Sketches:
    """Invertible Bloom lookup sketches of many documents at one level: counts, digest XORs and check XORs of each cell."""

    def __init__(self, level: int, count: np.ndarray, ids: np.ndarray, check: np.ndarray):
        self.level, self.count, self.ids, self.check = level, count, ids, check

    @classmethod
    def of(cls, d: np.ndarray, at: np.ndarray, level: int) -> Sketches:
        n, cells = len(at) - 1, HASHES << level
        where = (np.repeat(np.arange(n), np.diff(at)) * cells)[:, None] + _places(d, level)
        flat = where.ravel()
        count = np.bincount(flat, minlength=n * cells).astype(np.int32)
        ids, check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)
        np.bitwise_xor.at(ids, flat, np.repeat(d, HASHES))
        np.bitwise_xor.at(check, flat, np.repeat(_checks(d), HASHES))
        return cls(level, count.reshape(n, cells), ids.reshape(n, cells), check.reshape(n, cells))

    def rows(self, which) -> Sketches:
        return Sketches(self.level, self.count[which], self.ids[which], self.check[which])

    def folded(self, level: int) -> Sketches:
        """The same documents' sketches at a lower level."""
        n, count, ids, check = len(self.count), self.count, self.ids, self.check
        for k in range(self.level, level, -1):
            count, ids, check = (x.reshape(n, HASHES, 2, 1 << (k - 1)) for x in (count, ids, check))
            count, ids, check = count.sum(2, dtype=np.int32).reshape(n, -1), (ids[:, :, 0] ^ ids[:, :, 1]).reshape(n, -1), (check[:, :, 0] ^ check[:, :, 1]).reshape(n, -1)
        return Sketches(level, count, ids, check)

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.level, self.count - other.count, self.ids ^ other.ids, self.check ^ other.check)

    def hopeless(self) -> np.ndarray:
        """Documents that leave under a twentieth of the cells empty: peeling needs about 1.23 cells a digest, which leaves a twelfth empty."""
        full = ((self.count != 0) | (self.ids != 0)).mean(1) > 0.95
        return full & (self.count.shape[1] > 24)

    def strings(self) -> list[str]:
        """Count, digest and check of all cells, little-endian, in base64."""
        return [base64.b64encode(c.astype("<i4").tobytes() + i.astype("<u8").tobytes() + k.astype("<u4").tobytes()).decode() for c, i, k in zip(self.count, self.ids, self.check)]

    @classmethod
    def read(cls, fingerprint: str) -> Sketches:
        raw = base64.b64decode(fingerprint)
        cells = len(raw) // 16
        level = (cells // HASHES).bit_length() - 1
        return cls(level, np.frombuffer(raw, "<i4", cells)[None].copy(), np.frombuffer(raw, "<u8", cells, 4 * cells)[None].copy(), np.frombuffer(raw, "<u4", cells, 12 * cells)[None].copy())

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each (difference) sketch: whether it peeled off whole; (document, digest, sign) of what came out."""
        n, cells = self.count.shape
        count, ids, check = self.count.ravel().copy(), self.ids.ravel().copy(), self.check.ravel().copy()
        rows, got, signs = [], [], []
        look = np.flatnonzero(np.abs(count) == 1)
        while len(look):
            pure = look[_checks(ids[look]) == check[look]]
            if not len(pure):
                break
            doc, d, sign = pure // cells, ids[pure], count[pure]
            _, first = np.unique(scramble(d) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            doc, d, sign = doc[first], d[first], sign[first]
            flat = ((doc * cells)[:, None] + _places(d, self.level)).ravel()
            np.subtract.at(count, flat, np.repeat(sign, HASHES))
            np.bitwise_xor.at(ids, flat, np.repeat(d, HASHES))
            np.bitwise_xor.at(check, flat, np.repeat(_checks(d), HASHES))
            rows.append(doc), got.append(d), signs.append(sign)
            look = flat[np.abs(count[flat]) == 1]
            look = np.unique(look)
        whole = ~((count != 0) | (ids != 0) | (check != 0)).reshape(n, cells).any(1)
        if not rows:
            return whole, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
        return whole, np.concatenate(rows), np.concatenate(got), np.concatenate(signs)


def _take(d: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (at[1:] - at[:-1])[rows]
    upto = np.concatenate([[0], np.cumsum(n)])
    return d[np.repeat(at[:-1][rows] - upto[:-1], n) + np.arange(upto[-1])], upto


class Fingerprints:
    """Sketches of many documents, each at the least level (from 1.5 cells a digest on) at which it peels off whole on its own: all digests can be read from it."""

    def __init__(self, level: np.ndarray, place: np.ndarray, groups: dict[int, Sketches]):
        self.level, self.place, self.groups = level, place, groups

    @classmethod
    def of(cls, d: np.ndarray, at: np.ndarray) -> Fingerprints:
        n = np.diff(at)
        level = np.maximum(LEVELS, np.ceil(np.log2(np.maximum(1.5 * n, 1) / HASHES)).astype(np.int64))
        place, parts, todo, most = np.zeros(len(n), np.int64), {}, np.arange(len(n)), level + 10
        while len(todo):
            if (level > most).any():
                raise ValueError("two pieces of a text have one digest")
            failed = []
            for k in np.unique(level[todo]):
                who = todo[level[todo] == k]
                made = Sketches.of(*_take(d, at, who), int(k))
                whole = made.peel()[0]
                failed.append(who[~whole])
                parts.setdefault(int(k), []).append((who[whole], made.rows(whole)))
            todo = np.concatenate(failed)
            level[todo] += 1
        groups = {}
        for k, found in parts.items():
            place[np.concatenate([w for w, _ in found])] = np.arange(sum(len(w) for w, _ in found))
            groups[k] = Sketches(k, *(np.concatenate([getattr(s, c) for _, s in found]) for c in ("count", "ids", "check")))
        return cls(level, place, groups)

    @classmethod
    def read(cls, fingerprint: str) -> Fingerprints:
        s = Sketches.read(fingerprint)
        return cls(np.array([s.level]), np.array([0]), {s.level: s})

    def rows(self, which: np.ndarray) -> Fingerprints:
        return Fingerprints(self.level[which], self.place[which], self.groups)

    def strings(self) -> list[str]:
        made = {k: s.strings() for k, s in self.groups.items()}
        return [made[k][p] for k, p in zip(self.level.tolist(), self.place.tolist())]

    def at_level(self, which: np.ndarray, level: int) -> Sketches:
        """The sketches of these documents, folded to a level that none of them is below."""
        cells = HASHES << level
        out = Sketches(level, np.zeros((len(which), cells), np.int32), np.zeros((len(which), cells), np.uint64), np.zeros((len(which), cells), np.uint32))
        for k in np.unique(self.level[which]):
            rows = np.flatnonzero(self.level[which] == k)
            some = self.groups[int(k)].rows(self.place[which[rows]]).folded(level)
            out.count[rows], out.ids[rows], out.check[rows] = some.count, some.ids, some.check
        return out

    def size(self) -> np.ndarray:
        """Digests in each document: every one counts once in each part."""
        out = np.zeros(len(self.level), np.int64)
        for k in np.unique(self.level):
            rows = np.flatnonzero(self.level == k)
            out[rows] = self.groups[int(k)].count[self.place[rows]].sum(1) // HASHES
        return out

    def listed(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `which`, digest) of all digests of these documents, by peeling each on its own."""
        doc, got = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for k in np.unique(self.level[which]):
            rows = np.flatnonzero(self.level[which] == k)
            _, r, d, _ = self.groups[int(k)].rows(self.place[which[rows]]).peel()
            doc.append(rows[r]), got.append(d)
        return np.concatenate(doc), np.concatenate(got)


def differing(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """How many digests only one of the two has, for each pair, from the sketches alone.

    They are subtracted at a low level and peeled; where that fails, at a level four times as large, up to the smaller one's own; what
    is left differs by more than that can hold, and then each of the two is peeled by itself and the digests are set against each other."""
    n = len(a.level)
    out, rows, level = np.zeros(n, np.int64), np.arange(n), np.full(n, LEVELS)
    most = np.minimum(a.level, b.level)
    while len(rows):
        level[rows] = np.minimum(level[rows], most[rows])
        left = []
        for k in np.unique(level[rows]):
            who = rows[level[rows] == k]
            diff = a.at_level(who, int(k)).minus(b.at_level(who, int(k)))
            worth = ~diff.hopeless()
            whole, doc, _, _ = diff.rows(worth).peel()
            who_ok = who[worth]
            out[who_ok[whole]] = np.bincount(doc, minlength=len(who_ok))[whole]
            left.append(np.concatenate([who[~worth], who_ok[~whole]]))
        rows = np.concatenate(left)
        alone = rows[level[rows] == most[rows]]
        if len(alone):
            (i, x), (j, y) = a.listed(alone), b.listed(alone)
            doc, d = np.concatenate([i, j]), np.concatenate([x, y])
            _, first, times = np.unique(scramble(d) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
            out[alone] = np.bincount(doc[first[times == 1]], minlength=len(alone))
        rows = rows[level[rows] < most[rows]]
        level[rows] += 2
    return out


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """2 x shared digests / all digests of both; 1 where neither has any."""
    total = a.size() + b.size()
    return np.where(total > 0, (total - differing(a, b)) / np.maximum(total, 1), 1.0)


def likeness_of_strings(a: str, b: str) -> float:
    """The likeness of two documents, given their fingerprints alone."""
    return float(likeness(Fingerprints.read(a), Fingerprints.read(b))[0])


def edited(text: str, other: str) -> str:
    """The text, its last third replaced by as many characters (or all) of the other one's start."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    """The result's rows for documents and the document after each."""
    changed = [edited(t, o) for t, o in zip(texts, following)]
    n, shifted = len(texts), following[:-1] == texts[1:]
    every = Fingerprints.of(*digests(texts + following[-1:] if shifted else texts + following))
    a, c, b = every.rows(np.arange(n)), every.rows(np.arange(n) + (1 if shifted else n)), Fingerprints.of(*digests(changed))
    out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_chars": list(map(len, texts)), "edited_sha256": list(map(sha256, changed)), "fingerprint": a.strings(), "edited_fingerprint": b.strings(), "near_edited": likeness(a, b), "near_next": likeness(a, c)})
    return out[COLUMNS]


def _with_next(frames: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """compare() over a sorted partition; its last document, whose next one is elsewhere, is left out."""
    ids, texts = [], []
    for frame in frames:
        for i in range(0, len(frame), rows):
            part = frame.iloc[i : i + rows]
            ids += [None if pd.isna(x) else int(x) for x in part["doc_id"]]
            texts += [text_of(t) for t in part["text"]]
            if len(ids) > 1:
                yield compare(ids[:-1], texts[:-1], texts[1:])
            ids, texts = ids[-1:], texts[-1:]


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last document of a sorted partition."""
    first = last = None
    for frame in frames:
        if len(frame):
            first = frame.iloc[:1] if first is None else first
            last = frame.iloc[-1:]
    if first is not None:
        yield pd.DataFrame({"p": [int(first["p"].iloc[0])], "head": [text_of(first["text"].iloc[0])], "doc_id": pd.array([last["doc_id"].iloc[0]], dtype="Int64"), "text": [text_of(last["text"].iloc[0])]})


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness (see `likeness`), which follows from the fingerprints alone.

    The next document has the next smaller doc_id; null comes after all ids, equal ids go by text, and after the last
    the first follows (a single document follows itself). Null text is empty: its sketch has no digests. Texts of any length are
    sketched whole, in as many cells as they need. Rows repeated with one id and text stand next to each other. Other columns, whatever their
    names, are not read; an empty table gives no rows. Texts are
    shuffled once, by ranges of doc_id; only the documents at the ranges' ends meet in a second, small comparison.
    """
    n = partitions_for(docs)
    spread = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").withColumn("p", F.spark_partition_id())
    ordered = spread.sortWithinPartitions(F.desc("doc_id"), F.desc("text"))
    inner = in_frames(ordered, _with_next, SCHEMA)
    edge = in_frames(ordered, _edges, "p int, head string, doc_id long, text string")
    # one row for each partition: small enough for a window over all of them
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("p"))
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = edge.withColumn("following", F.coalesce(F.lead("head").over(order), F.first("head").over(every)))

    def last(frames):
        for frame in frames:
            if len(frame):
                yield compare([None if pd.isna(x) else int(x) for x in frame["doc_id"]], list(frame["text"]), list(frame["following"]))

    return inner.unionByName(in_frames(ends.select("doc_id", "text", "following"), last, SCHEMA))
