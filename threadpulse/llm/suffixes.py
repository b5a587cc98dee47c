"""Exact removal of repeated byte strings: suffix arrays of shards by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut_lineage, partitions_for, scramble, shared_dir
from .tokens import runs_of

#: Bytes of a repeated string, and of the anchor inside it that decides its shard
LENGTH, ANCHOR = 100, 32
GRAMS = LENGTH - ANCHOR + 1
#: Bytes of text in a chunk (or one longer text), windows hashed at a time, bytes of a shard (or one anchor's segments)
CHUNK, SLICE, SHARD = 4_000_000, 1 << 20, 1_000_000
#: Different segments of one anchor that a task takes at most; the windows of an anchor of more are told apart by all their bytes
HOT = 20_000


# --- suffix arrays ---------------------------------------------------------


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Symbols:
    """A string's suffixes classified: smaller than the one behind them (S) or larger (L), leftmost S ones (LMS), and buckets.

    Suffixes of one type with the same first symbol and equally long runs of it share a bucket; where in the suffix array a bucket
    begins follows from counts alone. A bucket hangs on those of the suffixes one behind, never on itself.
    """

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        step = np.r_[np.diff(s), 1]  # the last symbol is the only least one: its suffix is S
        turn = np.where(step != 0, np.arange(n), n)
        turn = np.minimum.accumulate(turn[::-1])[::-1]
        self.small = step[turn] > 0
        run = turn - np.arange(n)
        self.lms = np.flatnonzero(self.small & np.r_[False, ~self.small[:-1]])
        self.s = s
        longest = int(run.max()) + 1
        # S behind L of the same symbol; long runs come last among L, first among S
        key = (s * 2 + self.small) * longest + np.where(self.small, longest - 1 - run, run)
        self.members = np.argsort(key, kind="stable")
        key = key[self.members]
        self.base = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.size = np.diff(np.append(self.base, n))
        self.bucket = np.empty(n, np.int64)
        self.bucket[self.members] = np.repeat(np.arange(len(self.base)), self.size)

    def place(self, at: np.ndarray, small: bool) -> None:
        """Give all suffixes of a type their places in the suffix array, `at`, from those of the suffixes behind them.

        Buckets whose suffixes' successors all have places are taken together, wave by wave; inside a bucket the successors' places decide."""
        mine = self.small == small
        mine[-1] = False  # nothing stands behind the last
        need = np.bincount(self.bucket[mine], minlength=len(self.base))
        fresh = np.flatnonzero(mine[:-1] & (self.small[1:] != small))
        if small and self.n > 1 and mine[-2]:
            fresh = np.append(fresh, self.n - 2)
        while len(fresh):
            b = self.bucket[fresh]
            np.subtract.at(need, b, 1)
            ready = np.unique(b[need[b] == 0])
            who = self.members[ranges(self.base[ready], self.size[ready])]
            base = np.repeat(self.base[ready], self.size[ready])
            order = np.argsort(base * self.n + at[who + 1])
            at[who[order]] = ranges(self.base[ready], self.size[ready])
            before = who[who > 0] - 1
            fresh = before[mine[before]]

    def induced(self, lms_order: np.ndarray) -> np.ndarray:
        """Places of all suffixes, from the LMS ones in order: first the L ones behind whom an LMS or L one is known, then all S ones."""
        at = np.full(self.n, -1, np.int64)
        # until the S ones have their places, LMS ones of a symbol stand in their order behind its L ones
        symbol = self.s[lms_order]
        ends = np.searchsorted(self.s[self.members], symbol, side="right")
        order = np.argsort(symbol, kind="stable")
        k = np.searchsorted(symbol[order], symbol[order], side="right") - np.arange(len(order))
        at[lms_order[order]] = ends[order] - k
        self.place(at, False)
        at[-1] = 0
        self.place(at, True)
        return at


def _same(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether s[a : a + size] equals s[b : b + size], for each row."""
    same, left, t = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(left):
        eq = s[a[left] + t] == s[b[left] + t]
        same[left[~eq]] = False
        t += 1
        left = left[eq & (size[left] > t)]
    return same


def suffix_places(s: np.ndarray) -> np.ndarray:
    """Each suffix's place in the suffix array of a string of whole numbers whose last is its only least one, by induced sorting."""
    x = Symbols(s)
    if len(x.base) == x.n:  # each bucket has one suffix
        return x.bucket
    if len(x.lms) <= 1:
        return x.induced(x.lms)
    at = x.induced(x.lms)  # any order of LMS suffixes sorts the substrings between them
    order = x.lms[np.argsort(at[x.lms])]
    size = np.zeros(x.n, np.int64)
    size[x.lms] = np.append(np.diff(x.lms) + 1, 1)
    a, b = order[:-1], order[1:]
    new = np.r_[True, size[a] != size[b]]
    check = np.flatnonzero(~new[1:])
    new[1:][check] = ~_same(s, a[check], b[check], size[a[check]])
    name = np.empty(x.n, np.int64)
    name[order] = np.cumsum(new) - 1
    if not new.all():
        order = x.lms[np.argsort(suffix_places(name[x.lms]))]
    return x.induced(order)


def repeated_windows(text: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For segments one after another (bytes, sizes) whose windows have the keys (window p of a segment: key + p): flags of the windows that equal one with a lesser key, for each byte of the text.

    A separator of its own ends each segment, so no prefix goes past it; permuted common prefixes (each one at least the one before, less one) tell which neighbours in the suffix array agree in LENGTH bytes."""
    m, start = len(size), np.cumsum(size) - size
    s = np.empty(len(text) + m, np.int64)
    head = start + np.arange(m)
    is_text = np.ones(len(s), bool)
    is_text[head + size] = False
    s[is_text], s[~is_text] = text.astype(np.int64) + m, np.arange(m)[::-1]
    at = suffix_places(s)
    array = np.argsort(at)
    before = np.full(len(s), -1, np.int64)
    before[array[1:]] = array[:-1]
    windows = size - LENGTH + 1
    common, seg = np.zeros(len(s), np.int64), np.arange(m)
    so_far = np.zeros(m, np.int64)
    for p in range(int(windows.max())):
        seg = seg[windows[seg] > p]
        i = head[seg] + p
        j, n = before[i], np.maximum(so_far[seg] - 1, 0)
        more = np.flatnonzero(j >= 0)
        while len(more):
            more = more[s[i[more] + n[more]] == s[j[more] + n[more]]]
            n[more] += 1
        so_far[seg] = common[i] = n
    first = np.repeat(head, windows)
    p = ranges(np.zeros(m, np.int64), windows)
    where = first + p
    order = np.argsort(at[where])
    where, keys = where[order], (np.repeat(key, windows) + p)[order]
    new = np.flatnonzero(common[where] < LENGTH)
    least = np.repeat(np.minimum.reduceat(keys, new), np.diff(np.append(new, len(keys))))
    out = np.zeros(len(s), bool)
    out[where] = keys != least
    return out[is_text]


# --- anchors ---------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _powers() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two polynomial hashes: a number for each byte, the base's powers and their inverses."""
    out = []
    for k, base in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
        n = SLICE + LENGTH
        values = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F + 2 * k))
        power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        out.append((values, power, inverse))
    return out


class Hashes:
    """Hashes of any stretch of a part of text in constant time."""

    def __init__(self, part: np.ndarray, which: int):
        values, power, self.inverse = _powers()[which]
        self.upto = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=self.upto[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return scramble((self.upto[b] - self.upto[a]) * self.inverse[a])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.upto) - k
        return scramble((self.upto[k:] - self.upto[:-k]) * self.inverse[:n])


class Segments:
    """A chunk's segments: runs of windows (LENGTH bytes inside one document) with one anchor, the leftmost of the ANCHOR-grams of least hash in them. Equal windows have equal anchors, so equal `h`."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        first, windows, h, g = [], [], [], []
        for a in range(0, len(data) - LENGTH + 1, SLICE):
            part = data[a : a + SLICE + LENGTH - 1]
            m = len(part) - LENGTH + 1
            one, two = Hashes(part, 0), Hashes(part, 1)
            gram = one.grams(ANCHOR)
            low = np.uint64((1 << 21) - 1)
            x, span = (gram & ~low) | np.arange(len(gram), dtype=np.uint64), 1
            while 2 * span <= GRAMS:
                x, span = np.minimum(x[:-span], x[span:]), 2 * span
            anchor = (np.minimum(x[:m], x[GRAMS - span : GRAMS - span + m]) & low).astype(np.int64)
            # no window over a document's end
            ends = bounds[(bounds > a) & (bounds < a + m + LENGTH)] - a
            inside = np.cumsum(np.bincount(np.clip(ends - LENGTH + 1, 0, m), minlength=m + 1)[:m] - np.bincount(np.minimum(ends, m), minlength=m + 1)[:m]) <= 0
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1]] & inside
            stop = np.r_[(anchor[1:] != anchor[:-1]) | ~inside[1:], True] & inside
            f, t = np.flatnonzero(new), np.flatnonzero(stop)
            first.append(f + a)
            windows.append(t - f + 1)
            h.append(gram[anchor[f]])
            g.append(two(f, t + LENGTH))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        self.first, self.windows, self.h, self.g = join(first, np.int64), join(windows, np.int64), join(h, np.uint64), join(g, np.uint64)

    def sorted(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order by h, g and rank of the place; in it, which are the first of their h and g)."""
        return first_of(self.h, self.g, rank)


def first_of(h: np.ndarray, g: np.ndarray, *rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*rank[::-1], g, h))
    return order, np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])][: len(order)]


class Chunk:
    """A row of the table of chunks: documents one after another."""

    def __init__(self, row: dict[str, pa.Array], i: int):
        self.number = row["chunk"][i].as_py()
        self.data = np.frombuffer(row["text"][i].as_py(), np.uint8)
        ids = row["doc_id"][i].values
        self.doc_id = ids
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc, self.tie = ids.fill_null(0).to_numpy(), row["tie"][i].values.to_numpy()
        self.bounds = np.r_[0, np.cumsum(row["size"][i].values.to_numpy())].astype(np.int64)

    def rank(self, first: np.ndarray) -> np.ndarray:
        """Order of places in the chunk: by doc_id (null first), then text, row and place in the text."""
        n = len(self.doc)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), self.tie, self.doc, self.known))] = np.arange(n)
        doc = self.document(first)
        return (rank[doc] << 32) + first - self.bounds[doc]

    def document(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, first, side="right") - 1

    def records(self, first, windows, h, g) -> np.ndarray:
        doc = self.document(first)
        out = np.empty(len(first), RECORD)
        values = (h, g, self.known[doc], self.doc[doc], self.tie[doc], np.full(len(doc), self.number), doc, first - self.bounds[doc], first, windows)
        for name, x in zip(RECORD.names, values):
            out[name] = x
        return out


#: A segment: its hashes, what orders it (id or none, text, row, place in the text) and where its chunk has it
RECORD = np.dtype([("h", "<u8"), ("g", "<u8"), ("known", "u1"), ("doc", "<i8"), ("tie", "<i8"), ("chunk", "<i8"), ("number", "<i4"), ("at", "<i4"), ("first", "<i4"), ("windows", "<i4")])
ORDER = ("known", "doc", "tie", "chunk", "number", "at")


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unzip(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _by_radix(h: np.ndarray, radices: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by the radix of their hash, each radix in the order of the rows. Low digits: anchors have small hashes."""
    radix = (h % np.uint64(radices)).astype(np.int64)
    order = np.argsort(radix, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(radix[order]) != 0])[: len(order)]
    for i, j in zip(cut, np.append(cut[1:], len(order))):
        yield int(radix[order[i]]), order[i:j]


# --- stages ----------------------------------------------------------------

CHUNKS = "chunk long, doc_id array<long>, tie array<long>, size array<long>, text binary, keys array<struct<radix: int, keys: binary>>"
PART = "kind string, target long, source long, payload binary"


def _rows(want: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(want), want)], schema=want)


def _chunk_row(number: int, docs: pa.Array, texts: pa.Array, radices: int, want: pa.Schema) -> pa.RecordBatch:
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    tie = [int.from_bytes(hashlib.sha256(t).digest()[:8], "little", signed=True) for t in raw]
    row = {"chunk": [number], "doc_id": [docs.to_pylist()], "tie": [tie], "size": [[len(t) for t in raw]], "text": [b"".join(raw)], "keys": [[]]}
    chunk = Chunk(pa.RecordBatch.from_pydict(row, schema=want), 0)
    found = Segments(chunk.data, chunk.bounds)
    order, first = found.sorted(np.arange(len(found.h)))
    h = found.h[order][first]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    times = np.diff(np.append(np.flatnonzero(np.r_[True, found.h[order][1:] != found.h[order][:-1]][: len(order)]), len(order)))
    different = np.diff(np.append(start, len(h)))
    h = h[start]
    # once in the chunk: 1; else one more than the different segments, at least 2
    number_of = np.where(times > 1, np.maximum(different, 2), 1).astype("<u4")
    row["keys"] = [[{"radix": r, "keys": zstandard.compress(h[w].astype("<u8").tobytes() + number_of[w].tobytes(), 1)} for r, w in _by_radix(h, radices)]]
    return pa.RecordBatch.from_pydict(row, schema=want)


def _keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)


def _table_of_chunks(docs: DataFrame, radices: int, chunk_bytes: int) -> DataFrame:
    """CHUNKS, written as a table in buckets of the chunk's number, so that no later join moves a text."""
    want = arrow_schema(CHUNKS)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in runs_of(batch["text"], chunk_bytes):
                yield _chunk_row(number, batch["doc_id"].slice(i, j - i), batch["text"].slice(i, j - i), radices, want)
                number += 1

    path = shared_dir(docs.sparkSession, "chunks")
    name = "chunks_" + path[-32:]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(radices, "chunk").saveAsTable(name)
    return docs.sparkSession.table(name)


def _count_keys(rows: DataFrame, radices: int, hot: int) -> DataFrame:
    """For each (chunk, radix) a byte for each of its keys: 0 if no other segment has it, 1 if some have, 2 if more than `hot` different ones may."""
    schema = "source long, target int, payload binary"
    want = arrow_schema(schema)

    def run(batches):
        held = [x for b in batches for x in zip(b["chunk"].to_pylist(), b["radix"].to_pylist(), b["keys"].to_pylist())]
        if not held:
            return
        parts = [_keys(x) for _, _, x in held]
        keys, times = np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(times[order].astype(np.int64), first)
        keys, mark = keys[first], ((total > 1) + (total > hot).astype(np.int8)).astype(np.uint8)
        for (chunk, radix, _), (k, _) in zip(held, parts):
            yield _rows(want, [(chunk, radix, _zip(mark[np.searchsorted(keys, k)]))])

    return rows.repartitionById(radices, "radix").mapInArrow(run, schema)


def _spans(first: np.ndarray, windows: np.ndarray) -> bytes:
    return _zip(np.stack([first, first + windows - 1 + LENGTH], 1).astype("<i4"))


def _candidates(want: pa.Schema, radices: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the segments whose anchor others have too. Of equal ones in the chunk the first goes on, the others are repeats: spans. Those of hot anchors go on as windows."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = Chunk(batch, i)
            found = Segments(chunk.data, chunk.bounds)
            answers = sorted(batch["answers"][i].as_py() or [], key=lambda x: x["target"])
            keys = [_keys(x["keys"])[0] for x in sorted(batch["keys"][i].as_py(), key=lambda x: x["radix"])]
            if not keys:
                continue
            keys, marks = np.concatenate(keys), np.concatenate([_unzip(x["payload"], np.uint8) for x in answers])
            order = np.argsort(keys)
            mark = marks[order][np.searchsorted(keys[order], found.h)]
            goes = np.flatnonzero(mark)
            first, windows, h, g, mark = (x[goes] for x in (found.first, found.windows, found.h, found.g, mark))
            order, new = first_of(h, g, chunk.rank(first))
            again, one, many = order[~new], order[new & (mark[order] == 1)], order[new & (mark[order] == 2)]
            out = [("spans", chunk.number, chunk.number, _spans(first[again], windows[again]))]
            records = [chunk.records(first[one], windows[one], h[one], g[one])]
            if len(many):
                at = ranges(first[many], windows[many])
                wh, wg = _window_hashes(chunk.data, at)
                order, new = first_of(wh, wg, chunk.rank(at))
                again, at, wh, wg = at[order[~new]], at[order[new]], wh[order[new]], wg[order[new]]
                out.append(("spans", chunk.number, chunk.number, _spans(again, np.ones(len(again), np.int64))))
                records.append(chunk.records(at, np.ones(len(at), np.int64), wh, wg))
            records = np.concatenate(records)
            out += [("records", r, chunk.number, _zip(records[w])) for r, w in _by_radix(records["h"], radices)]
            yield _rows(want, out)


def _window_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the windows that begin there."""
    out = np.empty((2, len(at)), np.uint64)
    for a in range(0, len(data), SLICE):
        here = np.flatnonzero((at >= a) & (at < a + SLICE))
        if len(here):
            part = data[a : a + SLICE + LENGTH - 1]
            for k in (0, 1):
                out[k, here] = Hashes(part, k)(at[here] - a, at[here] - a + LENGTH)
    return out[0], out[1]


def _settle(want: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All chunks' records of a radix: of equal segments the first stays, the others are spans; an anchor with different segments asks for their texts."""
    held = [x for b in batches for x in b["payload"].to_pylist()]
    if not held:
        return
    r = np.concatenate([_unzip(x, RECORD) for x in held])
    order, new = first_of(r["h"], r["g"], *(r[c] for c in ORDER))
    r = r[order]
    group = np.cumsum(np.r_[True, r["h"][1:] != r["h"][:-1]]) - 1
    several = np.bincount(group, weights=new)[group] > 1
    for kind, who in (("spans", ~new), ("asked", new & several)):
        part = r[who]
        part = part[np.argsort(part["chunk"], kind="stable")]
        cut = np.flatnonzero(np.r_[True, np.diff(part["chunk"]) != 0])[: len(part)]
        rows = []
        for i, j in zip(cut, np.append(cut[1:], len(part))):
            x = part[i:j]
            rows.append((kind, int(x["chunk"][0]), 0, _spans(x["first"].astype(np.int64), x["windows"].astype(np.int64)) if kind == "spans" else _zip(x)))
        yield _rows(want, rows)


def _texts(want: pa.Schema, radices: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked segments with their texts, by radix."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch["text"][i].as_py(), np.uint8)
            r = np.concatenate([_unzip(x, RECORD) for x in batch["asked"][i].as_py()])
            rows = []
            for radix, w in _by_radix(r["h"], radices):
                size = r["windows"][w].astype(np.int64) + LENGTH - 1
                rows.append((radix, _zip(r[w]), zstandard.compress(data[ranges(r["first"][w].astype(np.int64), size)].tobytes(), 1)))
            yield _rows(want, rows)


def _sort_shards(want: pa.Schema, shard: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A radix' segments in shards of whole anchors: each shard's suffix array says which windows repeat an earlier one."""
    held = [x for b in batches for x in zip(b["records"].to_pylist(), b["text"].to_pylist())]
    if not held:
        return
    r, text = np.concatenate([_unzip(x, RECORD) for x, _ in held]), np.concatenate([_unzip(x, np.uint8) for _, x in held])
    size = r["windows"].astype(np.int64) + LENGTH - 1
    start = np.cumsum(size) - size
    # an order of all places: documents by rank, then the place in the text
    order = np.lexsort([r[c] for c in ORDER[::-1][1:]])
    new = np.zeros(len(r), bool)
    for c in ORDER[:-1]:
        new[1:] |= r[c][order][1:] != r[c][order][:-1]
    rank = np.empty(len(r), np.int64)
    rank[order] = np.cumsum(new)
    key = (rank << 32) + r["at"]
    order = np.argsort(r["h"], kind="stable")
    h, upto = r["h"][order], np.cumsum(size[order])
    groups = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    shard_of = np.repeat((upto[groups] - size[order][groups]) // shard, np.diff(np.append(groups, len(h))))
    cut = np.flatnonzero(np.r_[True, np.diff(shard_of) != 0])
    for i, j in zip(cut, np.append(cut[1:], len(h))):
        w = order[i:j]
        again = repeated_windows(text[ranges(start[w], size[w])], size[w], key[w])
        # runs of repeated windows of a segment
        place = np.flatnonzero(again)
        seg = np.searchsorted(np.cumsum(size[w]), place, side="right")
        at = place - (np.cumsum(size[w]) - size[w])[seg] + r["first"][w][seg]
        first = np.r_[True, (np.diff(place) != 1) | (np.diff(seg) != 0)][: len(place)]
        chunk, at, n = r["chunk"][w][seg][first], at[first], np.diff(np.append(np.flatnonzero(first), len(place)))
        order_c = np.argsort(chunk, kind="stable")
        rows = []
        for c in np.unique(chunk):
            x = order_c[np.searchsorted(chunk[order_c], c) : np.searchsorted(chunk[order_c], c, side="right")]
            rows.append(("spans", int(c), 0, _spans(at[x], n[x])))
        yield _rows(want, rows)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(want: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the bytes that spans cover."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = Chunk(batch, i)
            n, spans = len(chunk.data), [_unzip(x, "<i4").reshape(-1, 2) for x in batch["spans"][i].as_py() or []]
            spans = np.concatenate([np.empty((0, 2), np.int64), *spans])
            gone = np.cumsum(np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1))[:n] > 0
            upto = np.r_[0, np.cumsum(~gone)][chunk.bounds]
            begins = gone & ~np.r_[False, gone[:-1]]
            begins[chunk.bounds[:-1][chunk.bounds[:-1] < n]] |= gone[chunk.bounds[:-1][chunk.bounds[:-1] < n]]
            spans_upto = np.r_[0, np.cumsum(begins)][chunk.bounds]
            kept = memoryview(np.ascontiguousarray(chunk.data[~gone]))
            digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            size = np.diff(chunk.bounds)
            yield pa.RecordBatch.from_arrays([chunk.doc_id, pa.array(size), pa.array(size - np.diff(upto)), pa.array(np.diff(spans_upto)), pa.array(digests)], schema=want)


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK, hot: int = HOT, shard_bytes: int = SHARD) -> DataFrame:
    """Each text (UTF-8 bytes) without the bytes that a string of 100 bytes covers which also starts earlier: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every window of 100 bytes has an anchor, the 32-gram of least hash in it, so equal windows meet under equal anchors. Runs of
    windows with one anchor are segments. Only anchors that occur again matter; equal segments are one, with the earliest
    place. Where an anchor has different segments, these lie in one shard, whose suffix array (induced sorting) and
    permuted common prefixes tell which windows repeat an earlier one. An anchor of more than `hot` segments is parted by
    whole windows instead, so no anchor's segments outgrow a task. Texts lie in a table bucketed by chunk and are not moved; hashes,
    places and the asked segments are. Nothing is left out at any size.

    Earlier means a smaller doc_id (null first); different texts of one id are ordered by their digests, and of equal rows one, the first read, is the
    earlier. Null texts are empty; texts under 100 bytes stay whole; a long text is a chunk of its own. Other columns,
    whatever their names, are not read; an empty table gives no rows.
    """
    radices = partitions_for(docs)
    part = functools.partial
    chunks = _table_of_chunks(docs, radices, chunk_bytes)
    keys = chunks.select("chunk", F.explode("keys").alias("k")).select("chunk", "k.radix", "k.keys")
    answers = _count_keys(keys, radices, hot).groupBy(F.col("source").alias("chunk")).agg(F.collect_list(F.struct("target", "payload")).alias("answers"))
    found = cut_lineage(chunks.join(answers.hint("shuffle_hash"), "chunk").mapInArrow(part(_candidates, arrow_schema(PART), radices), PART))
    records = found.where("kind = 'records'").withColumn("radix", F.col("target").cast("int")).select("radix", "payload")
    settled = cut_lineage(records.repartitionById(radices, "radix").mapInArrow(part(_settle, arrow_schema(PART)), PART))
    asked = settled.where("kind = 'asked'").groupBy(F.col("target").alias("chunk")).agg(F.collect_list("payload").alias("asked"))
    segments = "radix int, records binary, text binary"
    texts = chunks.drop("keys").join(asked.hint("shuffle_hash"), "chunk").mapInArrow(part(_texts, arrow_schema(segments), radices), segments)
    sorted_spans = texts.repartitionById(radices, "radix").mapInArrow(part(_sort_shards, arrow_schema(PART), shard_bytes), PART)
    spans = found.unionByName(settled).where("kind = 'spans'").unionByName(sorted_spans)
    spans = spans.groupBy(F.col("target").alias("chunk")).agg(F.collect_list("payload").alias("spans"))
    return chunks.drop("keys").join(spans.hint("shuffle_hash"), "chunk", "left").mapInArrow(part(_cut, arrow_schema(OUT)), OUT)
