"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import functools
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut_lineage, in_groups
from .tokens import encoder, runs_of

CAPACITY = 1024
DEME = 2000
ISLANDS = 2


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; only longer documents are cut, the first piece takes the remainder."""

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    want = arrow_schema(schema)

    def run(batches):
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            for i, j in runs_of(batch["text"]):
                ids, at = enc.encode(batch["text"].slice(i, j - i))
                raw, n = memoryview(ids.astype("<u4")).cast("B"), np.diff(at)
                first = np.where(n <= capacity, n, (n - 1) % capacity + 1)
                pieces = 1 + (n - first) // capacity
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                begin = 4 * (at[:-1][row] + start)
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())), np.int64, len(row))
                doc = batch["doc_id"].slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], schema=want)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Bins:
    """Bins of items being filled; finds the fullest bin that an item fits in by a bit set of the free sizes."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.by_free, self.mask = capacity, [], [], {}, 0

    def add(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self._list(len(self.items) - 1, free)

    def _list(self, b: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        m = self.mask >> size
        if not m:
            self.add([item], self.capacity - size)
            return
        free = (m & -m).bit_length() - 1 + size
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.items[b].append(item)
        self.free[b] = free - size
        self._list(b, free - size)

    def relist(self) -> None:
        """The bins by their free sizes anew, after items have been traded."""
        self.by_free, self.mask = {}, 0
        for b, free in enumerate(self.free):
            self._list(b, free)


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins first, then the more uneven fill (well-filled bins are what crossover passes on)."""
    return -len(bins.items), sum((bins.capacity - f) ** 2 for f in bins.free)


def swap_in(bins: Bins, displaced: list[int], sizes: list[int]) -> list[int]:
    """Bins trade one item for a larger displaced one that still fits, the fullest result first; returns the displaced items, which become smaller and so easier to place."""
    pool = sorted((sizes[x], x) for x in displaced)
    for b, items in enumerate(bins.items):
        free = bins.free[b]
        if not free or not pool:
            continue
        best = None
        for k, x in enumerate(items):
            j = bisect.bisect_right(pool, (sizes[x] + free, len(sizes))) - 1
            if j >= 0 and pool[j][0] > sizes[x] and (best is None or pool[j][0] - sizes[x] > best[0]):
                best = (pool[j][0] - sizes[x], k, j)
        if best:
            gain, k, j = best
            out, items[k] = items[k], pool.pop(j)[1]
            bisect.insort(pool, (sizes[out], out))
            bins.free[b] = free - gain
    bins.relist()
    return [x for _, x in reversed(pool)]


def crossover(a: Bins, b: Bins, sizes: list[int], rng: random.Random, slack: int = 2) -> Bins:
    """A child of a with whole well-filled bins of b: bins of a that share items with them are opened, and what they leave is traded into
    the other bins where it fills them better, then best-fitted."""
    good = [k for k, f in enumerate(b.free) if f <= slack]
    give = rng.sample(good, max(1, len(good) // 2)) if good else []
    mine = {x for k in give for x in b.items[k]}
    child, displaced = Bins(a.capacity), []
    for k in give:
        child.add(list(b.items[k]), b.free[k])
    poor = max(a.free) if a.free else 0
    for items, free in zip(a.items, a.free):
        if any(x in mine for x in items):
            displaced += [x for x in items if x not in mine]
        elif free > slack and (free == poor or rng.random() < 0.3):
            displaced += items  # mutation: poorly filled bins are opened too
        else:
            child.add(list(items), free)
    for x in swap_in(child, displaced, sizes):
        child.best_fit(x, sizes[x])
    return child


def as_bins(packing: list[int], sizes: list[int], capacity: int) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(packing):
        groups.setdefault(b, []).append(i)
    out = Bins(capacity)
    for items in groups.values():
        out.add(items, capacity - sum(sizes[i] for i in items))
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, noise: float = 0.0, rng: random.Random | None = None) -> Bins:
    """Best fit of the items from large to small; with noise the order is shaken a little."""
    order = list(range(len(sizes)))
    order.sort(key=(lambda i: sizes[i] * (1 + noise * (rng.random() - 0.5))) if noise else sizes.__getitem__, reverse=True)
    out = Bins(capacity)
    for i in order:
        out.best_fit(i, sizes[i])
    return out


def evolve(sizes: list[int], capacity: int, seed: int, migrant: list[int] | None = None, population: int = 5, generations: int = 40, patience: int = 12) -> list[int]:
    """The best packing of one island: a bin number for each item. migrant: the elite packing of another island, which joins the population.

    The first individual is best fit decreasing; where it needs no more bins than the sizes' sum demands, it is the best there is and
    nothing is bred. Otherwise `generations` children at most are bred; `patience` of them without a fitter best one end the epoch."""
    rng, floor, pool = random.Random(seed), -(-sum(sizes) // capacity), []
    if migrant is not None:
        pool.append(as_bins(migrant, sizes, capacity))
    while len(pool) < population and not (pool and len(pool[-1].items) == floor):
        pool.append(best_fit_decreasing(sizes, capacity, 0.1 * len(pool), rng))
    pool.sort(key=fitness, reverse=True)
    best, stale = fitness(pool[0]), 0
    for _ in range(generations):
        if len(pool[0].items) == floor or len(pool) < 2 or stale >= patience:
            break
        i, j = rng.sample(range(len(pool)), 2)
        child = crossover(pool[i], pool[j], sizes, rng)
        if fitness(child) > fitness(pool[-1]):
            pool[-1] = child
            pool.sort(key=fitness, reverse=True)
        stale = 0 if fitness(pool[0]) > best else stale + 1
        best = max(best, fitness(pool[0]))
    out = [0] * len(sizes)
    for b, items in enumerate(pool[0].items):
        for i in items:
            out[i] = b
    return out


def _epoch(items: DataFrame, demes: int, capacity: int, level: int, last: bool) -> DataFrame:
    """One epoch pair on islands: each deme (a bounded set of items) has ISLANDS islands; each evolves, hands its elite to the next island, evolves again; the best island's packing is taken.

    Adds bin and settled: of the bins with more than a 32nd free the emptiest, a sixteenth of the deme's bins at most, are not
    settled (but in the last epoch) and migrate, so what is left shrinks sixteenfold even where sizes never fit together."""
    deme = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(demes))
    start = items.withColumn("deme", deme).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    more = lambda schema, *cols: T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in cols)])
    schema = more(start.schema, ("bin", T.IntegerType()), ("n_bins", T.IntegerType()))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key"], ascending=False, kind="stable").reset_index(drop=True)
        bins = evolve(frame["length"].tolist(), capacity, 1000 * level + int(frame["island"].iloc[0]))
        return frame.assign(bin=np.array(bins, np.int32), n_bins=np.int32(max(bins) + 1))

    first = in_groups(start.groupBy("deme", "island"), grow, schema)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        best, best_n = None, 0
        floor = -(-int(frame.loc[frame["island"] == 0, "length"].sum()) // capacity)
        parts = [p.sort_values(["length", "key"], ascending=False, kind="stable").reset_index(drop=True) for _, p in frame.groupby("island")]
        sizes = parts[0]["length"].tolist()
        elites = [p["bin"].tolist() for p in parts]
        for k, own in enumerate(elites):
            migrant = elites[k - 1]
            got = min(own, migrant, key=max)
            if max(got) + 1 > floor:
                got = min(got, evolve(sizes, capacity, 7000 * (level + 1) + k, migrant=got), key=max)
            if best is None or max(got) < best_n:
                best, best_n = got, max(got)
            if best_n + 1 == floor:
                break
        out = parts[0].assign(bin=np.array(best, np.int32))
        used = out.groupby("bin")["length"].sum().sort_values(kind="stable")
        poor = used[used < capacity - capacity // 32].index[: max(1, len(used) // 16)]
        return out.assign(settled=~out["bin"].isin(poor) | last).drop(columns=["island", "n_bins"])

    done = in_groups(first.groupBy("deme"), finish, more(items.schema, ("deme", T.LongType()), ("bin", T.IntegerType()), ("settled", T.BooleanType())))
    return cut_lineage(done)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, deme: int = DEME) -> DataFrame:
    """pieces with sequence_id and offset. Full pieces are sequences of their own; the others are packed on islands.

    Items of bins that are not well filled migrate to the next epoch, where fewer islands take them, until one deme holds
    all that is left. No step sees more than about a deme's items in one task."""
    pieces = cut_lineage(pieces.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())))
    names = pieces.columns
    full = pieces.where(F.col("length") >= capacity).select(*names, F.lit(0).cast("long").alias("offset"), (-1 - F.monotonically_increasing_id()).alias("sequence_id"))
    left, settled, level, before = pieces.where(F.col("length") < capacity), [], 0, 0
    n = left.count()
    while n:
        demes = max(1, -(-n // deme))
        done = _epoch(left, demes, capacity, level, demes == 1)
        # a number of its own for each bin: demes count on over the levels, and no deme has 2^24 bins
        settled.append(done.where("settled").select(*names, ((F.lit(before) + F.col("deme")) * (1 << 24) + F.col("bin")).alias("sequence_id")))
        left, level, before = done.where(~F.col("settled")).select(*names), level + 1, before + demes
        n = 0 if demes == 1 else left.count()
    if not settled:
        return full
    # at most a few hundred items share a sequence unless they are tiny, so its members are placed by a window
    w = Window.partitionBy("sequence_id").orderBy("key", "doc_id", "piece")
    packed = functools.reduce(DataFrame.unionByName, settled).withColumn("offset", (F.sum("length").over(w) - F.col("length")).cast("long"))
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, deme: int = DEME) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: one piece that holds the end id. Repeated rows are packed each on its own; null ids too, and stay null.
    A text of any length is encoded whole and cut into pieces. Items of equal size go in the order of a hash. An empty table gives no
    rows; columns other than doc_id and text, whatever their names, are not read.
    """
    return pack_pieces(cut_pieces(docs, tokenizer, capacity, end_id), capacity, deme).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
