"""Merkle manifest of a dataset whose nodes keep SHA-256 midstates, so that a changed document is folded to the root without hashing what stands left of it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import cut_lineage, in_frames, in_groups, partitions_for

ARITY = 8
#: Levels that are folded at a time, in bundles of at most ARITY ** LEVELS nodes
LEVELS = 3
BUNDLE = ARITY**LEVELS


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits behind the point of the square (2) or cube (3) root of n."""
    x = round((n << 32 * power) ** (1 / power)) if power == 2 else int((n << 96) ** (1 / 3))
    while x**power > n << 32 * power:
        x -= 1
    while (x + 1) ** power <= n << 32 * power:
        x += 1
    return x & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, math.isqrt(n) + 1))]
ROUND = np.array([_root_bits(p, 3) for p in _PRIMES], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (n x 8 words) after one more block each (n x 16 words). hashlib doesn't hand its states out; these are plain numbers that can be stored and resumed anywhere."""
    w = list(block.T.astype(np.uint32))
    a, b, c, d, e, f, g, h = state.T.astype(np.uint32)
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        p = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        q = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + p, c, b, a, p + q
    return state + np.stack([a, b, c, d, e, f, g, h], 1)


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of messages that end after so many whole blocks."""
    pad = np.zeros((len(state), 16), np.uint32)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[:, 0], pad[:, 14], pad[:, 15] = 1 << 31, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return stored(compress(state, pad))


def stored(words: np.ndarray) -> np.ndarray:
    return words.astype(">u4").view(np.uint8).reshape(len(words), 32)


def words_of(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(len(raw), 8)


def as_text(digests: np.ndarray) -> np.ndarray:
    """Digests as the block that their hexadecimal text is: 64 bytes, 16 words."""
    return np.ascontiguousarray(HEX[digests].reshape(len(digests), 64)).view(">u4").astype(np.uint32)


def joined(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


class Level:
    """One level of the way up: each row's slot among its run, the run's size (0: the row's tree has ended), the state before the slot, and all children's text."""

    def __init__(self, slot: np.ndarray, size: np.ndarray, before: np.ndarray, text: np.ndarray):
        self.slot, self.size, self.before, self.text = slot, size, before, text

    def fold(self, digests: np.ndarray) -> np.ndarray:
        """The parents' digests with each row's digest in its slot: the state before the slot is resumed with it and the siblings right of it."""
        state = compress(self.before, as_text(digests))
        for k in range(1, ARITY):
            has = np.flatnonzero((k > self.slot) & (k < self.size))
            if len(has):
                state[has] = compress(state[has], self.text[has, k])
        return np.where((self.size > 0)[:, None], closed(state, self.size), digests)

    def prove(self, state: np.ndarray, blocks: np.ndarray) -> None:
        """Take the siblings, left to right, into the rows' proof states."""
        for k in range(ARITY):
            has = np.flatnonzero((k != self.slot) & (k < self.size))
            if len(has):
                state[has] = compress(state[has], self.text[has, k])
        blocks += np.maximum(self.size - 1, 0)


def parents(nodes: np.ndarray, run: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For nodes in runs of up to 8 (run: numbers from 0, ascending): each run's digest, its number of children, its states before each child's slot (runs x 8 x 8 words), and the children's text."""
    size = np.bincount(run)
    text = np.zeros((len(size), ARITY, 16), np.uint32)
    text[run, slot] = as_text(nodes)
    state, before = np.tile(START, (len(size), 1)), np.zeros((len(size), ARITY, 8), np.uint32)
    for k in range(ARITY):
        before[:, k] = state
        has = np.flatnonzero(size > k)
        if len(has):
            state[has] = compress(state[has], text[has, k])
    return closed(state, size), size, before, text


def levels_of(nodes: np.ndarray, bundle: np.ndarray, count: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The ways up from the nodes of bundles (numbers from 0, ascending), LEVELS at most or until the whole tree's nodes of
    a level (`count`, for each bundle) are one; each bundle's top digest and what `count` became."""
    out, at, count = [], np.arange(len(nodes)), count.copy()
    for _ in range(LEVELS):
        if (count <= 1).all():
            break
        place = np.arange(len(nodes)) - np.searchsorted(bundle, bundle)
        slot, goes = place % ARITY, count[bundle] > 1
        run = np.cumsum((slot == 0) | ~goes) - 1
        above, size, before, text = parents(nodes, run, np.where(goes, slot, 0))
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        out.append(Level(slot[at], np.where(goes[at], size[run[at]], 0), before[run[at], slot[at]], text[run[at]]))
        nodes = np.where(goes[first][:, None], above, nodes[first])
        at, bundle = run[at], bundle[first]
        count = np.where(count > 1, -(-count // ARITY), count)
    return out, nodes, count


def packed(levels: list[Level]) -> list[bytes]:
    """Each row's way up as bytes: for each level slot, size, state, children's text."""
    n = len(levels[0].slot)
    parts = []
    for x in levels:
        head = np.stack([x.slot, x.size], 1).astype("<u4").view(np.uint8)
        parts += [head, x.before.astype("<u4").view(np.uint8).reshape(n, -1), np.ascontiguousarray(x.text).astype("<u4").view(np.uint8).reshape(n, -1)]
    return [row.tobytes() for row in np.concatenate(parts, 1)]


def unpacked(ways: bytes, rows: int) -> list[Level]:
    """The levels of so many rows' ways, which have the same number of levels."""
    raw = np.frombuffer(ways, "<u4").reshape(rows, -1, 2 + 8 + ARITY * 16)
    return [Level(x[:, 0].astype(np.int64), x[:, 1].astype(np.int64), x[:, 2:10], x[:, 10:].reshape(rows, ARITY, 16)) for x in raw.transpose(1, 0, 2)]


def climb(levels: list[Level], folded: np.ndarray, state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    for x in levels:
        folded = x.fold(folded)
        x.prove(state, blocks)
    return folded


CARRY = "tree string, at long, doc_id long, leaf binary, folded binary, proof binary, blocks long"
WAYS = "tree string, at long, way binary, above long, node binary, n long"


def _bundles(frame: pd.DataFrame, place: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rows in order, each one's bundle (from 0), each bundle's first row, and its tree's count of nodes."""
    frame = frame.assign(block=frame[place] // BUNDLE).sort_values(["tree", "block", place], ignore_index=True)
    new = (frame["tree"].to_numpy() != frame["tree"].shift().to_numpy()) | (frame["block"].to_numpy(np.int64) != frame["block"].shift(fill_value=-1).to_numpy(np.int64))
    first = np.flatnonzero(new)
    return frame, np.cumsum(new) - 1, first, frame["n"].to_numpy(np.int64)[first]


def _with_tops(rows: pd.DataFrame, frame: pd.DataFrame, first: np.ndarray, top: np.ndarray, count: np.ndarray, at: str) -> pd.DataFrame:
    """The rows, and behind them one (with `node`) for each bundle's top."""
    tops = pd.DataFrame({"tree": frame["tree"].to_numpy()[first], at: frame["block"].to_numpy(np.int64)[first], "node": [x.tobytes() for x in top], "n": count})
    out = pd.concat([rows, tops], ignore_index=True)
    return out.astype({c: "Int64" for c in ("at", "doc_id", "blocks", "above", "n") if c in out})


def _first_levels(frame: pd.DataFrame) -> pd.DataFrame:
    """Bundles of leaves: their rows, folded as far as a bundle reaches, and one row for each bundle's top."""
    frame, bundle, first, count = _bundles(frame, "idx")
    levels, top, count = levels_of(joined(frame["leaf"]), bundle, count)
    state, blocks = np.tile(START, (len(frame), 1)), np.zeros(len(frame), np.int64)
    folded = climb(levels, joined(frame["changed"]), state, blocks)
    rows = frame[["tree", "doc_id", "leaf"]].assign(at=frame["block"], folded=[x.tobytes() for x in folded], proof=[x.tobytes() for x in stored(state)], blocks=blocks)
    return _with_tops(rows, frame, first, top, count, "at")


def _ways(frame: pd.DataFrame) -> pd.DataFrame:
    """Bundles of inner nodes: each node's way up as far as a bundle reaches, and one row for each bundle's top."""
    frame, bundle, first, count = _bundles(frame, "at")
    levels, top, count = levels_of(joined(frame["node"]), bundle, count)
    rows = frame[["tree", "at"]].assign(way=packed(levels) if levels else b"", above=frame["block"])
    return _with_tops(rows, frame, first, top, count, "at")


def _climbed(rows: DataFrame) -> DataFrame:
    """Rows of CARRY with the way of the node above them (`way`) and its place there (`above`), gone up that way. A node's rows need not be together."""

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), 4000):
                part = frame[i : i + 4000]
                state, blocks = words_of(joined(part["proof"])).copy(), part["blocks"].to_numpy(np.int64).copy()
                folded = joined(part["folded"]).copy()
                size = part["way"].map(len).to_numpy()
                for k in np.unique(size[size > 0]):  # ways of one number of levels at once
                    who = np.flatnonzero(size == k)
                    s, b = state[who], blocks[who]
                    folded[who] = climb(unpacked(b"".join(part["way"].iloc[who]), len(who)), folded[who], s, b)
                    state[who], blocks[who] = s, b
                yield part.assign(at=part["above"], folded=[x.tobytes() for x in folded], proof=[x.tobytes() for x in stored(state)], blocks=blocks)

    return in_frames(rows, run, CARRY)


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of each `tree` numbered from 0 in the order (column idx), and the tree's number of rows (n). No tree goes through one task: rows are sorted by ranges, and only counts of ranges are summed."""
    ranges = max(partitions_for(df), 2)
    placed = cut_lineage(df.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(ranges, "tree", *order, "salt").sortWithinPartitions("tree", *order, "salt").drop("salt").withColumn("row", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("k"))
    w = Window.partitionBy("tree")
    counts = counts.select("tree", "part", (F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k") - F.col("first")).alias("shift"), F.sum("k").over(w).alias("n"))
    return placed.join(counts, ["tree", "part"]).withColumn("idx", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _dealt(nodes: DataFrame, place: str) -> GroupedData:
    """Whole bundles in groups of about 16 bundles' rows."""
    groups = max(1, nodes.count() // (16 * BUNDLE))
    return nodes.groupBy(F.pmod(F.xxhash64("tree", F.floor(F.col(place) / BUNDLE)), F.lit(groups)).alias("deal"))


def _folded_up(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of CARRY folded to their trees' tops, tops: tree, node) from rows tree, idx, n, doc_id, leaf, changed."""
    first = cut_lineage(in_groups(_dealt(leaves, "idx"), _first_levels, CARRY + ", node binary, n long"))
    rows, nodes = first.where("node is null").drop("node", "n"), first.where("node is not null").select("tree", "at", "node", "n")
    while nodes.agg(F.max("n")).first()[0] not in (None, 1):
        ways = cut_lineage(in_groups(_dealt(nodes, "at"), _ways, WAYS))
        rows = cut_lineage(_climbed(rows.join(ways.where("node is null").select("tree", "at", "way", "above"), ["tree", "at"])))
        nodes = ways.where("node is not null").select("tree", "at", "node", "n")
    return rows, nodes.select("tree", "node")


def leaf_of(columns: list[Column]) -> Column:
    """Digest of the values, each `-` if null, else its UTF-8 byte count, a colon and the value (integers decimal)."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _changed_text() -> Column:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def _finish(frames):
    for frame in frames:
        if len(frame):
            frame["proof"] = [x.tobytes() for x in closed(words_of(joined(frame["proof"])), frame["blocks"].to_numpy(np.int64))]
        yield frame[["tree", "doc_id", "leaf", "folded", "proof"]]


def verify_manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """The manifest of the documents and each one's check against it: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves digest doc_id, source, lang, n_chars and text. Each lang is a tree of runs of 8 in ascending doc_id, and the
    langs' roots (null first, else bytewise) are the leaves of one more. `changed_text` is the text that is checked (by
    default lower-cased A-Z where 3 divides the crc32 of doc_id). Parents keep their SHA-256 states before each child's
    slot; a check resumes the one before its slot with the checked digest and the siblings right of it. A child's
    digest is text of 64 bytes, one block of SHA-256, so states lie at block ends and are eight plain numbers.

    Null values are leaves of their own kind (`-`), a null doc_id is never changed and comes first; null lang is a tree
    of its own. Rows of one doc_id are leaves each, ordered by their leaves' bytes, so equal rows are interchangeable. A
    text of any length is one leaf. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    data = docs.select("doc_id", "source", "lang", "n_chars", "text").withColumn("changed", _changed_text() if changed_text is None else changed_text)
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = data.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of([*values, F.col("text")]).alias("leaf"), leaf_of([*values, F.col("changed")]).alias("changed"))
    rows, subroots = _folded_up(_numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf")]))
    # the langs' roots: each is a leaf of the last tree, and its way up is the same for all rows of the lang
    subroots = cut_lineage(subroots)
    tops = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), [F.col("lang")])
    ways, root = _ways_to_root(tops)
    rows = rows.drop("at").join(ways, "tree")
    done = in_frames(_climbed(rows), _finish, "tree string, doc_id long, leaf binary, folded binary, proof binary")
    text = lambda c: F.lower(F.hex(c))
    done = done.join(subroots.withColumnRenamed("node", "subroot"), "tree").crossJoin(F.broadcast(root))
    return done.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _ways_to_root(tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree: the lang, at, way: its ways through all bundles, above) and the root (one row) of the tree over the langs' roots."""
    names = cut_lineage(tops.select("lang", "idx", "node", "n"))
    ways, nodes = names.select("lang", "idx", F.col("idx").alias("at"), F.lit(b"").alias("way")), names.select(F.lit("").alias("tree"), F.col("idx").alias("at"), "node", "n")
    while nodes.agg(F.max("n")).first()[0] not in (None, 1):
        made = cut_lineage(in_groups(_dealt(nodes, "at"), _ways, WAYS))
        ways = ways.join(made.where("node is null").select("at", F.col("way").alias("next"), "above"), "at").select("lang", "idx", F.col("above").alias("at"), F.concat("way", "next").alias("way"))
        nodes = made.where("node is not null").select("tree", "at", "node", "n")
    return ways.select(F.col("lang").alias("tree"), F.col("idx").alias("at"), "way", F.lit(0).cast("long").alias("above")), nodes.select(F.col("node").alias("root"))


def manifest_sql(levels: int = 7, top_levels: int = 3) -> str:
    """The same rows in DuckDB's SQL, one pair of steps a level: up to 8 ** levels documents of a lang, 8 ** top_levels langs."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    bits = "list_reduce(list_prepend({}, [0,0,0,0,0,0,0,0]::UBIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: {bits.format('xor(a, b)')}), 4294967295::UBIGINT)"
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(value, ("doc_id", "source", "lang", "n_chars")))
    steps = [
        f"d0 AS (SELECT coalesce('=' || lang, '') tree, doc_id, {head} head, text, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{upper}', '{upper.lower()}') ELSE text END changed FROM documents)",
        f"d1 AS (SELECT tree, doc_id, sha256(head || {value('text')}) leaf, sha256(head || {value('changed')}) folded, '' proof FROM d0)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) n FROM d1)",
        "t0 AS (SELECT tree, place, leaf node, n FROM l0)",
    ]

    def climb(leaf: str, nodes: str, tree: str, first: int, count: int) -> None:
        for k in range(first, first + count):
            steps.append(f"r{k} AS (SELECT {tree}, place // 8 place, list(node ORDER BY place) kids, any_value(n) n FROM {nodes}{k} GROUP BY {tree}, place // 8)")
            steps.append(f"{nodes}{k + 1} AS (SELECT {tree}, place, CASE WHEN n > 1 THEN sha256(list_aggregate(kids, 'string_agg', '')) ELSE kids[1] END node, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END n FROM r{k})")
            left, right = "coalesce(list_aggregate(kids[: l.place % 8], 'string_agg', ''), '')", "coalesce(list_aggregate(kids[l.place % 8 + 2 :], 'string_agg', ''), '')"
            same = [f"l.{c} = r.{c}" for c in tree.split(", ")] + ["l.place // 8 = r.place"]
            steps.append(f"{leaf}{k + 1} AS (SELECT l.* REPLACE (CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, l.place // 8 AS place) FROM {leaf}{k} l JOIN r{k} r ON {' AND '.join(same)})")

    climb("l", "t", "tree", 0, levels)
    a = levels + 1
    steps.append(f"u{a} AS (SELECT 0 AS top, row_number() OVER (ORDER BY tree) - 1 AS place, node, count(*) OVER () n, tree FROM t{levels})")
    steps.append(f"m{a} AS (SELECT l.doc_id, l.leaf, l.folded, l.proof, u.node subroot, u.place, 0 AS top FROM l{levels} l JOIN u{a} u USING (tree))")
    climb("m", "u", "top", a, top_levels)
    b = a + top_levels
    steps.append(f"fin AS (SELECT doc_id, leaf, subroot, node root, sha256(proof) proof_sha256, folded folded_root, folded = node AS verified FROM m{b}, u{b})")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM fin"
