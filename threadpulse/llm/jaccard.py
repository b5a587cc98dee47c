"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set intersection verifies them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, in_batches, partitions_for, scramble, shingle_hashes, text_of, word_hashes, WordHashes

TREES, DEPTH, SHINGLE, THRESHOLD, RECALL = 18, 8, 5, 0.8, 0.9999
#: Sets and shingles that meet in one task at most, and sets in a full-depth trie node from which it is searched before prefixes are shortened.
GROUP_DOCS, GROUP_SHINGLES, CROWD = 512, 1_000_000, 128


def chance(similarity, depth: int, trees: int = TREES):
    """Probability that a pair of this similarity shares a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The depth at which shortening ends for every document: there a pair at the threshold meets in some tree with the target probability."""
    for k in range(depth, 0, -1):
        if chance(threshold, k, trees) >= recall:
            return k
    raise ValueError("even one value to a prefix misses the target recall; use more trees")


def shingle_set(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word windows; a text with fewer words (but some) is one window."""
    words = hashes(text.encode("utf-8", "surrogatepass").split())
    return np.unique(shingle_hashes(words, min(size, len(words)))) if len(words) else words


def node_name(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.astype("<u8").tobytes())


def text_name() -> Column:
    """A number that tells the texts under one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, shortest: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, name (see `text_name`), node (name of the shingle set; null without words), n, deep, keys.

    Each tree is a trie of MinHash paths of `depth` values. A trie node is named by a hash chained along its path, so a prefix of a path names
    the node above; deep names the document's node at full depth in each tree, keys that at the shortest prefix.
    """
    shortest = shortest or prefix_depth(trees=trees, depth=depth)
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(text_of(t), word_hashes(), size) for t in frame["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, deep = np.zeros((len(sets), trees), np.uint64), np.zeros((len(sets), trees), np.uint64)
        if full:
            flat = np.concatenate([sets[i] for i in full])
            at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
            with np.errstate(over="ignore"):
                for t in range(trees):
                    path = np.full(len(full), t + 1, np.uint64)
                    for d in range(depth):
                        k = t * depth + d
                        path = scramble(path * np.uint64(0x100000001B3) ^ np.minimum.reduceat(flat * a[k] + b[k], at))
                        if d + 1 == shortest:
                            keys[full, t] = path
                    deep[full, t] = path
        return pd.DataFrame({"doc_id": frame["doc_id"], "name": frame["name"], "node": [node_name(s) if len(s) else None for s in sets], "n": [len(s) for s in sets], "deep": list(deep.view(np.int64)), "keys": list(keys.view(np.int64))})

    return in_batches(docs.select("doc_id", "text", text_name().alias("name")), f, "doc_id long, name long, node binary, n long, deep array<long>, keys array<long>", 1000)


def key_matrix(rows: list, column: str) -> np.ndarray:
    """The rows' keys by tree; 0 (no key to meet at) becomes a number that no other row has."""
    keys = np.array([r[column] for r in rows], np.int64)
    return np.where(keys == 0, -1 - np.arange(len(rows))[:, None], keys)


def _met_first(keys: np.ndarray, key: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of positions) for which `key` is the first trie node they share, so that each pair counts in one group only."""
    tree = int(np.flatnonzero((keys[left[0]] == key))[0])
    met = np.zeros((len(left), len(right)), bool)
    for t in range(tree):
        met |= keys[left, t][:, None] == keys[right, t][None, :]
    i, j = np.nonzero(~met)
    return left[i], right[j]


def group_pairs(rows: list, key: int, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows to verify: met first at this node, not met in a crowded node before, not both complete already."""
    keys, part = key_matrix(rows, "keys"), np.array([r["part"] for r in rows])
    left, right = np.flatnonzero(part == bi), np.flatnonzero(part == bj)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    i, j = _met_first(keys, key, left, right)
    if bi == bj:
        i, j = i[i < j], j[i < j]
    if "complete" in rows[0] and any(r["complete"] for r in rows):
        complete = np.array([r["complete"] for r in rows], bool)
        i, j = i[~(complete[i] & complete[j])], j[~(complete[i] & complete[j])]
    if "crowds" in rows[0] and any(r["crowds"] is not None for r in rows):
        none = [0] * keys.shape[1]
        crowds = key_matrix([{"crowds": none if r["crowds"] is None else r["crowds"]} for r in rows], "crowds")
        apart = np.ones(len(i), bool)
        for t in range(crowds.shape[1]):
            apart &= crowds[i, t] != crowds[j, t]
        i, j = i[apart], j[apart]
    return i, j


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the sets' intersections for pairs of positions."""
    if len(i) <= 200:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[code] > 1
    number = np.cumsum(times > 1) - 1
    code, owner = number[code[often]], owner[often]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(code.max(initial=-1)) + 1, 8192):
        inside = (code >= lo) & (code < lo + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[inside], code[inside] - lo] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def linked(nodes: list[bytes], copies: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float, depth: int, trees: int) -> list[tuple[bytes, int, int, float, bytes]]:
    """(node, documents linked to it, sets linked to it, links expected to be missed at this depth, least node of its part) for nodes with a verified link in this group."""
    n = np.array([len(s) for s in sets], np.int64)
    both = _intersections(sets, i, j)
    ok = both >= threshold * (n[i] + n[j] - both) - 1e-9
    i, j, both = i[ok], j[ok], both[ok]
    p = chance(both / np.maximum(n[i] + n[j] - both, 1), depth, trees)
    degree, times, missed = (np.bincount(i, x, len(nodes)) + np.bincount(j, y, len(nodes)) for x, y in ((copies[j], copies[i]), (np.ones(len(i)), np.ones(len(i))), (1 / p - 1, 1 / p - 1)))
    names = sorted(nodes)
    place = {x: k for k, x in enumerate(names)}
    root = np.array([place[x] for x in nodes])
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    return [(nodes[k], int(degree[k]), int(times[k]), float(missed[k]), names[root[k]]) for k in np.flatnonzero(times > 0)]


def _shared(members: DataFrame, least: int) -> DataFrame:
    """node, tree, key, m, blocks: members (node, n, tree, key) of the trie nodes that hold `least` sets or more."""
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where(F.col("m") >= least)
    size = size.select("key", "m", F.greatest(F.ceil(F.col("m") / GROUP_DOCS), F.ceil(F.col("total") / GROUP_SHINGLES)).cast("int").alias("blocks"))
    # a skewed key of this join is split at run time, as nothing later needs its partitioning
    return members.join(size, "key").select("node", "n", "tree", "key", "m", "blocks")


def _groups(shared: DataFrame) -> DataFrame:
    """node, tree, key, part, bi, bj: trie nodes dealt into groups of bounded size; the blocks of a large one meet two by two."""
    dealt = shared.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("other", other).select("node", "tree", "key", "part", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"))


def _gather(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of each group in one list: dealt by the group and not by its key alone, so that the blocks of a large trie node go to many tasks."""
    return df.repartition(partitions_for(df), "key", "bi", "bj").groupBy("key", "bi", "bj").agg(F.collect_list(F.struct(*cols)).alias("rows"))


def wanted_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """key, bi, bj, node, part: the sets that have a pair to verify in a group, told from keys alone. nodes: node, keys."""

    def needed(frames):
        for frame in frames:
            for key, bi, bj, rows in zip(frame["key"], frame["bi"], frame["bj"], frame["rows"]):
                i, j = group_pairs(rows, key, bi, bj)
                if len(i):
                    k = np.unique(np.concatenate([i, j]))
                    yield pd.DataFrame({"key": key, "bi": np.int32(bi), "bj": np.int32(bj), "node": [rows[x]["node"] for x in k], "part": np.array([rows[x]["part"] for x in k], np.int32)})

    both = groups.select("node", "key", "part", "bi", "bj").join(nodes.select("node", "keys"), "node")
    return cut_lineage(_gather(both, "node", "keys", "part").mapInPandas(needed, "key long, bi int, bj int, node binary, part int"))


def shingles_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, copies, keys, shingles of the wanted sets, from the texts of their least documents. nodes: node, rep, copies, keys."""
    chosen = wanted.select("node").distinct().join(nodes.select("node", "rep", "copies", "keys"), "node")

    def to_sets(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = word_hashes()
        sets = [shingle_set(text_of(t), hashes, size) for t in frame["text"]]
        out = frame.assign(shingles=[s.astype("<u8").tobytes() for s in sets])
        return out[[node_name(s) == x for s, x in zip(sets, frame["node"])]].drop(columns=["text"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(chosen, "rep")
    return in_batches(texts.select("node", "copies", "keys", "text"), to_sets, "node binary, copies long, keys array<long>, shingles binary", 500).dropDuplicates(["node"])


def verified_links(wanted: DataFrame, sets: DataFrame, threshold: float, depth: int, trees: int) -> DataFrame:
    """node, links, found, missed, root: verified links among the wanted sets, one or more rows for each set that has any. sets may have crowds and complete (see `group_pairs`)."""
    cols = ["node", "keys", "part", "copies", "shingles", *(c for c in ("crowds", "complete") if c in sets.columns)]

    def verify(frames):
        for frame in frames:
            for key, bi, bj, rows in zip(frame["key"], frame["bi"], frame["bj"], frame["rows"]):
                i, j = group_pairs(rows, key, bi, bj)
                got = linked([r["node"] for r in rows], np.array([r["copies"] for r in rows], np.int64), [np.frombuffer(r["shingles"], "<u8") for r in rows], i, j, threshold, depth, trees)
                if got:
                    yield pd.DataFrame(got, columns=["node", "links", "found", "missed", "root"])

    return cut_lineage(_gather(wanted.join(sets, "node"), *cols).mapInPandas(verify, "node binary, links long, found long, missed double, root binary"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node reaches over the edges (node, root), by passing labels on and jumping to the label's label.

    All frames are as large as the edges; each round is written to the shared folder."""
    both = cut_lineage(edges.where("node != root").select("node", "root").unionByName(edges.where("node != root").select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct())
    label = cut_lineage(both.groupBy("node").agg(F.min("root").alias("r")).select("node", F.least("node", "r").alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("node", "root"), "root").groupBy("node").agg(F.min("label").alias("near"))
        new = label.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(new.join(jump, "label", "left").select("node", "was", F.coalesce(F.least("label", "far"), "label").alias("label")))
        if new.where("label != was").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def forest_links(docs: DataFrame, nodes: DataFrame, size: int, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """node, links, found, missed, root over the whole forest; nodes: node, rep, copies, n, deep, keys.

    Descent: crowded nodes (`CROWD` sets or more) of the full-depth tries are searched first. Each set's recall so far is then estimated from its
    verified links: a link of similarity s stands for 1 / chance(s) links, and one more link at the threshold is supposed. Where the estimate
    reaches `recall` the set is complete, which takes many close links; the prefixes of all others are shortened to the depth at which even
    a pair at the threshold meets with probability `recall`. There a set meets every other one but pairs searched before and pairs of two complete sets."""
    shortest = prefix_depth(threshold, trees, depth, recall)
    # a set with fewer windows equals what it is similar to, and is in its node already
    nodes = nodes.where(F.col("n") * (1 - threshold) >= threshold - 1e-9)
    shared = cut_lineage(_shared(nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("tree", "key")).withColumn("tree", F.col("tree").cast("byte")), 2))
    wanted = wanted_nodes(nodes, _groups(shared))
    sets = shingles_of(docs, nodes, wanted, size)
    # only below a crowded node can there be another
    crowded = shared.where(F.col("m") >= CROWD)
    if shortest == depth or crowded.isEmpty():
        return verified_links(wanted, sets, threshold, shortest, trees)
    crowded = cut_lineage(_shared(crowded.join(nodes.select("node", "deep"), "node").select("node", "n", "tree", F.col("deep")[F.col("tree").cast("int")].alias("key")), CROWD))
    if crowded.isEmpty():
        return verified_links(wanted, sets, threshold, shortest, trees)
    sets = cut_lineage(sets)
    mine = crowded.groupBy("node").agg(F.map_from_entries(F.collect_set(F.struct("tree", "key"))).alias("by_tree"))
    crowds = cut_lineage(mine.select("node", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.col("by_tree")[t.cast("byte")], F.lit(0).cast("long"))).alias("crowds")))
    at_full = crowds.withColumnRenamed("crowds", "keys")
    found = verified_links(wanted_nodes(at_full, _groups(crowded)), sets.drop("keys").join(at_full, "node"), threshold, depth, trees)
    per = found.groupBy("node").agg(F.sum("found").alias("found"), F.sum("missed").alias("missed"))
    unseen = 1 / chance(threshold, depth, trees) - 1
    complete = per.select("node", ((F.col("missed") + unseen) <= (1 - recall) * (F.col("found") + F.col("missed") + unseen)).alias("complete"))
    known = crowds.join(complete, "node", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    return found.unionByName(verified_links(wanted, sets.join(known, "node", "left").withColumn("complete", F.coalesce("complete", F.lit(False))), threshold, shortest, trees))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_links, n_shingles.

    Two documents are linked where the Jaccard index of their `size`-word windows is at least the threshold; classes are what
    links connect; n_links counts the documents linked to this one, copies too. Copies share one shingle set, which is
    compared once. Every pair of different sets that meets in the forest (see `forest_links`) is verified exactly, in groups of bounded size,
    and no pair becomes a row. Texts with fewer words are one window; texts without words and rows with a null id have no
    links, and class_id is their own id. Rows repeated with one id count as copies. Ties don't matter: labels are least ids.
    Columns other than doc_id and text, whatever their names, are not read; an empty table gives no rows.
    """
    sig, per = _labelled(docs, size, threshold, trees, depth, recall)
    least = per.groupBy("label").agg(F.min("rep").alias("class_id"))
    per = per.join(least, "label").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.select("doc_id", "node", "n").join(per, "node", "left")
    mine = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(mine, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def _labelled(docs: DataFrame, size: int, threshold: float, trees: int, depth: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures, and for each shingle set its rep (least doc_id), copies, links and label (least set of its class)."""
    sig = cut_lineage(signatures(docs, size, trees, depth, prefix_depth(threshold, trees, depth, recall)))
    known = sig.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = cut_lineage(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("deep").alias("deep"), F.first("keys").alias("keys")))
    found = forest_links(docs, nodes, size, threshold, trees, depth, recall)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = nodes.select("node", "rep", "copies").join(links, "node", "left").join(components(found), "node", "left")
    return sig, per.withColumn("label", F.coalesce("label", "node"))


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """The documents without near duplicates: of each class the one with the least doc_id stays.

    Different texts under one id are documents of their own, each judged by its own text. Of rows that agree in id and text one
    stays, whichever's other columns. Texts without words have no duplicates but rows of the same id; rows with a null id all stay. Null texts are
    empty; other columns stay as they are; an empty table gives none."""
    sig, per = _labelled(docs, size, threshold, trees, depth, recall)
    known = sig.where(F.col("doc_id").isNotNull()).join(per.select("node", "label"), "node", "left")
    first = known.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("doc_id", "name")).alias("one")).select("one.*")
    stay = first.unionByName(known.where(F.col("label").isNull()).select("doc_id", "name")).select(F.col("doc_id").alias("_llm_id"), F.col("name").alias("_llm_stays"))
    named = docs.withColumn("_llm_name", text_name())
    once = named.join(stay, (F.col("doc_id") == F.col("_llm_id")) & (F.col("_llm_name") == F.col("_llm_stays")), "left_semi").dropDuplicates(["doc_id", "_llm_name"])
    return once.unionByName(named.where(F.col("doc_id").isNull())).select(*docs.columns)
