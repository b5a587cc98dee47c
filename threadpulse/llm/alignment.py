"""Alignment of two tokenizers' ids over a corpus; how often two ids meet is counted from sorted runs outside memory."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut_lineage, partitions_for
from .tokens import LARGE, SPELLING, Encoder, Known, flags, runs_of

#: Bytes of text and number of texts that make up a chunk (or one longer text)
CHUNK, CHUNK_DOCS = 4_000_000, 16_384
#: Pairs in a frame of a run, and runs that are merged at a time
FRAME, FAN_IN = 8192, 64


class PieceEncoder:
    """Ids by a sentencepiece model, each distinct word once; equal to the library's plain call.

    The model's pieces hold a space only at their start (or nothing else), so no merge crosses from a character to a space behind it:
    a text whose words are parted by single spaces is the sum of its words, each with a space before it.
    Other texts go to the library whole.
    """

    def __init__(self, path: str, known: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        self.lib, self.known = SentencePieceProcessor(model_file=path), Known(known)
        piece = self.lib.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.lib.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.lib.get_piece_size())]
        if any(b.strip(b" ") and b" " in b[1:] for b in self.bytes):
            raise ValueError("this model has pieces that go on behind a space")

    def _library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.lib.encode(texts.to_pylist(), num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), "<u4", int(size.sum())), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (none null), one after another, and how many each has."""
        odd = flags(pc.match_substring_regex(texts, "^ |  | $|^$"))
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ").cast(pa.large_list(LARGE))
        at, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        ids, size = self.known.look_up(coded.dictionary, self._library)
        start, codes = np.cumsum(size) - size, coded.indices.to_numpy().astype(np.int64)
        n = size[codes]
        upto = np.r_[0, np.cumsum(n)]
        plain = ids[np.repeat(start[codes] - upto[:-1], n) + np.arange(upto[-1])]
        each = np.empty(len(texts), np.int64)
        each[~odd] = np.diff(upto[at - at[0]])
        if not odd.any():
            return plain, each
        whole, each[odd] = self._library(texts.filter(pa.array(odd)))
        out, of_odd = np.empty(int(each.sum()), "<u4"), np.repeat(odd, each)
        out[of_odd], out[~of_odd] = whole, plain
        return out, each


class Aligner:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = Encoder(byte_path, known=200_000, special_as_text=True), PieceEncoder(piece_path)
        vocab, byte_of = self.a.lib.get_vocab(), {s.strip(): b for b, s in enumerate(SPELLING)}
        added = {t.content for t in self.a.lib.get_added_tokens_decoder().values()}
        known = {i: t.encode() if t in added else bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        self.n_a, self.n_b = max(known) + 1, len(self.b.bytes)
        raw = [known.get(i, b"") for i in range(self.n_a)], self.b.bytes
        self.raw = tuple(pa.array(x, pa.large_binary()) for x in raw)
        self.size = tuple(np.array([len(t) for t in x], np.int64) for x in raw)
        # ids as decimals with what may stand behind them: , within a side, | before B's, ; before the next group, nothing at a text's end
        marks = [f"{i}{m}" for i in range(self.n_a) for m in ",|"] + [f"{i}{m}" for i in range(self.n_b) for m in (",", ";", "")]
        self.decimals = pa.array([m.encode() for m in marks], pa.large_binary())

    def tokens(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """(ids by A and by B, numbers of them for each text, bytes of each text), without texts that are empty or not spelt by their tokens."""
        texts = texts.cast(LARGE).fill_null("")
        full = pc.binary_length(texts).to_numpy() > 0
        spaced = pc.binary_join_element_wise(pa.scalar("", LARGE), texts.filter(pa.array(full)), pa.scalar(" ", LARGE))
        ids, upto = self.a.encode(spaced)
        ids, sizes = [np.delete(ids, upto[1:] - 1)], [np.diff(upto) - 1]
        got = self.b.encode(texts.filter(pa.array(full)))
        ids, sizes = [*ids, got[0]], [*sizes, got[1]]
        want = pc.binary_length(spaced).to_numpy().astype(np.int64)
        text, fine = spaced.cast(pa.large_binary()), np.ones(len(spaced), bool)
        for k in (0, 1):
            fine &= self._spells(k, ids[k], sizes[k], text, want)
        ids = [x[np.repeat(fine, n)] for x, n in zip(ids, sizes)]
        each = [np.zeros(len(texts), np.int64) for _ in range(3)]
        where = np.flatnonzero(full)[fine]
        for out, n in zip(each, (*sizes, want)):
            out[where] = n[fine]
        return ids, each[:2], each[2], fine

    def _spells(self, k: int, ids: np.ndarray, sizes: np.ndarray, text: pa.Array, want: np.ndarray) -> np.ndarray:
        """Which texts the ids' joined bytes equal."""
        made = self.raw[k].take(pa.array(ids))
        at = np.frombuffer(made.buffers()[1], np.int64, len(ids) + 1, made.offset * 8)[np.r_[0, np.cumsum(sizes)]]
        fine = np.diff(at) == want
        data = memoryview(made.buffers()[2] or b"")
        whole, start = memoryview(text.buffers()[2] or b""), np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        if fine.all() and data[at[0] : at[-1]] == whole[start[0] : start[-1]]:
            return fine
        for i in np.flatnonzero(fine):
            fine[i] = data[at[i] : at[i + 1]] == whole[start[i] : start[i + 1]]
        return fine

    def align(self, texts: pa.Array) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(columns of each text, and of each link its A id, B id and text).

        Every end of a token closes one link: the tokens of both sides that overlap there. So links are the distinct
        ends, and groups the common ones."""
        (ia, ib), (na, nb), size, _ = self.tokens(texts)
        ends = np.zeros(int(size.sum()), np.uint8)
        ea, eb = np.cumsum(self.size[0][ia]) - 1, np.cumsum(self.size[1][ib]) - 1
        ends[ea] = 1
        ends[eb] += 2
        last_a, last_b = ends[ea] == 3, ends[eb] == 3
        place = np.flatnonzero(ends)
        kind = ends[place]
        is_a, is_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
        at = np.searchsorted(place, np.r_[0, np.cumsum(size)])
        common = np.r_[0, np.cumsum(kind == 3)]
        link_a, link_b = ia[np.cumsum(is_a) - is_a], ib[np.cumsum(is_b) - is_b]
        out = {"n_a": na, "n_b": nb, "n_groups": np.diff(common[at]), "n_links": np.diff(at), "sha": self._digests(ia, ib, na, nb, last_a, last_b)}
        return out, link_a, link_b, np.repeat(np.arange(len(texts)), np.diff(at))

    def _digests(self, ia, ib, na, nb, last_a, last_b) -> list[str]:
        """Digests of the groups' texts; none ('') without tokens."""
        ga, gb = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        order = np.empty(len(ia) + len(ib), np.int64)
        order[np.arange(len(ia)) + (np.cumsum(in_b) - in_b)[ga]] = 2 * ia.astype(np.int64) + last_a
        final = np.zeros(len(ib), np.int64)
        final[np.cumsum(nb)[nb > 0] - 1] = 1
        order[np.arange(len(ib)) + np.cumsum(in_a)[gb]] = 2 * self.n_a + 3 * ib.astype(np.int64) + last_b + final
        text = self.decimals.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], np.int64, len(order) + 1)[np.r_[0, np.cumsum(na + nb)]]
        data = memoryview(text.buffers()[2] or b"")
        return [hashlib.sha256(data[i:j]).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


@functools.lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The tokenizers of this worker process."""
    return Aligner(byte_path, piece_path)


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def write_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: ascending keys and their counts, in zstd frames of FRAME pairs, each after its length."""
    out = []
    for i in range(0, len(keys), FRAME):
        k = keys[i : i + FRAME].astype("<u8")
        frame = _zip(np.array([len(k)], "<u8"), np.diff(k, prepend=np.uint64(0)), counts[i : i + FRAME].astype("<u8"))
        out += [np.array([len(frame)], "<u4").tobytes(), frame]
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A run's frames, one at a time: keys and counts."""
    at = 0
    while at < len(run):
        n = int(np.frombuffer(run, "<u4", 1, at)[0])
        raw = np.frombuffer(zstandard.decompress(run[at + 4 : at + 4 + n]), "<u8").astype(np.int64)
        yield np.cumsum(raw[1 : 1 + raw[0]]), raw[1 + raw[0] :]
        at += 4 + n


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A k-way merge: ascending keys with the sums of their counts, in blocks; one frame of each run is in memory.

    The heap holds the last key of each run's frame. The least of them bounds what all runs can still bring, so all
    that lies up to it is summed and goes out, and its run gives its next frame."""
    left = [read_run(r) for r in runs]
    held = [next(x, None) for x in left]
    heap = [(x[0][-1], i) for i, x in enumerate(held) if x is not None]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for i, x in enumerate(held):
            if x is not None:
                n = int(np.searchsorted(x[0], bound, side="right"))
                if n:
                    keys.append(x[0][:n])
                    counts.append(x[1][:n])
                    held[i] = x[0][n:], x[1][n:]
        while heap and heap[0][0] == bound:
            i = heapq.heappop(heap)[1]
            held[i] = next(left[i], None)
            if held[i] is not None:
                heapq.heappush(heap, (held[i][0][-1], i))
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        yield key[first], np.add.reduceat(count[order], first)


def one_run(runs: list[bytes]) -> bytes:
    """All runs merged into one, FAN_IN at a time."""
    while len(runs) > 1:
        runs = [b"".join(write_run(k, c) for k, c in merged(runs[i : i + FAN_IN])) for i in range(0, len(runs), FAN_IN)]
    return runs[0]


def marked(run: bytes, n_a: int) -> tuple[np.ndarray, np.ndarray]:
    """A merged run's keys, and their counts doubled, plus one where no other pair of the B id has a higher one. Keys are side-major (B id * n_a + A id), so a B id's pairs stand together."""
    frames = [*read_run(run)]
    key, count = np.concatenate([f[0] for f in frames]), np.concatenate([f[1] for f in frames])
    side = key // n_a
    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
    best = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(key))))
    return key, 2 * count + (count == best)


CHUNKS = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, records binary, runs array<struct<radix: int, run: binary>>"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk(al: Aligner, number: int, docs: pa.Array, texts: pa.Array, radices: int, want: pa.Schema) -> pa.RecordBatch:
    """A chunk's row: its texts' columns; its pair-document records by radix, B id, A id and text; and for each radix the run of its pairs."""
    columns, a, b, doc = al.align(texts)
    b = b.astype(np.int64)
    # one whole number orders a record: radix of the B id, B id, A id, text
    keys = np.sort((((b % radices) * al.n_b + b) * al.n_a + a) * CHUNK_DOCS + doc)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    keys, times = keys[first], np.diff(np.append(first, len(keys)))
    pair = keys // CHUNK_DOCS
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
    records = _zip(np.array([len(start), len(keys)], "<u4"), np.diff(np.append(start, len(keys))).astype("<u4"), (keys % CHUNK_DOCS).astype("<u2"), times.astype("<u4"))
    total, pair = np.add.reduceat(times, start) if len(start) else times, pair[start]
    radix, pair = np.divmod(pair, al.n_b * al.n_a)
    cut = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1]]) if len(pair) else np.empty(0, np.int64)
    ends = np.append(cut, len(pair))
    runs = [{"radix": int(radix[i]), "run": write_run(pair[i:j], total[i:j])} for i, j in zip(ends[:-1], ends[1:])]
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    values = [whole(docs), *(whole(pa.array(columns[c], pa.int64())) for c in COUNTS), whole(pa.array(columns["sha"], pa.string()))]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([pa.array([number]), *values, pa.array([records]), pa.array([runs], want.field("runs").type)], want)], schema=want)


def chunked(docs: DataFrame, byte_path: str, piece_path: str, radices: int, chunk_bytes: int) -> DataFrame:
    """Rows of CHUNKS; only these stages run the tokenizers."""
    want = arrow_schema(CHUNKS)

    def run(batches):
        al, number = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in runs_of(batch["text"], chunk_bytes):
                for k in range(i, j, CHUNK_DOCS):
                    n = min(j, k + CHUNK_DOCS) - k
                    yield _chunk(al, number, batch["doc_id"].slice(k, n), batch["text"].slice(k, n), radices, want)
                    number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


def count_pairs(runs: DataFrame, n_a: int, radices: int) -> DataFrame:
    """From rows (chunk, radix, run) the same with `counts`: for each pair of the run, in its order, the corpus-wide count and whether it is the B id's highest.

    One task has all runs of a radix: it merges them, then goes through them once more to answer each. It holds them
    compressed, one frame of FAN_IN of them open, and the distinct pairs of its B ids."""
    schema = "chunk long, radix int, counts binary"
    want = arrow_schema(schema)

    def run(batches):
        rows = [(c, r, x) for batch in batches for c, r, x in zip(batch["chunk"].to_pylist(), batch["radix"].to_pylist(), batch["run"].to_pylist())]
        if not rows:
            return
        keys, marks = marked(one_run([x for _, _, x in rows]), n_a)
        for chunk, radix, x in rows:
            counts = np.concatenate([marks[np.searchsorted(keys, k)] for k, _ in read_run(x)])
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([radix], pa.int32()), pa.array([_zip(counts.astype("<u8"))])], schema=want)

    return runs.repartitionById(radices, "radix").mapInArrow(run, schema)


def _sums(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Whole sums by text; halves of 32 bits keep the floats of bincount exact."""
    low, high = (np.bincount(doc, weights=v, minlength=n).astype(np.int64) for v in ((value & 0xFFFFFFFF), (value >> 32)))
    return low + (high << 32)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answers(want: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' records with the answers to their runs (in the order of their radices): rows of the texts."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch["doc_id"][i].values
            n = len(docs)
            raw = zstandard.decompress(batch["records"][i].as_py())
            pairs, records = (int(x) for x in np.frombuffer(raw, "<u4", 2))
            each, doc, times = np.frombuffer(raw, "<u4", pairs, 8), np.frombuffer(raw, "<u2", records, 8 + 4 * pairs).astype(np.int64), np.frombuffer(raw, "<u4", records, 8 + 4 * pairs + 2 * records).astype(np.int64)
            counts = [np.frombuffer(zstandard.decompress(x["counts"]), "<u8") for x in sorted(batch["answers"][i].as_py() or [], key=lambda x: x["radix"])]
            mark = np.repeat(np.concatenate([np.empty(0, "<u8"), *counts]).astype(np.int64), each)
            best, total = _sums(doc, times * (mark & 1), n), _sums(doc, times * (mark >> 1), n)
            yield pa.RecordBatch.from_arrays([docs, *(batch[c][i].values for c in COUNTS), pa.array(best), pa.array(total), batch["sha"][i].values], schema=want)


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Each text by a byte-level tokenizer (A, with a space before the text) and by a piece model (B), aligned by bytes: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A group ends where tokens of both end; links are overlapping tokens; an id pair's count is its number of links in all
    documents, so n_best and count_sum come from the whole corpus. Documents are taken in chunks of about 4 MB of text. A chunk's
    pair-document records are radix-partitioned by B id and sorted into zstd runs; the runs' pairs, with their numbers in
    the chunk, go to the radix' task (the documents behind them stay), a k-way heap merge counts them, B-major order gives each B id's
    highest count, and the answers stream back to the chunk's records. So a pair comes at most once from each chunk, however many
    documents hold it.

    Null and empty texts, and those whose tokens' bytes are not the text's (a character U+2581, say), have no tokens: zeros, and
    '' for the digest. A long text is a chunk of its own. Null ids stay null, repeated rows count each; other columns,
    whatever their names, are not read; an empty table gives no rows.
    """
    radices = partitions_for(docs)
    n_a = aligner(byte_path, piece_path).n_a
    chunks = cut_lineage(chunked(docs, byte_path, piece_path, radices, chunk_bytes))
    runs = chunks.select("chunk", F.explode("runs").alias("r")).select("chunk", "r.radix", "r.run")
    answers = count_pairs(runs, n_a, radices).groupBy("chunk").agg(F.collect_list(F.struct("radix", "counts")).alias("answers"))
    return chunks.drop("runs").join(answers, "chunk", "left").mapInArrow(functools.partial(_answers, arrow_schema(OUT)), OUT)
