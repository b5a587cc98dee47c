"""Token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, in_frames, partitions_for, shared_dir
from .tokens import encoder, runs_of

MAGIC, BLOCK = b"PFOR1\0\0\0", 128
SEGMENT_IDS = 1 << 20


def encode_segment(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Ids as bytes: magic, count; for each block its minimum, width, number of exceptions and start (the index); packed bits; exceptions.

    A block holds 128 ids. Its minimum is subtracted, the width is that of the percentile of what is left; ids that need
    more are stored whole in the exception list (place in the block, value) and their low bits are packed with the others.
    """
    ids = np.asarray(ids, "<u4")
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, blocks], "<u8").tobytes()
    if not n:
        return head
    full = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], "<u4")]).reshape(blocks, BLOCK)
    low = full.min(1)
    delta = full - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    cut = np.partition(delta, rank, axis=1)[:, rank]
    width = np.ceil(np.log2(cut.astype(np.float64) + 1)).astype(np.int64)
    over = (delta >> width[:, None].astype(np.uint64)) > 0
    size = width * (BLOCK // 8)
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                bits = ((delta[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(part), -1)
                packed[start[part][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits, axis=1, bitorder="little")
    where = np.nonzero(over)
    return b"".join([head, low.astype("<u4").tobytes(), width.astype("<u1").tobytes(), over.sum(1).astype("<u1").tobytes(), start.astype("<u8").tobytes(), packed.tobytes(), where[1].astype("<u1").tobytes(), delta[where].astype("<u4").tobytes()])


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of patched frame-of-reference blocks")
    n, blocks = (int(x) for x in np.frombuffer(data, "<u8", 2, 8))
    if not n:
        return np.empty(0, "<u4")
    at = 24

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, k, at)
        at += x.nbytes
        return x

    low, width, extra, start = take("<u4", blocks), take("<u1", blocks).astype(np.int64), take("<u1", blocks).astype(np.int64), take("<u8", blocks).astype(np.int64)
    packed = take("<u1", int((width * (BLOCK // 8)).sum()))
    places, values = take("<u1", int(extra.sum())), take("<u4", int(extra.sum()))
    delta = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                bits = np.unpackbits(packed[start[part][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(part), BLOCK, w)
                for b in range(w):
                    delta[part] |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    delta[np.repeat(np.arange(blocks), extra), places] = values
    return (delta + low[:, None]).ravel()[:n].astype("<u4")


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ids that part the documents into ranges of about equal numbers; one long for each output partition."""
    if n < 2:
        return []
    q = docs.select(F.percentile_approx("doc_id", F.lit([(i + 1) / n for i in range(n - 1)]), F.lit(max(10_000, 20 * n))).alias("q")).first()[0]
    return sorted(set(q or []))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode all texts and write them in ascending doc_id order (null first; equal ids by their token ids).

    The files lie in a Parquet container that Spark commits, so lost executors leave no torn files: a row is a segment
    (part, segment, doc_ids, counts, payload) and its payload is encode_segment's bytes. Texts are not shuffled, only their ids in
    two (or four) bytes each, to the range that holds their doc_id.
    """
    n = partitions_for(docs)
    cuts = np.array(_bounds(docs, n), np.int64)

    encoded_schema = "part int, doc_id long, n long, ids binary"
    want = arrow_schema(encoded_schema)

    def tokens(batches):
        enc = encoder(tokenizer, end_id)
        kind = "<u2" if enc.lib.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for a, b in runs_of(batch["text"]):
                doc = batch["doc_id"].slice(a, b - a)
                ids, at = enc.encode(batch["text"].slice(a, b - a))
                known = pc.is_valid(doc).to_numpy(zero_copy_only=False)
                to = np.where(known, np.searchsorted(cuts, doc.fill_null(0).to_numpy(), side="left"), 0).astype(np.int32)
                raw = ids.astype(kind)
                offsets = (at * raw.itemsize).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(to), doc, pa.array(np.diff(at)), data], schema=want)

    def segments(frames):
        held, total, where, number = [], 0, None, 0

        def flush():
            nonlocal held, total, number
            ids = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for _, k, x in held])
            row = {"part": [where], "segment": [number], "n_ids": [len(ids)], "doc_ids": [[d for d, _, _ in held]], "counts": [[k for _, k, _ in held]], "payload": [encode_segment(ids)]}
            held, total, number = [], 0, number + 1
            return pd.DataFrame(row)

        for frame in frames:
            for p, d, k, x in zip(frame["part"], frame["doc_id"], frame["n"], frame["ids"]):
                if held and (p != where or total + k > SEGMENT_IDS):
                    yield flush()
                if p != where:
                    where, number = int(p), 0
                held.append((None if pd.isna(d) else int(d), int(k), x))
                total += int(k)
        if held:
            yield flush()

    encoded = docs.select("doc_id", "text").mapInArrow(tokens, encoded_schema)
    ordered = encoded.repartitionById(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    out = in_frames(ordered, segments, "part int, segment int, n_ids long, doc_ids array<long>, counts array<long>, payload binary")
    out.write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; ids are decoded from the blocks."""
    files = spark.read.parquet(path)
    out_schema = "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long"
    want = arrow_schema(out_schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, counts = batch["doc_ids"][i].values, batch["counts"][i].values.to_numpy()
                raw, n = memoryview(decode_segment(batch["payload"][i].as_py())).cast("B"), len(counts)
                upto = np.cumsum(counts)
                crc = np.fromiter((zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(upto.tolist(), counts.tolist())), np.int64, n)
                part, segment = (pa.array(np.full(n, batch[c][i].as_py(), np.int32)) for c in ("part", "segment"))
                yield pa.RecordBatch.from_arrays([part, segment, docs, pa.array(upto - counts), pa.array(counts), pa.array(crc)], schema=want)

    docs = files.mapInArrow(run, out_schema)
    # one row for each segment (about a million ids): starts come from a window within parts and one over the parts
    seg = files.select("part", "segment", "n_ids")
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inner = seg.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))
    starts = inner.join(parts, "part").select("part", "segment", (F.col("base") + F.col("inner")).alias("before"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32, one row per document.

    Null text is empty: the end id alone. Null ids come first and stay null; rows repeated with one id are documents of
    their own, in the order of their ids' bytes. Texts of any length are encoded whole (a document over a segment's size is a
    segment of its own). Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    path = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path)
