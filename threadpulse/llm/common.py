"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space that parts words, as a regular expression's class.
WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{checkpoint_dir(spark).rstrip('/')}/threadpulse-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder will do for a local master only; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "threadpulse-shared")


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The frame written as a table to the shared folder and read again: no later stage computes it anew, and a lost executor takes nothing of it. `codec`: zstd for large tables of text or packed numbers, else the session's."""
    path = shared_dir(df.sparkSession, "table")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: pandas types that keep whole numbers whole beside nulls
EXACT = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def exact_frame(data: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """The batch in pandas; 64-bit numbers beside nulls don't become floats, so no id changes."""
    return data.to_pandas(types_mapper=EXACT.get)


def in_frames(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """mapInPandas whose frames keep 64-bit numbers exact (see `exact_frame`)."""
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(map(exact_frame, batches)):
            yield pa.RecordBatch.from_pandas(out[want.names], schema=want, preserve_index=False)

    return df.mapInArrow(run, schema)


def in_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 2000) -> DataFrame:
    """in_frames with a function of one frame of at most `rows` rows; no more of a batch than that is turned into pandas at once."""
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pandas(f(exact_frame(batch.slice(i, rows)))[want.names], schema=want, preserve_index=False)

    return df.mapInArrow(run, schema)


def in_groups(groups: GroupedData, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """applyInPandas whose frames keep 64-bit numbers exact; for groups of bounded size only."""
    want = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(f(exact_frame(table))[want.names], schema=want, preserve_index=False)

    return groups.applyInArrow(run, schema)


def text_of(x) -> str:
    return x if isinstance(x, str) else ""


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def partitions_for(df: DataFrame) -> int:
    """As many partitions as a shuffle has in this session."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (splitmix's last steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, kept for words met before in at most `limit` entries."""

    def __init__(self, limit: int = 300_000):
        import xxhash

        self.hash, self.limit, self.known = xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, f = self.known, self.hash
        out = list(map(known.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = f(words[i])
            if len(known) > self.limit:
                known.clear()
            known.update(zip(words, out))
        return np.array(out, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """The hashes known to this worker process."""
    return WordHashes()


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of k word hashes; order within the window counts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = scramble(h * np.uint64(0x100000001B3) + words[i : i + n] + MIX)
    return h
