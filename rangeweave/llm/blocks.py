"""Blocked exchange of 64-bit keys between batches of documents.

Many operators ask of every key in every document (a word, a shingle, a chunk) for something that all documents decide: how many
documents hold it, which one first.  A row for each key and document would cost far more in the exchange than in the work, so keys
travel in packed arrays:

1. `scatter`: a batch of documents reduces to its distinct keys, sorted, with a value each (the batch's own share, so that a key that
   half the documents hold is one entry of each batch).  The key range is cut into `buckets` equal parts: one row for each batch
   and bucket.  A payload row keeps what the batch needs later.  The rows are written to the shared folder once.
2. `reduce_keys`: all rows of one bucket meet in one group, which sees each key at most once for each batch, and answers each row
   with an array aligned to the row's keys.
3. `gather`: the answers of a batch and its payload meet in one group.

Keys travel as the steps between them, and all numbers byte by byte and compressed (`squeeze`).  A bucket's size is the distinct keys of its range times the batches that hold them, whatever single keys are like; `bucket_count`
sets it from the size of the input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import give_back

ROW = "batch long, bucket int, keys binary, vals binary"
NAMES = ["batch", "bucket", "keys", "vals"]
PAYLOAD = -1
#: Input bytes for one bucket, and the bounds of their number.
BUCKET_BYTES, LEAST, MOST = 6 << 20, 48, 1 << 18


def input_bytes(df: DataFrame) -> int:
    """The planner's sizes of what df reads, summed: for scans those of their files.  (Its estimate of a join is a product, and says nothing.)  Where it knows none, the bytes of the texts are counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size >= int(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()):
        size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long") + 64)).first()[0] or 0
    return size


def bucket_count(df: DataFrame) -> int:
    return max(LEAST, min(MOST, input_bytes(df) // BUCKET_BYTES))


@functools.lru_cache(4)
def edges(buckets: int, bits: int = 64) -> np.ndarray:
    """First keys of buckets 1, 2, ... of keys below 2**bits."""
    return np.array([-(-(i << bits) // buckets) for i in range(1, buckets)], np.uint64)


def squeeze(raw: bytes, width: int) -> bytes:
    """Numbers of so many bytes each, byte by byte and compressed."""
    return bytes([width]) + zstandard.compress(np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes(), 1)


def expand(data: bytes) -> bytes:
    return np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1).T.tobytes()


def squeezed_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)).tobytes(), 8)


def expanded_keys(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(expand(data), np.uint64), dtype=np.uint64).tobytes()


def rows(batch: int, payload: bytes, keys: np.ndarray, vals: np.ndarray, buckets: int) -> pa.RecordBatch:
    """keys: sorted distinct uint64; vals: aligned with them, of any type."""
    cut = [0, *np.searchsorted(keys, edges(buckets)).tolist(), len(keys)]
    full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    parts = [squeezed_keys(keys[cut[b] : cut[b + 1]]) for b in full]
    held = [squeeze(vals[cut[b] : cut[b + 1]].tobytes(), vals.dtype.itemsize) for b in full]
    return pa.RecordBatch.from_arrays([pa.array([batch] * (len(full) + 1), pa.int64()), pa.array([PAYLOAD, *full], pa.int32()), pa.array([b"", *parts], pa.binary()), pa.array([payload, *held], pa.binary())], NAMES)


def payloads(scattered: DataFrame) -> DataFrame:
    return scattered.where(F.col("bucket") == PAYLOAD)


def reduce_keys(scattered: DataFrame, answer: Callable[[list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """For each bucket: answer(keys of its rows, vals of its rows) -> one array for each row, in column vals."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        keys, vals = [expanded_keys(k) for k in t.column("keys").to_pylist()], [expand(v) for v in t.column("vals").to_pylist()]
        out = [squeeze(v, 8 * len(v) // len(k)) for k, v in zip(keys, answer(keys, vals))]
        return pa.table([t.column("batch"), t.column("bucket"), pa.nulls(len(out), pa.binary()), pa.array(out, pa.binary())], NAMES)

    return scattered.where(F.col("bucket") != PAYLOAD).groupBy("bucket").applyInArrow(run, ROW)


def gather(scattered: DataFrame, answers: DataFrame, finish: Callable[[bytes, bytes], Iterator[pa.Table] | pa.Table], schema) -> DataFrame:
    """finish(payload, the answers of all the batch's keys in the keys' order) -> rows."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        order = np.argsort(t.column("bucket").to_numpy(), kind="stable")  # the payload comes first
        vals = t.column("vals")
        return finish(vals[int(order[0])].as_py(), b"".join(expand(vals[int(i)].as_py()) for i in order[1:]))

    both = payloads(scattered).select("batch", "bucket", "vals").unionByName(answers.select("batch", "bucket", "vals"))
    return both.groupBy("batch").applyInArrow(run, schema)


def meet(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of several rows, each entry's place among them, and where each row's entries end."""
    flat = np.frombuffer(b"".join(keys), np.uint64)
    distinct, place = np.unique(flat, return_inverse=True)
    return distinct, place, np.cumsum([len(k) >> 3 for k in keys]).tolist()


def deal(values: np.ndarray, ends: list[int]) -> list[bytes]:
    """An array over all entries cut into the rows' arrays."""
    return [values[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]


def least(keys: list[bytes], vals: list[bytes]) -> list[bytes]:
    """The answer of each key's smallest 64-bit value."""
    distinct, place, ends = meet(keys)
    out = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(out, place, np.frombuffer(b"".join(vals), np.int64))
    return deal(out[place], ends)
