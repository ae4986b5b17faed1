"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, none above the context length; pieces of
equal length form one bucket, and each piece is a whole training sequence of its own.  No sequence holds ids of two
documents, and none needs padding.  One map over the scan: no shuffle, memory bounded by one Arrow batch.

Defined results: a null or empty text is the end id alone; repeated rows and repeated ids are packed once for each
row; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import slices, tidy
from .tokens import encode_texts, forget, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, context: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole contexts first, then n's binary digits from high to low.  The largest power of two up to context is the longest piece."""
    longest, start = 1 << (context.bit_length() - 1), 0
    while n - start >= longest:
        yield start, longest
        start += longest
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


def pack_documents(docs: DataFrame, context: int = 2048, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece.  sequence_id: the partition's number and a count within it.  with_ids adds the ids themselves (array<int>)."""
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        for batch in slices(batches):
            names = SCHEMA.replace(" long", "").split(", ")
            cols: dict[str, list] = {k: [] for k in names}
            flat: list[bytes] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), path, end_id)):
                total = len(ids) >> 2
                for start, length in cuts(total, context):
                    piece = ids[4 * start : 4 * (start + length)]
                    for k, v in zip(names, (doc_id, start, length, zlib.crc32(piece), total, base + n, 0)):
                        cols[k].append(v)
                    if with_ids:
                        flat.append(piece)
                    n += 1
            arrays = [pa.array(cols[k], pa.int64()) for k in names]
            if with_ids:
                ends = pa.array([0, *accumulate(cols["length"])], pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(cols["length"]), [None, pa.py_buffer(b"".join(flat))])))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
        forget(path)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(tidy(pack), SCHEMA + (", ids array<int>" if with_ids else ""))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences in one folder for each length, so that a reader draws batches of equal lengths."""
    packed.write.partitionBy("length").parquet(path)
