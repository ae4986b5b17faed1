"""Token ids in files of a static range asymmetric numeral system (rANS).

Documents are dealt into ranges of ascending doc_id.  Within a range, the ids of consecutive documents form segments of up to
SEGMENT ids and the rest of the document that fills it.  Each segment is one row of the file set, which is stored as Parquet
so that Spark's own commit protocol and any file system it knows make it safe:

    table   frequencies of the segment's ids, scaled to 2**SCALE, shared by its blocks (zlib)
    blocks  the ids in blocks of BLOCK ids, each coded by LANES interleaved states; any block decodes by itself
    index   byte offset and crc32 of each block: the checkpoints where parallel decoders start

A decoder checks that every block's states end where encoding began, and its crc32 over the decoded ids, and raises on damage.

Coding: state x in [2**16, 2**32), 16-bit words.  Encoding runs backwards over the rows of LANES ids; each lane emits at most one
word a step, so that all lanes advance at once in numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import blocks
from .common import materialize, tidy
from .tokens import encode_texts, tokenizer_path

SCALE, LANES, BLOCK, SEGMENT = 16, 2048, 1 << 18, 1 << 21
LOW = np.uint32(1 << 16)
MAGIC = b"RWA1"
#: Input bytes for one range of documents, and the least number of ranges.
RANGE_BYTES, LEAST_RANGES = 12 << 20, 48


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of 2**SCALE in all, at least 1 for each id that occurs (at most 2**SCALE ids may)."""
    total, size = int(counts.sum()), 1 << SCALE
    freq = np.where(counts > 0, np.maximum(1, counts * size // max(total, 1)), 0)
    short = size - int(freq.sum())
    if short > 0:
        freq[np.argmax(freq)] += short
    while short < 0:  # taken from the most frequent ones, which lose least
        order = np.argsort(-freq, kind="stable")[:256]
        take = np.minimum(np.maximum(freq[order] // 8, (freq[order] > 1).astype(np.int64)), freq[order] - 1)
        take = np.minimum(take, np.maximum(0, -short - (np.cumsum(take) - take)))
        freq[order] -= take
        short += int(take.sum())
    return freq


class Table:
    """Frequencies, their running sums and the inverse of a segment's ids."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint32)
        self.start = (np.cumsum(freq) - freq).astype(np.uint32)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        if len(symbols) > 1 << SCALE:
            raise ValueError("a segment has more distinct ids than the table has slots")
        return cls(symbols, scaled(counts[symbols].astype(np.int64)))

    def dump(self) -> bytes:
        gaps = np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4")
        return zlib.compress(struct.pack("<I", len(gaps)) + gaps.tobytes() + (self.freq - 1).astype("<u4").tobytes(), 6)

    @classmethod
    def load(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", raw)
        gaps, freq = np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<u4", n, 4 + 4 * n)
        return cls(np.cumsum(gaps, dtype=np.uint32), freq + 1)


def encode_block(slots: np.ndarray, table: Table) -> bytes:
    """slots: positions of the ids in the table."""
    n = len(slots)
    lanes = min(LANES, max(1, n))
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint32)
    freq, start, words = table.freq, table.start, []
    for r in range(rows - 1, -1, -1):
        s = slots[r * lanes : (r + 1) * lanes]
        f, v = freq[s], x[: len(s)]
        full = v >= f.astype(np.uint64) << 16 if (f == 1 << SCALE).any() else v >= f << np.uint32(16)
        if full.any():
            words.append(v[full].astype("<u2")[::-1])
            v = np.where(full, v >> np.uint32(16), v)
        q = v // f
        x[: len(s)] = v + q * (np.uint32(1 << SCALE) - f) + start[s]  # (q << SCALE) + v % f + start
    body = (np.concatenate(words)[::-1] if words else np.empty(0, "<u2")).astype("<u2").tobytes()
    return struct.pack("<II", n, lanes) + x.astype("<u4").tobytes() + body


def decode_block(data: bytes, table: Table, slot_of: np.ndarray) -> np.ndarray:
    n, lanes = struct.unpack_from("<II", data)
    x = np.frombuffer(data, "<u4", lanes, 8).copy()
    words, at = np.frombuffer(data, "<u2", -1, 8 + 4 * lanes), 0
    out = np.empty(n, np.uint32)
    freq, start, mask = table.freq, table.start, np.uint32((1 << SCALE) - 1)
    for r in range(-(-n // lanes) if n else 0):
        k = min(lanes, n - r * lanes)
        v = x[:k]
        low = v & mask
        s = slot_of[low]
        out[r * lanes : r * lanes + k] = s
        v = freq[s] * (v >> np.uint32(SCALE)) + low - start[s]
        few = np.flatnonzero(v < LOW)
        if len(few):
            v[few] = (v[few] << np.uint32(16)) | words[at : at + len(few)]
            at += len(few)
        x[:k] = v
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block's states do not end where encoding began")
    return table.symbols[out]


def encode_segment(ids: np.ndarray) -> bytes:
    """A self-contained segment: header, table, index of checkpoints, blocks."""
    if len(ids) == 0:
        return MAGIC + struct.pack("<III", 0, 0, 0)
    table = Table.of(ids)
    place = np.zeros(int(table.symbols[-1]) + 1, np.uint32)
    place[table.symbols] = np.arange(len(table.symbols), dtype=np.uint32)
    blocks, index, at = [], b"", 0
    for i in range(0, len(ids), BLOCK):
        part = ids[i : i + BLOCK]
        blocks.append(encode_block(place[part], table))
        index += struct.pack("<QI", at, zlib.crc32(part.astype("<u4").tobytes()))
        at += len(blocks[-1])
    head = table.dump()
    return MAGIC + struct.pack("<III", len(ids), len(head), len(blocks)) + head + index + b"".join(blocks)


def decode_segment(data: bytes, only: range | None = None) -> np.ndarray:
    """The ids, or those of some blocks; ValueError where a checksum fails."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, size, blocks = struct.unpack_from("<III", data, 4)
    if not n:
        return np.empty(0, np.uint32)
    table = Table.load(data[16 : 16 + size])
    slot_of = np.repeat(np.arange(len(table.freq), dtype=np.uint32), table.freq)
    base, out = 16 + size + 12 * blocks, []
    for b in only if only is not None else range(blocks):
        at, crc = struct.unpack_from("<QI", data, 16 + size + 12 * b)
        end = struct.unpack_from("<Q", data, 16 + size + 12 * (b + 1))[0] if b + 1 < blocks else len(data) - base
        ids = decode_block(data[base + at : base + end], table, slot_of)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b}: checksum")
        out.append(ids)
    return np.concatenate(out)


FILE = "part long, segment long, before long, n_ids long, docs binary, absent binary, lengths binary, payload binary"
COLUMNS = [c.split()[0] for c in FILE.split(", ")]
KINDS = [pa.int64()] * 4 + [pa.binary()] * 4


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes documents in ascending doc_id order into the file format and returns the written files as a table of segments.

    A segment closes with the document that fills it.  `docs`, `absent` and `lengths` name its documents (64-bit ids, marks of null
    ids, 64-bit counts); `before` counts the ids of the range's earlier segments.  Null texts are empty, null ids come first, rows of
    equal ids stay beside each other in any order, other columns are not written, no rows give no segment.
    """
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def closed() -> pa.RecordBatch:
            row = [part, segment, before, n, np.array([d or 0 for d, _ in held], "<i8").tobytes(), bytes(d is None for d, _ in held), np.array([len(x) for _, x in held], "<i8").tobytes(), encode_segment(np.concatenate([x for _, x in held]))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, KINDS)], COLUMNS)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), path, end_id)):
                held.append((doc_id, np.frombuffer(raw, "<u4")))
                n += len(raw) >> 2
                if n >= SEGMENT:
                    yield closed()
                    held, n, segment, before = [], 0, segment + 1, before + n
        if held:
            yield closed()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the text's hash cuts an id that very many rows share into several ranges
    order = ["doc_id", F.xxhash64("text")]
    ordered = picked.repartitionByRange(max(LEAST_RANGES, blocks.input_bytes(docs) // RANGE_BYTES), *order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(tidy(encode), FILE), "rans")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Segments decode independently of each other.  Only the ranges' totals, one row for each file, are summed in order; their number
    is that of the files, so their table is small enough to send to every task.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, absent, lengths, payload in zip(*(c.to_pylist() for c in batch.columns)):
                raw = memoryview(decode_segment(payload).astype("<u4").tobytes())
                n = np.frombuffer(lengths, "<i8")
                end = np.cumsum(n)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(end - n, end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int64()), pa.array(np.frombuffer(docs, "<i8"), mask=np.frombuffer(absent, "?")), pa.array(before + end - n), pa.array(n), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    rows = files.select("part", "before", "docs", "absent", "lengths", "payload").mapInArrow(tidy(decode), "part long, doc_id long, within long, n_tokens long, ids_crc32 long")
    decoded = materialize(rows, "decoded", 2)  # rows of some megabytes: two at a time
    return decoded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
