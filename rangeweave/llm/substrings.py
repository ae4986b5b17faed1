"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over the bytes of each text: h = (h << 1) + GEAR[byte], so that the lowest 16 bits depend on the last 16 bytes
only.  A chunk ends behind a white-space byte (or, in text without any, at a character) where the hash meets a condition, so boundaries
follow the content: an insertion shifts the chunks beside it and no others.  From each chunk the shortest run of whole chunks with
MIN_WORDS words or more is a group, known by the digest of its chunks in their order: 96 bits, since text is deleted on it.  The document with the smallest doc_id that holds a
group keeps it; elsewhere the group is cut from the text.  So whatever is cut stands, in one piece of MIN_WORDS words or more, in one
earlier document; chunks that earlier documents hold here and there are common phrases and stay.  At either end of a repeated passage
less than two chunks stay.

The digests of a batch of documents travel once for each batch (blocks.py), so a passage that a third of all documents hold
weighs no more than any other.  Memory: one batch of documents, and one bucket of digests.

Defined results: null texts stay null and empty ones empty; a null doc_id comes before all others, and rows of equal doc_id are one
document: they never cut each other; repeats within one document stay; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import blocks
from .common import fresh, materialize, tidy

MIN_WORDS = 30
#: One white-space byte in SPARSE ends a chunk; elsewhere one byte in 4096.
SPARSE = 3
BATCH_ROWS = 1500
PAD = b"\x00" * 32
NO_ID = -(1 << 63)

#: Groups are numbers in base MULTIPLY (odd, so that it has an inverse) modulo 2**64, their chunks' digests the figures.
MULTIPLY = 0x9E3779B97F4A7C15
#: The same with another base makes the digest's further 32 bits.
AGAIN = 0xC2B2AE3D27D4EB4F
OWNER = np.dtype([("id", "<i8"), ("check", "<u4")])

_rng = random.Random(20240229)
GEAR = np.array([0] + [_rng.getrandbits(32) for _ in range(255)], np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte, over the last 32 bytes, by doubling the reach."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunks(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the ends of its chunks."""
    data = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
    h = rolling(data)
    mixed = ((h & np.uint32(0xFFFF)) * np.uint32(40503) >> np.uint32(4)) & np.uint32(0xFFF)
    start_of_char = (np.append(data[1:], 32) & 0xC0) != 0x80
    cut = np.flatnonzero(np.where(SPACE[data], mixed % SPARSE == 0, (mixed == 0) & start_of_char)) + 1
    out, at = [], len(PAD)
    for t in texts:
        ends = cut[np.searchsorted(cut, at, "right") : np.searchsorted(cut, at + len(t), "left")] - at
        out.append(np.append(ends, len(t)) if len(t) else ends[:0])
        at += len(t) + len(PAD)
    return out


def digests(text: bytes, ends: np.ndarray) -> np.ndarray:
    at, out, of = 0, [], xxhash.xxh3_64_intdigest
    for e in ends.tolist():
        out.append(of(text[at:e]))
        at = e
    return np.array(out, np.uint64)


def groups(text: bytes, ends: np.ndarray, min_words: int) -> np.ndarray:
    """For each chunk with min_words words or more from its start on (the others are the text's last) the number of the chunk behind its group."""
    if not len(ends):
        return np.empty(0, np.int64)
    solid = ~SPACE[np.frombuffer(text, np.uint8)]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begun = np.append(0, np.cumsum(first))
    at = np.append(0, ends)
    start = at[:-1]
    within = solid[start] & ~first[start]  # the rest of a word counts as one
    stop = np.maximum(np.searchsorted(begun[at], begun[start] + min_words - within), np.arange(1, len(at)))
    return stop[stop <= len(ends)]


def group_digests(found: np.ndarray, stop: np.ndarray, base: int = MULTIPLY) -> np.ndarray:
    """Digests of the groups, from those of the chunks."""
    n, m = len(found), len(stop)
    if not m:
        return np.empty(0, np.uint64)
    power = lambda base, k: np.cumprod(np.append(np.uint64(1), np.full(k - 1, base, np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(found * power(base, n)))
    h = (total[stop] - total[:m]) * power(pow(base, -1, 1 << 64), m)
    h += (stop - np.arange(m)).astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def batch_digests(texts: list, min_words: int = MIN_WORDS) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each text its bytes, the ends of its chunks, and the digests of its groups: 64 bits, and 32 more."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = chunks(raw)
    found = [(digests(t, e), groups(t, e, min_words)) for t, e in zip(raw, ends)]
    return raw, ends, [group_digests(*f) for f in found], [(group_digests(*f, AGAIN) >> np.uint64(32)).astype(np.uint32) for f in found]


def flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def owners(keys: list[bytes], vals: list[bytes]) -> list[bytes]:
    """The answer of each group's smallest id; a group is its key and its check."""
    key, val = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(vals), OWNER)
    order = np.lexsort((val["id"], val["check"], key))
    k, v = key[order], val[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (v["check"][1:] != v["check"][:-1])])
    out = np.empty(len(v), np.int64)
    out[order] = v["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return blocks.deal(out, np.cumsum([len(x) >> 3 for x in keys]).tolist())


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue()


def cut_runs(raw: bytes, ends: np.ndarray, other: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, first chunk) in bytes of what the groups that others keep cover, overlapping ones as one."""
    if not other.any():
        return []
    hit = np.flatnonzero(other)
    stop = groups(raw, ends, min_words)[hit]  # never falls
    new = np.flatnonzero(np.append(True, hit[1:] >= stop[:-1]))
    first, last = hit[new].tolist(), stop[np.append(new[1:], len(hit)) - 1].tolist()
    return [(int(ends[a - 1]) if a else 0, int(ends[b - 1]), a) for a, b in zip(first, last)]


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the passages cut that an earlier document keeps, and columns n_chunks, n_cut (passages), cut_bytes, kept_by (ids of documents that keep what was cut), with underscores added where docs has the name."""
    buckets = blocks.bucket_count(docs)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = ids_of(batch.column(id_at))
            _, _, found, checks = batch_digests(batch.column(text_at).to_pylist(), min_words)
            check = flat(checks, np.uint32)
            keys, first, place = np.unique(flat(found, np.uint64), return_index=True, return_inverse=True)
            own = np.empty(len(keys), OWNER)
            own["check"], own["id"] = check[first], np.iinfo(np.int64).max
            same = check == own["check"][place]  # of two groups of one key in a batch the first is asked for; the other stays
            np.minimum.at(own["id"], place[same], np.repeat(ids, [len(f) for f in found])[same])
            yield blocks.rows(number, packed(batch), keys, own, buckets)
            number += 1

    new = [StructField(fresh(docs, k), t) for k, t in (("n_chunks", IntegerType()), ("n_cut", IntegerType()), ("cut_bytes", LongType()), ("kept_by", ArrayType(LongType())))]
    schema = StructType([*docs.schema.fields, *new])

    def finish(payload: bytes, answers: bytes) -> pa.Table:
        t = pa.ipc.open_stream(payload).read_all().combine_chunks()
        batch = t.to_batches()[0] if t.num_rows else None
        texts = batch.column(text_at).to_pylist() if batch else []
        ids = ids_of(batch.column(id_at)) if batch else []
        raw, ends, found, checks = batch_digests(texts, min_words)
        keys, first = np.unique(flat(found, np.uint64), return_index=True)
        asked, owner = flat(checks, np.uint32)[first], np.frombuffer(answers, np.int64)
        n_chunks, n_cut, size, kept_by = [], [], [], []
        for i, (data, e, f, c) in enumerate(zip(raw, ends, found, checks)):
            at_key = np.searchsorted(keys, f)
            own = owner[at_key]
            other = (own != ids[i]) & (asked[at_key] == c)
            spans = cut_runs(data, e, other, min_words)
            n_chunks.append(len(e))
            n_cut.append(len(spans))
            size.append(sum(b - a for a, b, _ in spans))
            by = set(own[other].tolist())
            if spans:
                left, at = [], 0
                for a, b, _ in spans:
                    left.append(data[at:a])
                    at = b
                texts[i] = b"".join([*left, data[at:]]).decode("utf-8", "surrogatepass")
            kept_by.append(sorted(None if x == NO_ID else x for x in by) if NO_ID not in by else [None, *sorted(by - {NO_ID})])
        made = [pa.array(n_chunks, pa.int32()), pa.array(n_cut, pa.int32()), pa.array(size, pa.int64()), pa.array(kept_by, pa.list_(pa.int64()))]
        t = t.set_column(text_at, "text", pa.chunked_array([pa.array(texts, t.schema.field(text_at).type)]))
        return pa.table([*t.columns, *made], [*t.column_names, *(f.name for f in new)])

    scattered = materialize(docs.mapInArrow(tidy(scatter), blocks.ROW), "chunks", BATCH_ROWS)
    return blocks.gather(scattered, blocks.reduce_keys(scattered, owners), finish, schema)
