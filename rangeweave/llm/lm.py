"""Language-model scoring with a hashed maximum-entropy model.

A text's tokens are its lower-cased words and one end.  A softmax chooses where the next token comes from, by the history:

* one of CLASSES classes of words, by hashed features: the word before (n-gram), and the words two and three places back alone (skips).  Each hashed
  feature is a row of weights, one for each class.  Within a class a token's probability follows its count under add-one smoothing, with one place for all
  tokens that training has not seen;
* or what has followed the word before in training: P(token | before) = pairs of the two / occurrences of the one before.  How often that is so is a gate of
  its own, a weight for each size of the history's count.

All of it sums to one.  The pairs (word-level n-gram features) are hashed into a space that is sized by the input and kept by key range, a row for each pair
that occurs: what the model remembers grows with the corpus.  The classes' weights are of a fixed size.

Classes come from the corpus: word endings (hashed) are clustered by which endings they follow.  Everything is counted over all training documents:

1. Batches of documents become arrays of token numbers; each sends its distinct words and pairs once, by key range (as blocks.py does), and is answered
   with their counts in the whole corpus.  From then on a batch is one row with all it needs.
2. The classes' weights start from the counts of features beside classes, the gates from one half.
3. ROUNDS synchronous updates: every task sums gradients (expected and observed counts) over its batches, with each training token's own occurrence left
   out of its pair's count; the sums over all tasks move the weights.  The result does not depend on how documents are dealt into tasks, but for rounding.

What the driver holds is bounded: FEATURES x PLACES x CLASSES weights, ENDINGS x ENDINGS counts.  No task holds more than a few batches, or one key range.

Defined results: null and empty texts are the end alone; rows are scored each by itself, repeated ones alike; with no training document all counts
are 0; other columns are ignored; words that no training document holds count as one unknown token (of their class, in the model).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import blocks
from .common import fold, give_back, materialize, release, release_part, settings, tidy

BATCH_ROWS = 2000
ENDINGS, CLASSES, FEATURES, PLACE_BITS, ROUNDS = 1024, 16, 3, 14, 2
PLACES = 1 << PLACE_BITS
BINS = 40
STEP, SHRINK, CHUNK = 0.6, 6.0, 1 << 15
END = b"\x00\x20end"
HELD = 2
FOLDS = 7
#: Hashes of the places before a text's first word (words have 32 bits).
START = np.array([1 << 40, (1 << 40) + 1, (1 << 40) + 2], np.uint64)
ROW = "part int, batch long, bucket int, data binary"
NAMES = ["part", "batch", "bucket", "data"]
PAYLOAD, KEYS, FOLLOWING = 0, 1, 2


def ending(word: bytes) -> int:
    """The hashed last three bytes of a word."""
    return zlib.crc32(word[-3:]) % ENDINGS


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes: each byte by byte of its numbers, which compresses better."""
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return np.array([len(r) for r in raw], "<i8").tobytes() + zstandard.compress(b"".join(raw), 1)


def unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    sizes, raw, at, out = np.frombuffer(data, "<i8", len(kinds)), zstandard.decompress(data[8 * len(kinds) :]), 0, []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(np.frombuffer(raw, np.uint8, n, at).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind))
        at += n
    return out


class Batch:
    """Documents: ids, marks of null ids, held-out marks, numbers of tokens; words by falling frequency: hashes, endings, places in the order of their keys (later: training counts in the corpus); tokens as
    numbers of words; later the training counts of each token's pair with the token before."""

    KINDS = ("<i8", "u1", "u1", "<i8", "<u4", "<u2", "<i8", "<i8", "<u4", "<u4")

    def __init__(self, parts: list[np.ndarray]):
        self.ids, self.absent, self.held, self.sizes, self.hashes, self.endings, self.words, self.end, self.tokens, self.pairs = parts

    def dump(self) -> bytes:
        arrays = (self.ids, self.absent, self.held, self.sizes, self.hashes, self.endings, self.words, self.end, self.tokens, self.pairs)
        return pack([a.astype(k) for a, k in zip(arrays, self.KINDS)])

    @classmethod
    def load(cls, data: bytes) -> Batch:
        return cls(unpack(data, cls.KINDS))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def training(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.sizes)

    def before(self) -> np.ndarray:
        """Tokens of the same document before each token."""
        return np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def back(self, of_word: np.ndarray, of_start: np.ndarray, k: int, before: np.ndarray) -> np.ndarray:
        """of_word of the token k places before each token, and of_start before the first one (by how far)."""
        n = len(self.tokens)
        out = np.empty(n, of_word.dtype)
        out[k:] = of_word[self.tokens[: max(0, n - k)]]
        for j in range(k):
            out[before == j] = of_start[k - 1 - j]
        return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(place of each lower-cased word among the distinct ones, the distinct words, number of words by text): only A-Z and the white space of ASCII count."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
    flat = split.flatten()
    full = pa.compute.not_equal(flat, "").to_numpy(zero_copy_only=False)
    sizes = np.bincount(np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))[full], minlength=len(texts))
    coded = flat.filter(pa.array(full)).cast(pa.large_binary()).dictionary_encode()
    whole = coded.dictionary
    if not len(whole):
        return np.empty(0, np.int32), [], sizes
    _, ends, data = whole.buffers()
    raw, ends = data.to_pybytes(), np.frombuffer(ends, np.int64)[whole.offset : whole.offset + len(whole) + 1].tolist()
    return coded.indices.to_numpy(zero_copy_only=False), [raw[a:b] for a, b in zip(ends, ends[1:])], sizes


def read_batch(ids: pa.Array, texts: pa.Array, held: np.ndarray) -> tuple[Batch, np.ndarray, np.ndarray]:
    """The batch, its words' keys in order, and their training counts in it."""
    flat, words, sizes = words_of(texts)
    words = [END, *words]
    tokens, sizes = np.zeros(len(flat) + len(sizes), np.int32), sizes + 1
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = flat + 1
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    endings = np.fromiter(map(ending, words), np.uint16, len(words))
    rank = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")
    again = np.empty(len(rank), np.int32)
    again[rank] = np.arange(len(rank), dtype=np.int32)
    tokens, keys, endings = again[tokens], keys[rank], endings[rank]
    order = np.argsort(keys, kind="stable")
    counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(keys))[order]
    absent = ids.is_null().to_numpy(zero_copy_only=False)
    batch = Batch([ids.fill_null(0).to_numpy(zero_copy_only=False), absent, held, sizes, (keys >> np.uint64(32)).astype(np.uint32), endings, order, again[:1], tokens, np.empty(0, np.uint32)])
    return batch, keys[order], counts


def pair_keys(batch: Batch, bits: int) -> np.ndarray:
    """The hashed pair of each token with the one before."""
    wide = batch.hashes.astype(np.uint64)
    x = batch.back(wide, START, 1, batch.before()) * np.uint64(0x9E3779B97F4A7C15) + wide[batch.tokens]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(64 - bits)


def history(batch: Batch) -> list[np.ndarray]:
    """For each feature the hashed row of each token, within the feature's PLACES rows."""
    mix = lambda a, seed: ((a ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACE_BITS)).astype(np.uint16)
    wide, before = batch.hashes.astype(np.uint64), batch.before()
    return [batch.back(mix(wide, k), mix(START, k), k, before) for k in range(1, FEATURES + 1)]


def clusters(pairs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A class for each ending: k-means over the square roots of the smoothed shares of the endings before it, weighted by count; all deterministic."""
    held = np.flatnonzero(count)
    out = np.zeros(ENDINGS, np.int64)
    if len(held) <= CLASSES:
        out[held] = np.arange(len(held))
        return out
    share = pairs.T[held] + 0.5 * count / max(count.sum(), 1)  # rows: what stands before this ending
    x = np.sqrt(share / share.sum(1, keepdims=True))
    w = count[held].astype(float)
    centres = [x[int(w.argmax())]]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(CLASSES - 1):
        centres.append(x[int((far * w).argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(25):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        for k in range(CLASSES):
            if (near == k).any():
                c[k] = np.average(x[near == k], 0, w[near == k])
    out[held] = near
    return out


# counts -------------------------------------------------------------------------------------------------------------------------------


def key_rows(batch: int, first_bucket: int, keys: np.ndarray, vals: list[np.ndarray], bits: int, buckets: int) -> Iterator[tuple]:
    """A row for each bucket of sorted keys below 2**bits: the keys' steps, and the values beside them."""
    cut = [0, *np.searchsorted(keys, blocks.edges(buckets, bits)).tolist(), len(keys)]
    for b in range(buckets):
        lo, hi = cut[b], cut[b + 1]
        if lo < hi:
            yield KEYS, batch, first_bucket + b, pack([np.diff(keys[lo:hi], prepend=np.uint64(0)), *(v[lo:hi] for v in vals)])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def prepare(docs: DataFrame, bits: int, buckets: int) -> DataFrame:
    """The documents as batches of token numbers (part 0), their words and pairs by bucket (1), and which endings follow which, by task (2)."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        following = np.zeros(ENDINGS * ENDINGS, np.int64)
        for b in batches:
            batch, keys, counts = read_batch(b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False))
            rows = [(PAYLOAD, number, 0, batch.dump())]
            rows += key_rows(number, 0, keys, [counts.astype("<u4"), batch.endings[batch.words]], 64, buckets)
            on = batch.training()
            pairs, place = np.unique(pair_keys(batch, bits), return_inverse=True)
            rows += key_rows(number, buckets, pairs, [np.bincount(place[on], minlength=len(pairs)).astype("<u4")], bits, buckets)
            yield as_batch(rows)
            e = batch.endings[batch.tokens].astype(np.int64)
            following += np.bincount((e[:-1] * ENDINGS + e[1:])[on[1:] & (batch.before()[1:] > 0)], minlength=len(following))
            number += 1
        at = np.flatnonzero(following)
        if len(at):
            yield as_batch([(FOLLOWING, -1, 0, pack([at.astype("<u4"), following[at]]))])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), FOLDS) == HELD).alias("held"))
    return materialize(picked.mapInArrow(tidy(scatter), ROW), "lm-keys", BATCH_ROWS, by="part")


def answers(scattered: DataFrame, buckets: int) -> DataFrame:
    """Training counts of each batch's words and pairs over all batches; rows of part 2 sum tokens and distinct words by ending."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        bucket, batch = t.column("bucket")[0].as_py(), t.column("batch").to_pylist()
        word = bucket < buckets
        got = [unpack(d.as_py(), ("<u8", "<u4", "<u2") if word else ("<u8", "<u4")) for d in t.column("data")]
        distinct, place = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
        n = np.bincount(place, np.concatenate([g[1] for g in got]), len(distinct)).astype("<i8")
        each, ends = n[place], np.cumsum([len(g[0]) for g in got])
        rows = [(KEYS, k, bucket, pack([each[e - len(g[0]) : e]])) for k, g, e in zip(batch, got, ends.tolist())]
        if word:
            kind = np.zeros(len(distinct), np.int64)
            kind[place] = np.concatenate([g[2] for g in got])
            rows.append((FOLLOWING, -1, bucket, pack([np.bincount(kind, n, ENDINGS).astype("<i8"), np.bincount(kind, n > 0, ENDINGS).astype("<i8")])))
        return pa.Table.from_batches([as_batch(rows)])

    return materialize(scattered.where(F.col("part") == KEYS).groupBy("bucket").applyInArrow(run, ROW), "lm-counts", by="part")


def sums(rows: DataFrame, kinds: tuple[str, ...], sparse: bool) -> np.ndarray:
    """The sum of packed arrays over all rows: by place, so that the driver takes as many rows as there are places."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENDINGS * ENDINGS if sparse else 2 * ENDINGS, np.int64)
        for b in batches:
            for d in b.column(0):
                got = unpack(d.as_py(), kinds)
                if sparse:
                    total[got[0]] += got[1]
                else:
                    total += np.concatenate(got)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    with settings(rows.sparkSession):
        got = rows.select("data").mapInArrow(tidy(spread), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(ENDINGS * ENDINGS if sparse else 2 * ENDINGS, np.int64)
    out[got["at"].to_numpy(int)] = got["n"].to_numpy(np.int64)
    return out


def complete(scattered: DataFrame, counted: DataFrame, bits: int) -> DataFrame:
    """The batches with the counts of their words and pairs."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        order = np.argsort(np.where(t.column("part").to_numpy() == PAYLOAD, -1, t.column("bucket").to_numpy()), kind="stable").tolist()
        data = t.column("data")
        batch = Batch.load(data[order[0]].as_py())
        found = np.concatenate([unpack(data[i].as_py(), ("<i8",))[0] for i in order[1:]])
        n = len(batch.hashes)
        words = np.empty(n, np.int64)
        words[batch.words] = found[:n]
        _, place = np.unique(pair_keys(batch, bits), return_inverse=True)
        batch.words, batch.pairs = words, np.minimum(found[n:], 2**32 - 1)[place]
        return pa.table([pa.array([batch.dump()], pa.binary())], ["data"])

    both = scattered.where(F.col("part") == PAYLOAD).unionByName(counted.where(F.col("part") == KEYS))
    return materialize(both.groupBy("batch").applyInArrow(run, "data binary"), "lm-batches")


# the model ----------------------------------------------------------------------------------------------------------------------------


class Model:
    """What scoring needs; a few megabytes."""

    def __init__(self, class_of: np.ndarray, tokens: np.ndarray, distinct: np.ndarray):
        self.class_of = class_of
        n = np.bincount(class_of, tokens, CLASSES)
        self.log_room = np.log(n + np.bincount(class_of, distinct, CLASSES) + 1)
        self.bias = np.log((n + 1) / (n + 1).sum()).astype(np.float32)
        self.weights = np.zeros((FEATURES, PLACES, CLASSES), np.float32)
        self.gate = np.zeros(BINS)

    def shares(self, rows: list[np.ndarray]) -> np.ndarray:
        """The classes' probabilities."""
        x = self.weights[0].take(rows[0], 0)
        for w, r in zip(self.weights[1:], rows[1:]):
            x += w.take(r, 0)
        x += self.bias
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x *= (1 / x.sum(1))[:, None]
        return x

    def inside(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class and its probability within it."""
        kind = self.class_of[batch.endings]
        return kind[batch.tokens].astype(np.uint8), np.exp(np.log(batch.words + 1.0) - self.log_room[kind])[batch.tokens]

    def remembered(self, batch: Batch, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What has followed the word before: the bin of the history's count, the gate's probability, and the token's share.  leave_out: without a training token's own occurrence."""
        seen, pairs = batch.back(batch.words, batch.words[batch.end], 1, batch.before()), batch.pairs.astype(np.int64)
        if leave_out:
            own = batch.training()
            seen, pairs = seen - own, pairs - own
        place = np.where(seen > 0, np.minimum(np.frexp(np.maximum(seen, 1).astype(float))[1], BINS - 1), 0)
        gate = 1 / (1 + np.exp(-self.gate))
        gate[0] = 0.0  # a history that training has not seen remembers nothing
        return place, gate[place], np.clip(pairs / np.maximum(seen, 1), 0, 1)


SIZE = FEATURES * PLACES * CLASSES
#: Numbers of a sum that travel together, and groups in which tasks' sums are added first.
SLICE, LANES = 1 << 15, 512


def summed(batches: DataFrame, work: Callable[[Iterator[Batch]], np.ndarray], length: int) -> np.ndarray:
    """work(a task's batches) -> numbers; their sums over all tasks."""
    kind, names = "part int, lane int, data binary", ["part", "lane", "data"]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = (Batch.load(d.as_py()) for b in incoming for d in b.column(0))
        first = next(loaded, None)
        if first is not None:
            total = work(chain([first], loaded)).astype("<f4")
            parts, lane = [total[i : i + SLICE].tobytes() for i in range(0, length, SLICE)], TaskContext.get().partitionId() % LANES
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([lane] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names)

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(d.as_py(), "<f4") for d in t.column("data")], axis=0, dtype=float).astype("<f4")
        return pa.table([t.column("part").slice(0, 1), t.column("lane").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names)

    with settings(batches.sparkSession, 4):
        made = batches.mapInArrow(tidy(run), kind).groupBy("part", "lane").applyInArrow(add, kind)  # at most LANES rows for each part
        got = made.groupBy("part").applyInArrow(add, kind).select("part", "data").collect()
    out = np.zeros(length)
    for part, data in got:
        out[part * SLICE : (part + 1) * SLICE] = np.frombuffer(data, "<f4")
    return out


def observed(batches: DataFrame, model: Model) -> np.ndarray:
    """How often each feature's row stands before each class in training."""

    def work(loaded: Iterator[Batch]) -> np.ndarray:
        total = np.zeros((FEATURES, PLACES * CLASSES))
        for batch in loaded:
            on = batch.training()
            kind = model.class_of[batch.endings][batch.tokens[on]]
            for own, rows in zip(total, history(batch)):
                own += np.bincount(rows[on].astype(np.int64) * CLASSES + kind, minlength=PLACES * CLASSES)
        return total.ravel()

    return summed(batches, work, SIZE).reshape(FEATURES, PLACES, CLASSES)


def gradient(batches: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all training tokens, each as far as it comes from its class: (expected, observed) by row and class; and by bin of the history's count how many tokens come from memory, and all of them."""

    def work(loaded: Iterator[Batch]) -> np.ndarray:
        expected, seen, gates = np.zeros((FEATURES, PLACES, CLASSES)), np.zeros((FEATURES, PLACES * CLASSES)), np.zeros((2, BINS))
        for batch in loaded:
            on = batch.training()
            rows = [r[on] for r in history(batch)]
            (kind, inside), (place, gate, share) = model.inside(batch), model.remembered(batch, True)
            kind, inside, place, gate, share = (x[on] for x in (kind, inside, place, gate, share))
            rest = np.empty(len(kind))
            for a in range(0, len(kind), CHUNK):
                at = slice(a, a + CHUNK)
                p = model.shares([r[at] for r in rows])
                own, memory = (1 - gate[at]) * p[np.arange(len(p)), kind[at]] * inside[at], gate[at] * share[at]
                rest[at] = own / (own + memory)
                p *= rest[at].astype(np.float32)[:, None]
                for total, r in zip(expected, rows):
                    order = np.argsort(r[at], kind="stable")  # 16-bit numbers: a radix sort
                    r = r[at][order]
                    new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    total[r[new]] += np.add.reduceat(p.take(order, 0), new, axis=0)
            for total, r in zip(seen, rows):
                total += np.bincount(r.astype(np.int64) * CLASSES + kind, rest, PLACES * CLASSES)
            gates += [np.bincount(place, 1 - rest, BINS), np.bincount(place, minlength=BINS)]
        return np.concatenate([expected.ravel(), seen.ravel(), gates.ravel()])

    got = summed(batches, work, 2 * SIZE + 2 * BINS)
    shape = (FEATURES, PLACES, CLASSES)
    return got[:SIZE].reshape(shape), got[SIZE : 2 * SIZE].reshape(shape), got[2 * SIZE :].reshape(2, BINS)


def train(batches: DataFrame, model: Model) -> Model:
    prior = np.exp(model.bias.astype(float))
    start = observed(batches, model)
    model.weights = ((np.log((start + 5 * prior) / (start.sum(2, keepdims=True) + 5)) - model.bias) * (1.2 / FEATURES)).astype(np.float32)
    for _ in range(ROUNDS):
        expected, seen, (memory, all_) = gradient(batches, model)
        model.weights += (STEP * np.log((seen + SHRINK) / (expected + SHRINK))).astype(np.float32)
        model.gate = np.log((memory + 1) / (all_ - memory + 1))
    return model


def token_scores(batch: Batch, model: Model) -> np.ndarray:
    """log10 of each token's probability."""
    rows, (kind, inside), (_, gate, share) = history(batch), model.inside(batch), model.remembered(batch, False)
    out = np.empty(len(kind))
    for a in range(0, len(kind), CHUNK):
        at = slice(a, a + CHUNK)
        p = model.shares([r[at] for r in rows])
        out[at] = np.log10((1 - gate[at]) * p[np.arange(len(p)), kind[at]] * inside[at] + gate[at] * share[at])
    return out


def report(docs: DataFrame) -> DataFrame:
    return fitted(docs)[0]


def fitted(docs: DataFrame) -> tuple[DataFrame, Model]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; and the model."""
    size = blocks.input_bytes(docs)
    buckets, bits = blocks.bucket_count(docs), min(60, max(36, math.ceil(math.log2(size + 1)) + 10))
    scattered = prepare(docs, bits, buckets)
    counted = answers(scattered, buckets)
    tokens, distinct = sums(counted.where(F.col("part") == FOLLOWING), ("<i8", "<i8"), False).reshape(2, ENDINGS)
    pairs = sums(scattered.where(F.col("part") == FOLLOWING), ("<u4", "<i8"), True).reshape(ENDINGS, ENDINGS)
    release_part(scattered, "part", KEYS)
    batches = complete(scattered, counted, bits)
    release(scattered, counted)
    n, v = int(tokens.sum()), int(distinct.sum())
    model = train(batches, Model(clusters(pairs.astype(float), tokens), tokens, distinct))
    floor = math.log10(n + v + 1)

    def finish(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (d for b in incoming for d in b.column(0)):
            batch = Batch.load(data.as_py())
            doc, known, m = batch.doc_of(), batch.words[batch.tokens], len(batch.sizes)
            ids = pa.array(batch.ids, pa.int64(), mask=batch.absent.astype(bool))
            base, score = np.bincount(doc, np.log10(known + 1.0) - floor, m), np.bincount(doc, token_scores(batch, model), m)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(batch.held.astype(bool)), pa.array(batch.sizes), pa.array(np.bincount(doc, known > 0, m).astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = materialize(batches.mapInArrow(tidy(finish), kind), "lm-scores", 4)
    release(batches)
    return out, model
