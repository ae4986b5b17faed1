"""Exact Jaccard self-join of documents on word shingles, by blocked sparse products.

Two documents link when 100 * |x & y| >= 75 * |x | y|.  Then |x & y| >= n - floor(n / 4) for the size n of either, which bounds
everything below; nothing is sampled or capped.

1. Shingles are 64-bit hashes, and their numeric order is the global order.  Of n sorted shingles, two linked documents share at least l among their first
   floor(n / 4) + l (with l = 1 + n // 12 of the smaller).  Only these travel (blocks.py), and each batch learns which of them any other
   document holds.  A document with fewer than that many held ones links with nothing: that is most documents.
2. The rest, one for each distinct set (copies link by the set's digest), is read once more; a second exchange over whole sets drops
   shingles that only one set holds, and every set left with fewer than n - floor(n / 4).
3. Sets that share a shingle among their rarest m - (n - floor(n / 4)) + 1 are candidates.  Stars through each such shingle, not pairs, give groups of sets that
   may be connected (graph.py).
4. In each group the product of the set-by-shingle incidence with its transpose is accumulated row by row, from postings; counts below the bound for the two sizes
   are dropped and the others join the two sets' component.  Rows all of whose missing pairs lie within one component are not needed and not formed.
   A group above GROUP_BYTES is split: each pair of its parts is a product of its own, in its own task, so no task holds an unbounded group.

Defined results: a null or empty text has no shingle and links with nothing; rows of one text link whatever their ids; a null id never names a
component unless all its documents' ids are null; keep_one() chooses rows, not ids, and keeps other columns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks
from .common import fresh, give_back, materialize, release, settings, tidy
from .graph import components

WIDTH = 5
BATCH_ROWS = 1500
GROUP_BYTES = 24 << 20
#: Words of 64 bits in keep_one's filter, at most.
MARK_WORDS = 1 << 18
NO_ID = -(1 << 63)
MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    place: dict[bytes, int] = {}
    flat, sizes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        flat += [place.setdefault(w, len(place)) for w in words]
        sizes.append(len(words))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in place] or [0], np.uint64)
    token = np.append(hashes[np.array(flat, np.int64)], np.zeros(WIDTH, np.uint64))
    n = len(flat)
    whole = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        whole += token[j : j + n] * MULTIPLY[j]
    whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    out, at = [], 0
    for k in sizes:
        if k >= WIDTH:
            out.append(np.unique(whole[at : at + k - WIDTH + 1]))
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[np.array(flat[at : at + k])].tobytes(), seed=k)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += k
    return out


def digest(s: np.ndarray) -> int:
    """The set's digest as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def prefix_of(n: int) -> int:
    return n // 4 + 1 + n // 12


def least_shared(n: int) -> int:
    """Shingles of its prefix that a linked document holds in its own prefix: by the smaller one's l."""
    return 1 + -(-3 * n // 4) // 12


def dump(arrays: list[np.ndarray]) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw)


def load(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)).tolist(), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data[at : at + n], kind))
        at += n
    return out


def holders(keys: list[bytes], vals: list[bytes]) -> list[bytes]:
    """How many documents hold each key, at most 2**32 - 1."""
    distinct, place, ends = blocks.meet(keys)
    n = np.bincount(place, np.frombuffer(b"".join(vals), "<u4"), len(distinct))
    return blocks.deal(np.minimum(n, 2**32 - 1).astype("<u4")[place], ends)


def exchange(docs: DataFrame, part_of, name: str, with_keys: bool) -> DataFrame:
    """docs: (id, text) or (id, text, row_key).  Scatters part_of(set) of every document's shingles; payload: ids, marks of null ids, sizes, digests, sizes of the parts, places among the batch's keys, the keys on demand, and the row keys."""
    buckets = blocks.bucket_count(docs)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            parts = [part_of(s) for s in sets]
            keys, place, count = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
            ids, own = b.column(0), b.column(2).to_numpy() if b.num_columns > 2 else np.zeros(b.num_rows, "<i8")
            payload = dump([ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False).astype("u1"), np.array([len(s) for s in sets], "<i8"), np.array([digest(s) for s in sets], "<i8"), np.array([len(p) for p in parts], "<i8"), place.astype("<u4"), keys if with_keys else keys[:0], own.astype("<i8")])
            yield blocks.rows(number, payload, keys, count.astype("<u4"), buckets)
            number += 1

    return materialize(docs.mapInArrow(tidy(scatter), blocks.ROW), name, BATCH_ROWS)


KINDS = ["<i8", "u1", "<i8", "<i8", "<i8", "<u4", "<u8", "<i8"]


def sift(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, maybe, row_key) of every document; maybe: whether it may link with another; row_key: as given, or 0."""

    def finish(payload: bytes, answers: bytes) -> pa.Table:
        ids, absent, n, sig, k, place, _, own = load(payload, KINDS)
        held = np.frombuffer(answers, "<u4")[place] > 1
        shared = np.bincount(np.repeat(np.arange(len(k)), k), held, len(k))
        maybe = np.array([m > 0 and s >= least_shared(m) for m, s in zip(n.tolist(), shared.tolist())], bool)
        return pa.table([pa.array(ids, mask=absent.astype(bool)), pa.array(n), pa.array(sig, mask=n == 0), pa.array(maybe), pa.array(own)], ["doc_id", "n_shingles", "digest", "maybe", "row_key"])

    scattered = exchange(docs, lambda s: s[: prefix_of(len(s))] if len(s) else s, "prefixes", False)
    out = materialize(blocks.gather(scattered, blocks.reduce_keys(scattered, holders), finish, "doc_id long, n_shingles long, digest long, maybe boolean, row_key long"), "sifted")
    release(scattered)
    return out


def candidate_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, n, shingles) of the distinct sets that may link: shingles that other sets hold, the rarest first."""

    def finish(payload: bytes, answers: bytes) -> pa.Table:
        _, _, n, sig, k, place, keys, _ = load(payload, KINDS)
        held, at, rows = np.frombuffer(answers, "<u4"), 0, []
        for size, own, length in zip(n.tolist(), sig.tolist(), k.tolist()):
            p = place[at : at + length]
            at += length
            p = p[held[p] > 1]
            if size and len(p) >= size - size // 4:
                rows.append((own, size, keys[p[np.lexsort((p, held[p]))]].tobytes()))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["digest", "n", "shingles"])

    # one plan at every size: a broadcast that fits small inputs only would hide what the join of the texts costs
    wanted = classes.select(F.coalesce("least_id", F.lit(NO_ID)).alias("id"), "digest").hint("merge")
    one = docs.withColumn("id", F.coalesce("id", F.lit(NO_ID))).join(wanted, "id").select("id", "text")
    scattered = exchange(one.select("id", "text"), lambda s: s, "sets", True)
    found = blocks.gather(scattered, blocks.reduce_keys(scattered, holders), finish, "digest long, n long, shingles binary")
    out = materialize(found.join(classes.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "candidates")
    release(scattered)
    return out


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, root): sets that share a rare shingle, connected.  Each set learns, by its rare shingles, the least digest that holds one of them too."""
    buckets = blocks.bucket_count(sets)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            sig, n = b.column(0).to_numpy(), b.column(1).to_pylist()
            rare = [s[: len(s) - (k - k // 4) + 1] for s, k in ((np.frombuffer(raw, "<u8"), k) for raw, k in zip(b.column(2).to_pylist(), n))]
            size = np.array([len(s) for s in rare], "<i8")
            keys, place = np.unique(np.concatenate(rare) if rare else np.empty(0, np.uint64), return_inverse=True)
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, place, np.repeat(sig, size))
            yield blocks.rows(number, dump([sig.astype("<i8"), size, place.astype("<u4")]), keys, least, buckets)
            number += 1

    def finish(payload: bytes, answers: bytes) -> pa.Table:
        sig, size, place = load(payload, ["<i8", "<i8", "<u4"])
        least = np.frombuffer(answers, "<i8")[place]
        pairs = np.unique(np.stack([np.repeat(sig, size), least]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    scattered = materialize(sets.select("digest", "n", "shingles").mapInArrow(tidy(scatter), blocks.ROW), "rare", BATCH_ROWS)
    out = components(blocks.gather(scattered, blocks.reduce_keys(scattered, blocks.least), finish, "a long, b long"), "a", "b")
    release(scattered)
    return out


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        r = self.up
        while (r[r] != r).any():
            r = r[r]
        self.up = r.copy()
        return r

    def join(self, i: int, others: np.ndarray) -> None:
        tops = {self.root(i), *(self.root(int(j)) for j in others)}
        self.up[list(tops)] = min(tops)


def linked(n: np.ndarray, shingles: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """The root (an index) of each set.  With sides, only pairs of different sides count (those of one side have been counted elsewhere).

    Row i of the product is the sum of the postings of i's shingles.  A pair needs one of its two rows; a row is formed unless all its
    still missing pairs lie in one component.
    """
    m = len(n)
    union = Union(m)
    lengths = np.array([len(s) for s in shingles])
    _, col = np.unique(np.concatenate(shingles), return_inverse=True)
    row = np.repeat(np.arange(m), lengths)
    order = np.argsort(col, kind="stable")
    posting, first = row[order], np.concatenate([[0], np.cumsum(np.bincount(col))])
    at = np.concatenate([[0], np.cumsum(lengths)])
    open_, roots = np.ones(m, bool), np.arange(m)
    by_length = np.argsort(-lengths, kind="stable")
    while True:
        left = by_length[open_[by_length]]
        if not len(left):
            break
        largest = np.bincount(roots[left], minlength=m).argmax()
        left = left[roots[left] != largest]
        if not len(left):  # whatever pair is missing is connected already
            break
        i = int(left[0])
        cols = col[at[i] : at[i + 1]]
        size = first[cols + 1] - first[cols]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size - first[cols], size)
        count = np.bincount(posting[place], minlength=m)
        hit = 100 * count >= 75 * (n[i] + n - count)
        hit[i] = False
        hit &= open_
        if side is not None:
            hit &= side != side[i]
        open_[i] = False
        if hit.any():
            union.join(i, np.flatnonzero(hit))
            roots = union.roots()
    return roots


def links(sets: DataFrame, groups: DataFrame) -> tuple[DataFrame, bool]:
    """(a, b): edges that connect just the linked sets; and whether they are stars already."""
    members = sets.join(groups.withColumnsRenamed({"node": "digest"}), "digest")
    sizes = members.groupBy("root").agg(F.sum(F.octet_length("shingles") + 64).alias("bytes")).select("root", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("parts"))
    sizes = materialize(sizes, "groups")
    split = not sizes.where("parts > 1").isEmpty()
    own = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    own = own.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    def product(t: pa.Table) -> pa.Table:
        give_back()
        sig, n = t.column("digest").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(sig, kind="stable")
        shingles = [np.frombuffer(t.column("shingles")[int(i)].as_py(), "<u8") for i in order]
        sig, n, part = sig[order], n[order], t.column("part").to_numpy()[order]
        roots = linked(n, shingles, part if len(np.unique(part)) > 1 else None)
        on = roots != np.arange(len(roots))
        return pa.table([pa.array(sig[on]), pa.array(sig[roots[on]])], ["a", "b"])

    made = own.select("root", "i", "j", "digest", "n", "shingles", "part").groupBy("root", "i", "j").applyInArrow(product, "a long, b long")
    return materialize(made, "links"), not split


def linked_rows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sift() of texts, and (digest, root, component) of the sets that may link: root is the least digest of those linked, component their least doc_id."""
    every = sift(texts)
    classes = materialize(every.where("maybe").groupBy("digest").agg(F.min("doc_id").alias("least_id")), "classes")
    sets = candidate_sets(texts.select("id", "text"), classes)
    edges, stars = links(sets, candidate_groups(sets))
    root = components(edges, "a", "b") if not stars else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    named = classes.join(root, F.col("digest") == F.col("node"), "left").select("digest", "least_id", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    return every, named.join(least, "root").select("digest", "root", "component")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    every, names = linked_rows(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")))
    return every.join(names, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def mark(id_: Column, key: Column, words: int) -> tuple[Column, Column]:
    """Where a row of this id and key is marked: the number of a word, and up to three of its 64 bits."""
    h = F.xxhash64(id_, key)
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(words - 1)), bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def split(rows: DataFrame, id_: str, key: str, named: DataFrame, named_id: str, named_key: str, count: int) -> tuple[DataFrame, DataFrame]:
    """rows in two parts, neither of which is shuffled: those that may have an id and key of named (all that have, and a few more), and those that have not.  Words of bits are broadcast, one for each four of named, MARK_WORDS at most; where named are many more, more rows come with the first part."""
    words = min(MARK_WORDS, 1 << (count // 4).bit_length())
    word, bits = (fresh(rows, n) for n in ("word", "bits"))
    at, own = mark(F.col(named_id), F.col(named_key), words)
    marks = F.broadcast(named.groupBy(at.alias(word)).agg(F.bit_or(own).alias(bits)))
    at, own = mark(F.col(id_), F.col(key), words)
    held = (at == F.col(word)) & (F.col(bits).bitwiseAND(own) == own)
    return rows.join(marks, held, "left_semi"), rows.join(marks, held, "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one of the smallest (doc_id, digest, hash of the text), null ids last.  Rows that link with none all stay, whatever their ids.  Of the texts only those travel that a filter by id and hash doesn't clear."""
    id_, key, gone_id, gone_key = (fresh(docs, n) for n in ("row_id", "row_key", "gone_id", "gone_key"))
    text = F.col("text").cast("string")
    every, names = linked_rows(docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row_key")))
    rows = materialize(every.join(names, "digest").groupBy("root", "doc_id", "digest", "row_key").agg(F.count("*").alias("n")), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "digest", "row_key")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"))
    stays = rank.eqNullSafe(F.col("first"))
    marked = materialize(rows.join(first, "root").where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias(gone_id), F.col("row_key").alias(gone_key), stays.alias("stays")), "marked")
    release(rows)
    named, again = marked.select(gone_id, gone_key), marked.where("stays").select(gone_id, gone_key)
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), key: F.xxhash64(text)})
    same = F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    near, clear = split(keyed, id_, key, named, gone_id, gone_key, marked.count())
    out = clear.unionByName(near.join(named, same, "left_anti"))
    if not again.isEmpty():  # a row that stays has copies under its own id
        out = out.unionByName(near.join(again, same, "left_semi").dropDuplicates([id_, key]))
    return out.drop(id_, key)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) USING (doc_id)
"""
