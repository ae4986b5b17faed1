"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are first turned by an orthogonal matrix, which changes no inner product: to the principal axes of all vectors, so that the first coordinates hold
as much as can be.  A segment of coordinates is described by its mean m and the length d of what deviates from it.  For two vectors the inner product over a
segment of length L is at most L * m * m' + d * d' (Cauchy-Schwarz), which is the inner-product form of the lower bound of the distance
|x - y|**2 = |x|**2 + |y|**2 - 2 <x, y>.  Each level has segments of length one for its first coordinates, a half of all, then three quarters, then seven
eighths, and one long segment for the rest: from coarse to fine, each level adding to the sum of the one before.  A query's threshold is its k-th best exact
score so far; vectors whose bound stays below it are dropped, level by level, and exact integer products are worked out for the few that survive all levels.

The grid of query tiles and candidate tiles has QUERIES and TILE vectors a side; each pair is one group of two tiles, whatever the table's size, and gives at most k
rows a query.  Rows of all tiles meet by query id for the last ranking.  The matrix takes the square of the vectors' width in memory, on the driver and in tasks.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows of null id, take no part; shorter vectors count as padded with
zeros; rows of equal id are candidates each, and none is a candidate of a query of its own id; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, settings, tidy

QUERIES, TILE, ROWS = 65536, 16384, 256
#: Shares of the coordinates that stand alone, from coarse to fine.
LEVELS = (1 / 2, 3 / 4, 7 / 8)
SCALE = 256


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components, padded)."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten()
    bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)) if len(flat) else np.empty(0, bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    spoilt = np.bincount(row[bad], minlength=len(sizes)) > 0
    keep = np.flatnonzero((sizes > 0) & ~spoilt)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(SCALE * np.nan_to_num(flat.fill_null(0).to_numpy(zero_copy_only=False)))
    return keep, out[keep]


def rest(y: np.ndarray, lead: int) -> np.ndarray:
    """sqrt(L) * mean and deviation of the segment behind the first coordinates: two rows' product bounds the inner product over it."""
    tail = y[:, lead:]
    if not tail.shape[1]:
        return np.zeros((len(y), 2))
    mean = tail.mean(1)
    return np.stack([mean * np.sqrt(tail.shape[1]), np.sqrt(((tail - mean[:, None]) ** 2).sum(1))], 1)


def axes(moments: np.ndarray) -> np.ndarray:
    """Columns: the principal axes of vectors with these second moments, the largest first."""
    return np.linalg.eigh(moments)[1][:, ::-1]


def best(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, turn: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query's place, candidates' places, scores, number of survivors) of the k best of each query."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    leads = sorted({max(1, int(x.shape[1] * share)) for share in LEVELS})
    y, p = x @ turn, queries @ turn
    tails, ptails = [rest(y, m) for m in leads], [rest(p, m) for m in leads]
    slack = 1 + 1e-9 * float(np.sqrt((p**2).sum(1).max(initial=0) * (y**2).sum(1).max(initial=0)))
    exact = bool(len(x)) and float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**53
    if not exact:
        queries, x = np.vectorize(int, otypes=[object])(queries), np.vectorize(int, otypes=[object])(x)
    few = min(len(ids), 4 * k)
    for a in range(0, len(queries), ROWS):
        at = slice(a, a + ROWS)
        q, sum_, done, alive = queries[at], 0.0, 0, None
        for m, tail, ptail in zip(leads, tails, ptails):
            sum_ = sum_ + p[at, done:m] @ y[:, done:m].T
            bound, done = sum_ + (ptail[at] @ tail.T + slack), m
            if alive is None:
                bound[own[at][:, None] == ids[None, :]] = -np.inf
                first = np.argpartition(-bound, few - 1, axis=1)[:, :few]
                scores = np.einsum("qd,qcd->qc", q, x[first]) if exact else np.array([[np.dot(r, c) for c in x[f]] for r, f in zip(q, first)], object)
                sure = np.where(np.isfinite(np.take_along_axis(bound, first, 1)), scores.astype(float), -np.inf)
                bar = np.sort(sure, 1)[:, -k][:, None] if few >= k else np.full((len(q), 1), -np.inf)
                alive = (bound >= bar) & np.isfinite(bound)
            else:
                alive &= bound >= bar
        for i in range(len(q)):
            left = np.flatnonzero(alive[i])
            s = x[left] @ q[i]
            top = np.argsort(-s, kind="stable")[:k]  # candidates stand by id
            yield a + i, order[left[top]], s[top], len(left)


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every` the k best of all others."""
    kind = "query boolean, n long, width int, form string, ids binary, data binary"
    names = [c.split()[0] for c in kind.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = quantised(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)[keep].astype("<i8") if len(keep) else np.empty(0, "<i8")
            largest = np.abs(x).max(initial=0)
            form = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8"
            for query in (False, True):
                on = ids % every == 0 if query else np.ones(len(ids), bool)
                if on.any():
                    row = (query, int(on.sum()), x.shape[1], form, ids[on].tobytes(), x[on].astype(form).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names)

    packed = materialize(vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(tidy(read), kind), "vectors", 4096)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for n, w, form, data in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(data, form).reshape(n, w).astype(float)
                total[:w, :w] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "data"])

    def added(t: pa.Table) -> pa.Table:
        return pa.table([t.column("row").slice(0, 1), pa.array([sum(np.frombuffer(d.as_py()) for d in t.column("data")).tobytes()], pa.binary())], ["row", "data"])

    with settings(packed.sparkSession, 64):
        found = packed.groupBy("query").agg(F.sum("n"), F.max("width")).collect()
        count, width = {r[0]: r[1] for r in found}, max((r[2] for r in found), default=0)
        rows = packed.where("NOT query").select("n", "width", "form", "data").mapInArrow(tidy(moments), "row int, data binary").groupBy("row").applyInArrow(added, "row int, data binary").orderBy("row").collect()
    turn = axes(np.stack([np.frombuffer(r.data) for r in rows])) if rows else np.zeros((0, 0))
    tiles = {q: max(1, -(-count.get(q, 0) // (QUERIES if q else TILE))) for q in (False, True)}
    dealt = packed.withColumn("own", F.pmod(F.xxhash64("ids"), F.when(F.col("query"), tiles[True]).otherwise(tiles[False])).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), tiles[False] - 1).otherwise(tiles[True] - 1))))
    pairs = dealt.select(F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("j"), *names)

    def stacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(d, form).reshape(n, w).astype(float) for n, w, form, d in zip(*(t.column(c).to_pylist() for c in ("n", "width", "form", "data")))]
        return np.concatenate([np.frombuffer(i, "<i8") for i in t.column("ids").to_pylist()]), np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])

    def tile(t: pa.Table) -> pa.Table:
        is_query = t.column("query")
        query, vec, score = [], [], []
        mine, others = t.filter(is_query), t.filter(pa.compute.invert(is_query))
        if mine.num_rows and others.num_rows:
            (own, q), (ids, x) = stacked(mine), stacked(others)
            for i, at, s, _ in best(q, own, x, ids, k, turn):
                query += [int(own[i])] * len(at)
                vec += ids[at].tolist()
                score += [int(v) for v in s]
        return pa.table([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    found = pairs.groupBy("i", "j").applyInArrow(tile, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
