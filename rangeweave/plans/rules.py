"""The rules by which an object is cut into slices, as pure functions.

Ranges are half-open.  `cs` is a chunk's size.  A rule's result depends on attributes, index and parameters only, so that a plan costs no
data access and any number of plans serve one index.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence


def positive(**values: int) -> None:
    for k, v in values.items():
        if not isinstance(v, int) or isinstance(v, bool) or v < 1:
            raise ValueError(f"{k} must be a positive integer, not {v!r}")


#: Pieces of an object that many small ones share a task for: at most so many tasks, or so many bytes of the object for each.
TASKS, TASK_BYTES = 256, 8 << 20


def task_groups(n: int, size: int) -> list[tuple[int, int]]:
    """Ranges of n pieces, one for each task: a piece each, unless there are more than TASKS of them and they are small."""
    k = min(n, max(TASKS, -(-size // TASK_BYTES)))
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def byte_chunks(size: int, num_chunks: int | None = None, chunk_size: int | None = None, base: int = 0) -> list[tuple[int, int]]:
    """Exactly num_chunks ranges of ceil(body / n) bytes (tail ones may be empty), or ceil(body / chunk_size) ranges."""
    body = size - base
    if num_chunks is not None:
        positive(num_chunks=num_chunks)
        cs, n = -(-body // num_chunks), num_chunks
    else:
        positive(chunk_size=chunk_size)
        if chunk_size > body:
            raise ValueError(f"chunk_size {chunk_size} is larger than the object ({body})")
        cs, n = chunk_size, -(-body // chunk_size)
    return [(base + min(cs * i, body), base + min(cs * (i + 1), body)) for i in range(n)]


def line_chunks(total: int, per_chunk: int, rest: str = "expand") -> list[tuple[int, int]]:
    """Inclusive 1-based line pairs; a remainder is a chunk of its own (expand) or joins the chunk before it (merge)."""
    positive(lines_per_chunk=per_chunk)
    if rest not in ("expand", "merge"):
        raise ValueError(f"unknown strategy {rest!r}")
    pairs = [(a + 1, min(a + per_chunk, total)) for a in range(0, total, per_chunk)]
    if rest == "merge" and len(pairs) > 1 and total % per_chunk:
        last = pairs.pop()
        pairs[-1] = (pairs[-1][0], last[1])
    return pairs


def even_lines(total: int, n: int) -> list[tuple[int, int]]:
    """n inclusive 1-based line pairs of ceil(total / n) lines, tail ones possibly empty (first > last)."""
    positive(num_chunks=n)
    k = -(-total // n)
    return [(min(k * i, total) + 1, min(k * (i + 1), total)) for i in range(n)]


def read_batches(total_lines: int, num_batches: int) -> list[tuple[int, int]]:
    """Exactly num_batches ranges of reads, ceil(reads / n) each, clipped to the end."""
    positive(num_batches=num_batches)
    if total_lines % 4:
        raise ValueError("the number of lines is not a multiple of 4")
    reads = total_lines // 4
    k = -(-reads // num_batches)
    return [(min(k * i, reads), min(k * (i + 1), reads)) for i in range(num_batches)]


def reads_per_chunk(total_lines: int, per_chunk: int, rest: str = "expand") -> list[tuple[int, int]]:
    """Ranges of reads with per_chunk reads each, and the remainder by `rest`."""
    positive(seq_per_chunk=per_chunk)
    if total_lines % 4:
        raise ValueError("the number of lines is not a multiple of 4")
    return [((a - 1) // 4, b // 4) for a, b in line_chunks(total_lines, 4 * per_chunk, rest)]


def window_range(first_lines: Sequence[int], offsets: Sequence[int], end: int, line_0: int, line_1: int) -> tuple[int, int, int]:
    """(window, start, end) of compressed bytes for lines: the last window that begins at or before line_0, the first at or behind line_1, else the end."""
    w = max(0, bisect_right(first_lines, line_0) - 1)
    v = bisect_left(first_lines, line_1)
    return w, offsets[w], offsets[v] if v < len(offsets) else end


def fasta_chunks(size: int, num_chunks: int, heads: Sequence[int], bodies: Sequence[int]) -> list[dict]:
    """Byte ranges; a boundary strictly inside a header moves up to its start; a slice that starts within a sequence says which and at which raw offset."""
    positive(num_chunks=num_chunks)
    cs = -(-size // num_chunks)

    def moved(b: int) -> int:
        k = bisect_right(heads, b) - 1
        return heads[k] if k >= 0 and heads[k] < b < bodies[k] else b

    cuts = [moved(min(cs * i, size)) for i in range(num_chunks + 1)]
    out = []
    for i in range(num_chunks):
        a, b = cuts[i], max(cuts[i], cuts[i + 1])
        k = bisect_right(heads, a) - 1
        inside = a < b and k >= 0 and heads[k] != a
        out.append({"chunk_id": i, "start": a, "end": b, "header_start": heads[k] if inside else -1, "header_end": bodies[k] if inside else -1, "offset": a - bodies[k] if inside else 0})
    return out


def grid(n: int) -> tuple[int, int]:
    """(splits in x, splits in y) for about n boxes; halves round to even."""
    positive(num_chunks=n)
    sx = round(math.sqrt(n))
    return sx, max(1, round(n / sx))


def boxes(low: tuple[float, float], high: tuple[float, float], n: int) -> list[dict]:
    """x-major equal boxes.  last_x, last_y: whether the upper edge belongs to the box."""
    sx, sy = grid(n)
    wx, wy = (high[0] - low[0]) / sx, (high[1] - low[1]) / sy
    return [
        {"tile_x": i, "tile_y": j, "min_x": low[0] + wx * i, "min_y": low[1] + wy * j, "max_x": high[0] if i == sx - 1 else low[0] + wx * (i + 1), "max_y": high[1] if j == sy - 1 else low[1] + wy * (j + 1), "last_x": i == sx - 1, "last_y": j == sy - 1}
        for i in range(sx)
        for j in range(sy)
    ]


def raster_windows(width: int, height: int, n: int, exact: bool = False) -> list[dict]:
    """n x n windows, rows outer.  offset = round(step * k), length = ceil(step * (k + 1)) - offset (neighbours may share a line of pixels); exact: no shared lines."""
    positive(n_splits=n)

    def axis(total: int) -> list[tuple[int, int]]:
        step = total / n
        if exact:
            cut = [round(step * k) for k in range(n + 1)]
            return [(a, b - a) for a, b in zip(cut, cut[1:])]
        return [(round(step * k), min(total, math.ceil(step * (k + 1))) - round(step * k)) for k in range(n)]

    return [{"block_x": i, "block_y": j, "row_off": r, "col_off": c, "height": h, "width": w} for i, (r, h) in enumerate(axis(height)) for j, (c, w) in enumerate(axis(width))]


def packed(sizes: Sequence[int], capacity: int, shared: int = 0) -> list[tuple[int, int]]:
    """Greedy first fit in order: ranges of whole items whose sizes, with `shared` once a slice, stay within capacity."""
    positive(chunk_size=capacity)
    out, start, current = [], 0, shared
    for i, x in enumerate(sizes):
        if shared + x > capacity:
            raise ValueError(f"item {i} of {x} bytes does not fit into {capacity}")
        if current + x > capacity:
            out.append((start, i))
            start, current = i, shared
        current += x
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out


def timestamp_blocks(total_rows: int, rows_per_time: int, num_chunks: int) -> list[tuple[int, int]]:
    """Inclusive row ranges of whole timestamps; the first T % n slices have one more; rows behind the last whole timestamp join the last slice."""
    positive(num_chunks=num_chunks, rows_per_time=rows_per_time)
    times = total_rows // rows_per_time
    n = max(1, min(num_chunks, times))
    base, more = divmod(times, n)
    out, row = [], 0
    for i in range(n):
        k = (base + (i < more)) * rows_per_time
        out.append((row, row + k - 1))
        row += k
    out[-1] = (out[-1][0], total_rows - 1)
    return out
