"""TIFF rasters: directory, geographic tags, strips and tiles (uncompressed or deflate, no predictor or horizontal), and a writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

#: Fixed values of the public TIFF and GeoTIFF layouts: field types (size, struct code) and tag numbers.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def directory(read: Callable[[int, int], bytes], at: int = 0) -> dict:
    """The first image's tags, and the byte order under "order"."""
    head = read(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count_size, entry, inline = (8, 20, 8) if big else (2, 12, 4)
    (n,) = struct.unpack(order + ("Q" if big else "H"), read(count_size, at))
    body, tags = read(n * entry, at + count_size), {"order": order}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", body, i * entry)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), body, i * entry + 4)
        if kind not in TYPES:
            continue
        width, code = TYPES[kind]
        raw = body[i * entry + (12 if big else 8) : (i + 1) * entry]
        if width * count > inline:
            raw = read(width * count, struct.unpack(order + ("Q" if big else "I"), raw)[0])
        if kind == 2:
            tags[tag] = raw[:count].rstrip(b"\0").decode("latin-1")
        else:
            tags[tag] = list(struct.unpack(f"{order}{count * len(code)}{code[0]}", raw[: width * count]))
    return tags


def attributes(tags: dict) -> dict:
    """width, height, crs, bounds, transform (a, b, c, d, e, f: x = a * col + b * row + c)."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        t = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIEPOINT]
        t = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    else:
        t = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    keys = tags.get(GEO_KEYS, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(3072) or codes.get(2048)
    xs, ys = (t[2], t[2] + t[0] * width + t[1] * height), (t[5], t[5] + t[3] * width + t[4] * height)
    return {"width": width, "height": height, "crs": f"EPSG:{code}" if code else None, "bounds": {"left": xs[0], "bottom": ys[1], "right": xs[1], "top": ys[0]}, "transform": t, "bands": tags.get(SAMPLES, [1])[0]}


def window(read: Callable[[int, int], bytes], tags: dict, row: int, col: int, height: int, width: int) -> np.ndarray:
    """(bands, height, width) of a window; only the strips or tiles that it meets are read."""
    order, bands = tags["order"], tags.get(SAMPLES, [1])[0]
    kind = KINDS.get((tags.get(SAMPLE_FORMAT, [1])[0], tags[BITS][0]))
    if kind is None or tags.get(COMPRESSION, [1])[0] not in (1, 8, 32946) or tags.get(PREDICTOR, [1])[0] not in (1, 2):
        raise NotImplementedError("this sample type, compression or predictor is not supported")
    total_w, total_h = tags[WIDTH][0], tags[HEIGHT][0]
    if TILES in tags:
        bw, bh, at, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILES], tags[TILE_BYTES]
    else:
        bw, bh, at, sizes = total_w, tags.get(ROWS, [total_h])[0], tags[STRIPS], tags[STRIP_BYTES]
    across, down = -(-total_w // bw), -(-total_h // bh)
    planar = tags.get(PLANAR, [1])[0] == 2
    out = np.zeros((bands, height, width), kind)
    for bi in range(row // bh, -(-(row + height) // bh)):
        for bj in range(col // bw, -(-(col + width) // bw)):
            for plane in range(bands if planar else 1):
                k = plane * across * down + bi * across + bj
                data = read(sizes[k], at[k])
                if tags.get(COMPRESSION, [1])[0] != 1:
                    data = zlib.decompress(data)
                rows = bh if TILES in tags else min(bh, total_h - bi * bh)
                depth = 1 if planar else bands
                block = np.frombuffer(data, order + kind, rows * bw * depth).reshape(rows, bw, depth)
                if tags.get(PREDICTOR, [1])[0] == 2:
                    block = np.cumsum(block, axis=1, dtype=kind)
                r0, r1 = max(row, bi * bh), min(row + height, bi * bh + rows)
                c0, c1 = max(col, bj * bw), min(col + width, (bj + 1) * bw)
                part = block[r0 - bi * bh : r1 - bi * bh, c0 - bj * bw : c1 - bj * bw].transpose(2, 0, 1)
                out[slice(plane, plane + 1) if planar else slice(None), r0 - row : r1 - row, c0 - col : c1 - col] = part
    return out


def write(pixels: np.ndarray, transform: list[float] | None = None, epsg: int | None = None, tile: int = 0, deflate: bool = False) -> bytes:
    """A little-endian TIFF of (bands, height, width), in one strip for each row block or in square tiles."""
    bands, height, width = pixels.shape
    code = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    bw, bh = (tile, tile) if tile else (width, min(height, 64))
    blocks = []
    for i in range(0, height, bh):
        for j in range(0, width, bw):
            part = pixels[:, i : i + bh, j : j + bw]
            if tile:
                part = np.pad(part, ((0, 0), (0, bh - part.shape[1]), (0, bw - part.shape[2])))
            raw = np.ascontiguousarray(part.transpose(1, 2, 0).astype(pixels.dtype.newbyteorder("<"))).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [pixels.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8 if deflate else 1]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [code] * bands)]
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b) + len(b) % 2
    sizes = [len(b) for b in blocks]
    tags += [(TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILES, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIPS, 4, offsets), (ROWS, 4, [bh]), (STRIP_BYTES, 4, sizes)]
    if transform:
        a, b, c, d, e, f = transform
        tags.append((TRANSFORM, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    if epsg:
        tags.append((GEO_KEYS, 3, [1, 1, 0, 1, 3072, 0, 1, epsg]))
    tags.sort()
    entries, extra, base = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, len(values), base + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + b"".join(b + b"\0" * (len(b) % 2) for b in blocks) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra
