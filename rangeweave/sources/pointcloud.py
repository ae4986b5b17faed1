"""Points by spatial tiles: LAS with a zone map of blocks, COPC's header and grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..codecs import las
from ..functions import io
from ..plans import rules
from .base import Format, Manifest

HEAD = 1024
BLOCK_POINTS = 50_000


def tiles(manifest: Manifest, num_chunks: int, ranges: bool = True) -> list[dict]:
    """Boxes with the byte ranges of the blocks whose extent meets them; neighbouring blocks are one range."""
    a = manifest.attributes
    out = rules.boxes(tuple(a["mins"][:2]), tuple(a["maxs"][:2]), num_chunks)
    t = manifest.table("blocks")
    col = {c: t.column(c).to_numpy() for c in t.column_names}
    for b in out:
        hit = (col["min_x"] <= b["max_x"]) & (col["max_x"] >= b["min_x"]) & (col["min_y"] <= b["max_y"]) & (col["max_y"] >= b["min_y"])
        merged: list[list[int]] = []
        for i in np.flatnonzero(hit).tolist():
            lo, hi = int(col["start"][i]), int(col["end"][i])
            if merged and merged[-1][1] == lo:
                merged[-1][1] = hi
            else:
                merged.append([lo, hi])
        b["ranges"] = merged
    return out


class Las(Format):
    """Uncompressed LAS.  boundary: half_open (each point in one tile; the last tiles are closed) or closed (points on shared edges in both)."""

    name = "las"
    attributes = {"mins": "array<double>", "maxs": "array<double>", "point_count": "bigint", "point_format_size": "int", "offset_to_point_data": "bigint"}
    strategies = {"square_split": tiles}
    default = "square_split"

    def build(self, spark, path, size, chunk_size=None, block_points=BLOCK_POINTS, **extra):
        with io.opened(path) as f:
            h = las.header(f.read_at(min(HEAD, size), 0))
        kind, step = las.record(h), h["point_format_size"]
        n = max(1, -(-h["point_count"] // block_points))

        def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with io.opened(path) as f:
                for b in batches:
                    rows = []
                    for i in b.column(0).to_pylist():
                        lo, hi = i * block_points, min(h["point_count"], (i + 1) * block_points)
                        p = np.frombuffer(f.read_at((hi - lo) * step, h["offset_to_point_data"] + lo * step), kind)
                        if len(p):
                            x, y = (p[c] * s + o for c, s, o in zip("XY", h["scales"], h["offsets"]))
                            rows.append((i, h["offset_to_point_data"] + lo * step, h["offset_to_point_data"] + hi * step, x.min(), x.max(), y.min(), y.max()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.float64()) for k in range(7)], ["ordinal", "start", "end", "min_x", "max_x", "min_y", "max_y"])

        tasks = len(rules.task_groups(n, h["point_count"] * step))
        table = spark.range(0, n, 1, min(tasks, 10_000)).mapInArrow(extents, "ordinal long, start long, end long, min_x double, max_x double, min_y double, max_y double")
        return h, {"blocks": table}

    def schema(self, manifest, options):
        return "x double, y double, z double, intensity int, classification int, point_no long, tile_x int, tile_y int"

    def points(self, manifest: Manifest, part: dict, options: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        h = manifest.attributes
        kind, step = las.record(h), h["point_format_size"]
        shut = options.get("boundary", "half_open") == "closed"
        with io.opened(manifest.path) as f:
            for lo, hi in part["ranges"]:
                for at in range(lo, hi, step * BLOCK_POINTS):
                    p = np.frombuffer(f.read_at(min(hi, at + step * BLOCK_POINTS) - at, at), kind)
                    x, y, z = (p[c] * s + o for c, s, o in zip("XYZ", h["scales"], h["offsets"]))
                    up_x = x <= part["max_x"] if shut or part["last_x"] else x < part["max_x"]
                    up_y = y <= part["max_y"] if shut or part["last_y"] else y < part["max_y"]
                    on = (x >= part["min_x"]) & (y >= part["min_y"]) & up_x & up_y
                    number = (at - h["offset_to_point_data"]) // step + np.flatnonzero(on)
                    yield x[on], y[on], z[on], p[on], number

    def read(self, manifest, part, options):
        for x, y, z, p, number in self.points(manifest, part, options):
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x), pa.array(y), pa.array(z), pa.array(p["intensity"].astype(np.int32)), pa.array(p["classification"].astype(np.int32)), pa.array(number.astype(np.int64)), pa.array(np.full(n, part["tile_x"], np.int32)), pa.array(np.full(n, part["tile_y"], np.int32))],
                ["x", "y", "z", "intensity", "classification", "point_no", "tile_x", "tile_y"],
            )

    def prune(self, manifest, slices, ranges):
        """Tiles that do not meet a closed range of x or y are not read."""
        for axis in "xy":
            if axis in ranges:
                lo, hi = ranges[axis]
                slices = [s for s in slices if s[f"max_{axis}"] >= lo and s[f"min_{axis}"] <= hi]
        return slices

    def render(self, manifest, part, options):
        """A LAS file of the tile's points (format 0)."""
        scales, offsets = manifest.attributes["scales"], manifest.attributes["offsets"]
        out, found = bytearray(las.HEADER_SIZE), []
        for x, y, z, p, _ in self.points(manifest, part, options):
            made = las.points(x, y, z, p["intensity"], p["classification"], scales, offsets)
            if len(made):
                out += made.tobytes()
                found.append((len(made), *las.extent(made)))
        low, high = ([f(v) for v in zip(*(e[k] for e in found))] or [0] * 3 for f, k in ((min, 1), (max, 2)))
        out[: las.HEADER_SIZE] = las.head(sum(e[0] for e in found), low, high, scales, offsets)
        return bytes(out)


class Copc(Format):
    """Header, attributes and tile grid of a COPC file; its points are always compressed and have no decoder here."""

    name = "copc"
    attributes = {"points": "bigint", **{f"{a}_{k}": "double" for a in "xyz" for k in ("scale", "offset", "max", "min")}, "root_offset": "bigint", "root_size": "bigint"}
    strategies = {"square_split": lambda m, num_chunks: rules.boxes((m.attributes["x_min"], m.attributes["y_min"]), (m.attributes["x_max"], m.attributes["y_max"]), num_chunks)}
    default = "square_split"

    def build(self, spark, path, size, chunk_size=None, **extra):
        with io.opened(path) as f:
            return las.copc_info(f.read_at(min(HEAD, size), 0)), {}

    def schema(self, manifest, options):
        return Las().schema(manifest, options)

    def read(self, manifest, part, options):
        raise NotImplementedError("COPC points are LAZ-compressed, for which there is no decoder here; attributes and plan are available")
