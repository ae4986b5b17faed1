"""Raster windows of TIFF files."""

from __future__ import annotations

import posixpath

import numpy as np
import pyarrow as pa

from ..codecs import tiff
from ..functions import io
from ..plans import rules
from .base import Format, Manifest


def windows(manifest: Manifest, n_splits: int, exact: bool = False) -> list[dict]:
    key = posixpath.basename(manifest.path)
    return [{**w, "tile_key": key} for w in rules.raster_windows(manifest.attributes["width"], manifest.attributes["height"], n_splits, exact)]


class Raster(Format):
    """Cloud-optimised and other TIFF rasters; rows are pixels."""

    name = "cog"
    attributes = {"width": "bigint", "height": "bigint", "crs": "string", "bounds": "struct<left:double,bottom:double,right:double,top:double>", "transform": "array<double>"}
    strategies = {"grid": windows}
    default = "grid"

    def build(self, spark, path, size, chunk_size=None, **extra):
        with io.opened(path) as f:
            return tiff.attributes(tiff.directory(lambda n, at: f.read_at(n, at))), {}

    def schema(self, manifest, options):
        return "block_x int, block_y int, band int, row int, col int, value double"

    def pixels(self, manifest: Manifest, part: dict) -> np.ndarray:
        with io.opened(manifest.path) as f:
            read = lambda n, at: f.read_at(n, at)
            return tiff.window(read, tiff.directory(read), part["row_off"], part["col_off"], part["height"], part["width"])

    def read(self, manifest, part, options):
        for band, p in enumerate(self.pixels(manifest, part), 1):
            h, w = p.shape
            n = h * w
            fixed = lambda v: pa.array(np.full(n, v, np.int32))
            rows, cols = np.repeat(np.arange(h), w) + part["row_off"], np.tile(np.arange(w), h) + part["col_off"]
            yield pa.RecordBatch.from_arrays([fixed(part["block_x"]), fixed(part["block_y"]), fixed(band), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(p.ravel().astype(float))], ["block_x", "block_y", "band", "row", "col", "value"])

    def render(self, manifest, part, options):
        """A TIFF of the window, its transform moved to the window's corner."""
        a, b, c, d, e, f = manifest.attributes["transform"]
        r, k = part["row_off"], part["col_off"]
        crs = manifest.attributes.get("crs")
        return tiff.write(self.pixels(manifest, part), [a, b, c + a * k + b * r, d, e, f + d * k + e * r], int(crs[5:]) if crs else None)
