"""LAS point files: header, uncompressed point records, writer; COPC's header."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the public LAS 1.2-1.4 layout: header fields at their offsets, and the record of each point format up to the fields read here.
HEADER_SIZE = 227
BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
BASE_14 = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "<u2"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
GPS = [("gps_time", "<f8")]
COLOUR = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FORMATS = {0: BASE, 1: BASE + GPS, 2: BASE + COLOUR, 3: BASE + GPS + COLOUR, 6: BASE_14, 7: BASE_14 + COLOUR, 8: BASE_14 + COLOUR + [("nir", "<u2")]}


def header(data: bytes) -> dict:
    """Of the file's first 589 bytes or more."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    head_size, offset, vlrs = struct.unpack_from("<HII", data, 94)
    fmt, record, count = struct.unpack_from("<BHI", data, 104)
    if minor >= 4 and len(data) >= 255:
        (count64,) = struct.unpack_from("<Q", data, 247)
        count = count64 or count
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", data, 179)
    return {
        "version": f"{major}.{minor}", "header_size": head_size, "offset_to_point_data": offset, "vlrs": vlrs, "compressed": bool(fmt & 0xC0), "point_format": fmt & 0x3F, "point_format_size": record,
        "point_count": count, "scales": list(scale), "offsets": list(shift), "mins": [x0, y0, z0], "maxs": [x1, y1, z1],
    }


def copc_info(data: bytes) -> dict:
    """Header and the info record of a COPC file (the first variable-length record)."""
    h = header(data)
    at = h["header_size"]
    if data[at + 2 : at + 18].rstrip(b"\0") != b"copc" or struct.unpack_from("<H", data, at + 18)[0] != 1:
        raise ValueError("no COPC info record")
    root_offset, root_size = struct.unpack_from("<QQ", data, at + 54 + 40)
    out = {"points": h["point_count"]}
    for i, axis in enumerate("xyz"):
        out |= {f"{axis}_scale": h["scales"][i], f"{axis}_offset": h["offsets"][i], f"{axis}_max": h["maxs"][i], f"{axis}_min": h["mins"][i]}
    return out | {"root_offset": root_offset, "root_size": root_size, "header": h}


def record(h: dict) -> np.dtype:
    """The structured type of a point; extra bytes of longer records are passed over."""
    if h["compressed"]:
        raise NotImplementedError("compressed (LAZ) points have no decoder here")
    if h["point_format"] not in FORMATS:
        raise NotImplementedError(f"point format {h['point_format']}")
    fields = FORMATS[h["point_format"]]
    packed = np.dtype(fields)
    names, kinds = [n for n, _ in fields], [k for _, k in fields]
    return np.dtype({"names": names, "formats": kinds, "offsets": [packed.fields[n][1] for n in names], "itemsize": h["point_format_size"]})


def points(x, y, z, intensity, classification, scales=(0.01, 0.01, 0.01), offsets=(0.0, 0.0, 0.0)) -> np.ndarray:
    """Records of point format 0."""
    p = np.zeros(len(x), np.dtype(BASE))
    axes = [np.asarray(a, float) for a in (x, y, z)]
    for name, a, s, o in zip("XYZ", axes, scales, offsets):
        p[name] = np.rint((a - o) / s).astype(np.int64)
    p["intensity"], p["classification"] = intensity, classification
    return p


def extent(p: np.ndarray) -> tuple[list[int], list[int]]:
    """Least and greatest X, Y, Z of records, as they are stored; there must be some."""
    return [int(p[n].min()) for n in "XYZ"], [int(p[n].max()) for n in "XYZ"]


def head(count: int, low: list[int], high: list[int], scales=(0.01, 0.01, 0.01), offsets=(0.0, 0.0, 0.0)) -> bytes:
    """The header of a LAS 1.2 file of point format 0, from its records' number and extent."""
    shown = [sorted((float(a) * s + o, float(b) * s + o)) if count else (0.0, 0.0) for a, b, s, o in zip(low, high, scales, offsets)]
    data = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"rangeweave", 1, 2024, HEADER_SIZE, HEADER_SIZE, 0, 0, np.dtype(BASE).itemsize, count, count, 0, 0, 0, 0)
    return data + struct.pack("<12d", *scales, *offsets, *(v for a, b in shown for v in (b, a)))


def write(x, y, z, intensity, classification, scales=(0.01, 0.01, 0.01), offsets=(0.0, 0.0, 0.0)) -> bytes:
    """A LAS 1.2 file of point format 0."""
    p = points(x, y, z, intensity, classification, scales, offsets)
    low, high = extent(p) if len(p) else ([0] * 3, [0] * 3)
    return head(len(p), low, high, scales, offsets) + p.tobytes()
