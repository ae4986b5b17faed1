"""Repair of byte ranges at delimiters.

A record belongs to the slice that holds its first byte.  The start of a slice moves behind the first delimiter at or after the byte
before it; its end moves by the same rule, so that neighbours meet exactly, whatever the sizes.
"""

from __future__ import annotations

STEP = 1 << 16


def repaired(f, position: int, base: int, size: int, delimiters: bytes = b"\n") -> int:
    """Where the first record that starts at or after position begins."""
    if position <= base:
        return base
    if position >= size:
        return size
    at = position - 1
    while at < size:
        block = f.read_at(min(STEP, size - at), at)
        found = [i for i in (block.find(bytes([d])) for d in delimiters) if i >= 0]
        if found:
            return min(at + min(found) + 1, size)
        at += len(block)
    return size


def slice_bytes(f, start: int, end: int, base: int, size: int, delimiters: bytes = b"\n") -> tuple[int, int, bytes]:
    lo, hi = repaired(f, start, base, size, delimiters), repaired(f, end, base, size, delimiters)
    return lo, hi, f.read_at(hi - lo, lo) if hi > lo else b""
