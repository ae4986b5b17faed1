"""Random access into gzip files through the system's libz.

`scan` inflates a file once, stopping at every deflate block's end, and notes restart points: where the block ends in the compressed bytes and
bits, how many bytes and line ends came before, and the last 32 KiB of text that the next block may refer to.  `text_from` restarts at a point.
Members of a multi-member file follow each other; a member's start is a point without a window.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Callable, Iterator

WINDOW = 1 << 15
Z_BLOCK, Z_NO_FLUSH, Z_STREAM_END, Z_BUF_ERROR = 5, 0, 1, -5
RAW, GZIP = -15, 31
IN, OUT = 1 << 16, 1 << 18


class Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p),
        ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


def library():
    """libz, or None where there is none."""
    for name in (ctypes.util.find_library("z"), "libz.so.1"):
        if name:
            try:
                lib = ctypes.CDLL(name)
                lib.zlibVersion.restype = ctypes.c_char_p
                return lib
            except OSError:
                pass
    return None


class Inflater:
    """One inflate state with its buffers, fed from read(n, offset)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, at: int, kind: int):
        self.lib, self.read, self.size, self.at = library(), read, size, at
        if self.lib is None:
            raise OSError("libz is not available")
        self.stream, self.out = Stream(), ctypes.create_string_buffer(OUT)
        self.held = b""
        self.check(self.lib.inflateInit2_(ctypes.byref(self.stream), kind, self.lib.zlibVersion(), ctypes.sizeof(Stream)))

    def check(self, code: int) -> int:
        if code not in (0, Z_STREAM_END, Z_BUF_ERROR):
            raise zlib.error(f"inflate: {code} {self.stream.msg}")
        return code

    def close(self) -> None:
        self.lib.inflateEnd(ctypes.byref(self.stream))

    def reset(self, kind: int) -> None:
        self.check(self.lib.inflateReset2(ctypes.byref(self.stream), kind))

    def prime(self, bits: int, value: int) -> None:
        self.check(self.lib.inflatePrime(ctypes.byref(self.stream), bits, value))

    def dictionary(self, window: bytes) -> None:
        self.check(self.lib.inflateSetDictionary(ctypes.byref(self.stream), window, len(window)))

    @property
    def position(self) -> int:
        """Compressed bytes used up."""
        return self.at - self.stream.avail_in

    def step(self, flush: int) -> tuple[bytes, int]:
        """What one call of inflate gives, and its code; b"" with code 0 at the end of input means truncation."""
        s = self.stream
        if not s.avail_in and self.at < self.size:
            self.held = self.read(min(IN, self.size - self.at), self.at)
            self.at += len(self.held)
            s.next_in, s.avail_in = ctypes.cast(ctypes.c_char_p(self.held), ctypes.c_void_p), len(self.held)
        s.next_out, s.avail_out = ctypes.cast(self.out, ctypes.c_void_p), OUT
        code = self.check(self.lib.inflate(ctypes.byref(s), flush))
        return self.out.raw[: OUT - s.avail_out] if s.avail_out < OUT else b"", code

    def skip_input(self, n: int) -> None:
        """Passes n compressed bytes by."""
        s = self.stream
        take = min(n, s.avail_in)
        s.next_in, s.avail_in = (s.next_in or 0) + take, s.avail_in - take
        self.at += n - take


def scan(read: Callable[[int, int], bytes], size: int, span: int) -> tuple[list[dict], int, int]:
    """(restart points about span bytes of text apart, bytes of text, lines)."""
    points: list[dict] = []
    total = ends = last = 0
    tail, final = b"", b""
    z = Inflater(read, size, 0, GZIP)
    try:
        member = True
        while True:
            if member:
                points.append({"compressed_byte": z.position, "bits": -1, "uncompressed_byte": total, "line_number": ends + 1, "mid_line": int(final not in (b"", b"\n")), "window": b""})
                last, tail, member = total, b"", False
            data, code = z.step(Z_BLOCK)
            if data:
                total, ends, final = total + len(data), ends + data.count(b"\n"), data[-1:]
                tail = (tail + data)[-WINDOW:] if len(data) < WINDOW else data[-WINDOW:]
            if code == Z_STREAM_END:
                if z.position >= size or read(2, z.position)[:2] != b"\x1f\x8b":
                    break
                z.reset(GZIP)
                member = True
                continue
            kind = z.stream.data_type
            if kind & 128 and not kind & 64 and total - last >= span:
                points.append({"compressed_byte": z.position, "bits": kind & 7, "uncompressed_byte": total, "line_number": ends + 1, "mid_line": int(final not in (b"", b"\n")), "window": tail})
                last = total
            if not data and code == Z_BUF_ERROR and z.position >= size:
                raise zlib.error("the file ends within a member")
    finally:
        z.close()
    return points, total, ends + (final not in (b"", b"\n"))


def text_from(read: Callable[[int, int], bytes], size: int, point: dict) -> Iterator[bytes]:
    """The text from a restart point to the file's end."""
    start, bits = point["compressed_byte"], point["bits"]
    whole = bits < 0
    z = Inflater(read, size, start, GZIP if whole else RAW)
    try:
        if bits > 0:
            z.prime(bits, read(1, start - 1)[0] >> (8 - bits))
        if not whole and point["window"]:
            z.dictionary(point["window"])
        while True:
            data, code = z.step(Z_NO_FLUSH)
            if data:
                yield data
            if code == Z_STREAM_END:
                if not whole:
                    z.skip_input(8)  # check value and length, which a raw stream leaves
                    whole = True
                if z.position >= size or read(2, z.position)[:2] != b"\x1f\x8b":
                    return
                z.reset(GZIP)
            elif not data and z.position >= size:
                raise zlib.error("the file ends within a member")
    finally:
        z.close()
