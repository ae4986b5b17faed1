"""The formats by name; register_format adds one's own."""

from __future__ import annotations

from .base import Format, Source
from .fasta import Fasta
from .gzipped import Fastq, GzipText
from .imzml import ImzML
from .measurement import MeasurementSet
from .pointcloud import Copc, Las
from .raster import Raster
from .text import Csv, Text
from .vcf import Vcf, VcfGz

FORMATS: dict[str, Format] = {}
_sources: dict[str, type[Source]] = {}


def register_format(fmt: Format) -> Format:
    """Makes a format known by its name; a later one of the same name takes its place."""
    if not fmt.name:
        raise ValueError("a format needs a name")
    FORMATS[fmt.name] = fmt
    _sources.pop(fmt.name, None)
    return fmt


def format_of(fmt: str | Format) -> Format:
    if isinstance(fmt, Format):
        return fmt
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(FORMATS)}")
    return FORMATS[fmt]


def source_class(fmt: Format) -> type[Source]:
    if fmt.name not in _sources:
        _sources[fmt.name] = type(f"{type(fmt).__name__}Source", (Source,), {"fmt": fmt})
    return _sources[fmt.name]


for _fmt in (Csv(), Text(), GzipText(), Fastq(), Fasta(), Vcf(), VcfGz(), Las(), Copc(), Raster(), ImzML(), MeasurementSet()):
    register_format(_fmt)
