"""Byte access to a file system by URI, on the driver and on executors alike."""

from __future__ import annotations

import json
import posixpath
from typing import Any

from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def opened(uri: str):
    """A random-access file: size(), read_at(n, offset)."""
    f, path = locate(uri)
    return f.open_input_file(path)


def size(uri: str) -> int:
    f, path = locate(uri)
    info = f.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.Directory:
        return sum(i.size for i in f.get_file_info(pafs.FileSelector(path, recursive=True)) if i.type == pafs.FileType.File)
    return info.size


def exists(uri: str) -> bool:
    f, path = locate(uri)
    return f.get_file_info(path).type != pafs.FileType.NotFound


def listing(uri: str) -> list[str]:
    """Files below a folder, relative to it."""
    f, path = locate(uri)
    return sorted(i.path[len(path) :].lstrip("/") for i in f.get_file_info(pafs.FileSelector(path, recursive=True)) if i.type == pafs.FileType.File)


def read_bytes(uri: str) -> bytes:
    with opened(uri) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    f, path = locate(uri)
    f.create_dir(posixpath.dirname(path), recursive=True)
    with f.open_output_stream(path, compression=None) as out:
        out.write(data)


def created(uri: str):
    """A new file to write to, block by block."""
    f, path = locate(uri)
    f.create_dir(posixpath.dirname(path), recursive=True)
    return f.open_output_stream(path, compression=None)


def join_files(target: str, parts: list[str], head: bytes = b"", tail: bytes = b"") -> None:
    """The parts one behind the other as one file, passed on in blocks."""
    with created(target) as out:
        out.write(head)
        for p in parts:
            with opened(p) as src:
                while block := src.read(8 << 20):
                    out.write(block)
        out.write(tail)


def copy_file(source: str, target: str, override: bool = False) -> None:
    """Copies a raw file in blocks; an existing target is an error unless override."""
    if exists(target):
        if not override:
            raise FileExistsError(target)
        delete(target)
    f, path = locate(target)
    f.create_dir(posixpath.dirname(path), recursive=True)
    with opened(source) as src, f.open_output_stream(path, compression=None) as out:
        while block := src.read(8 << 20):
            out.write(block)


def delete(uri: str) -> None:
    f, path = locate(uri)
    kind = f.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        f.delete_dir(path)
    elif kind == pafs.FileType.File:
        f.delete_file(path)


def move(source: str, target: str) -> None:
    """Puts a file or folder in the place of another, which goes only now."""
    f, path = locate(source)
    if exists(target):
        delete(target)
    f.move(path, locate(target)[1])


def read_json(uri: str) -> Any:
    return json.loads(read_bytes(uri))


def write_json(uri: str, value: Any) -> None:
    write_bytes(uri, json.dumps(value, indent=1).encode())


def split_uri(uri: str) -> tuple[str, str]:
    """(bucket, key) of a URI with a scheme, with .. and . resolved within the bucket."""
    scheme, sep, rest = uri.partition("://")
    if not sep or not scheme:
        raise ValueError(f"not a URI: {uri}")
    bucket, _, key = rest.partition("/")
    key = posixpath.normpath("/" + key).lstrip("/") if key else ""
    return bucket, key


def join_uri(scheme: str, bucket: str, key: str) -> str:
    return f"{scheme}://{bucket}/{posixpath.normpath('/' + key).lstrip('/')}"


def parent(key: str) -> str:
    """The virtual folder of a key."""
    return posixpath.dirname(key)
