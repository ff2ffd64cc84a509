"""Bytes in: files on any store, inflating, variable-length integers. Every length is checked before it is used."""

from __future__ import annotations

import fnmatch
import zlib


class FormatError(ValueError):
    """The bytes aren't what they should be; the message is the reason."""


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a local path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def expand(path: str) -> list[str]:
    """Files of a path, a comma-separated list, or a pattern in the last part (not recursive), without repeats."""
    from pyarrow import fs

    found: list[str] = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        store, inner = filesystem(one)
        folder, _, last = inner.rpartition("/")
        if any(c in last for c in "*?["):
            names = [i.path for i in store.get_file_info(fs.FileSelector(folder or ".")) if i.is_file and fnmatch.fnmatch(i.base_name, last)]
            prefix = one[: len(one) - len(inner)]
            found += [prefix + n for n in sorted(names)]
        else:
            found.append(one)
    return list(dict.fromkeys(found))


class RangeFile:
    """Reads of (offset, length) from one file; short ones are an error."""

    def __init__(self, path: str):
        store, inner = filesystem(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise FormatError("range outside the file")
        return self.file.read_at(length, offset)


def inflate(data: bytes, verify: bool = True, most: int = 1 << 30) -> bytes:
    """Unpacked gzip, zlib or raw DEFLATE, told apart by the first bytes. verify checks the trailer's checksum (gzip and
    zlib); otherwise only gzip's stated length is."""
    if data[:2] == b"\x1f\x8b":
        if verify:
            return _run(zlib.decompressobj(31), data, most)
        out = _run(zlib.decompressobj(-15), data[_gzip_head(data) :], most)
        if len(out) % (1 << 32) != int.from_bytes(data[-4:], "little"):
            raise FormatError("length differs from the stated one")
        return out
    if len(data) >= 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        if data[1] & 32:
            raise FormatError("preset dictionary")
        return _run(zlib.decompressobj(15), data, most) if verify else _run(zlib.decompressobj(-15), data[2:], most)
    return _run(zlib.decompressobj(-15), data, most)


def _run(d, data: bytes, most: int) -> bytes:
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise FormatError(f"inflate: {e}") from None
    if len(out) > most:
        raise FormatError("inflated data over the limit")
    if not d.eof:
        raise FormatError("inflate: the data end early")
    return out


def _gzip_head(data: bytes) -> int:
    if len(data) < 18:
        raise FormatError("gzip shorter than its frame")
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            at = data.find(b"\0", at) + 1
            if not at:
                raise FormatError("gzip: unfinished name")
    return at + 2 * bool(flags & 2)


def varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(value, place after it) of a base-128 number, at most 64 bits."""
    value = shift = 0
    while True:
        if at >= end:
            raise FormatError("number cut off")
        if shift > 63:
            raise FormatError("number over 64 bits")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def inflated(rows, column: str, verify: bool = True, most: int = 1 << 30):
    """rows with a column of packed bytes (gzip, zlib or raw DEFLATE) unpacked, in Arrow batches; null stays null, and what
    can't be unpacked is null too."""
    import pyarrow as pa

    from geostride.session import ship

    ship(rows.sparkSession)
    at = rows.columns.index(column)

    def one(data: bytes | None) -> bytes | None:
        try:
            return None if data is None else inflate(data, verify, most)
        except FormatError:
            return None

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.set_column(at, column, pa.array([one(x.as_py()) for x in part.column(at)], pa.binary()))

    return rows.mapInArrow(run, rows.schema)
