"""Tile archives (PMTiles version 3) as a batch data source.

    register(spark)
    spark.read.format("pmtiles").option("what", "entries").load("/maps/*.pmtiles")

what: header (a row an archive, with its error if it can't be read), entries (a row a directory entry, offsets resolved,
leaves flattened), or blobs (a row a distinct stored blob, the bytes as they are stored). The driver opens no archive: the
tasks of one share its root entries by turns, and its blobs by stretches of the data, for which each of them walks the
directories. For large archives read the entries and hand them to `read_blobs`, which walks none again. An archive that
can't be read fails the read of its entries and blobs unless skip_damaged is true. Options: minzoom and maxzoom (entries and blobs), partitions (tasks of an
archive), verify, skip_damaged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geostride.session import ship
from geostride.sources.bytes import FormatError, RangeFile, expand, inflate, varint

HEADER_LEN = 127
HEADER = (
    "path string, root_off long, root_len long, meta_off long, meta_len long, leaf_off long, leaf_len long, data_off long, data_len long, "
    "n_addressed long, n_entries long, n_contents long, clustered boolean, internal_compression int, tile_compression int, tile_type int, min_zoom int, max_zoom int, "
    "min_lon_e7 int, min_lat_e7 int, max_lon_e7 int, max_lat_e7 int, center_zoom int, center_lon_e7 int, center_lat_e7 int, error string"
)
ENTRIES = "path string, leaf int, ord int, tile_id long, run_length long, length long, offset long"
BLOBS = "path string, offset long, length long, payload binary"
NONE, GZIP = 1, 2
MOST_LEVELS = 4
_NAMES = [f.split()[0] for f in HEADER.split(", ")]


def parse_header(raw: bytes) -> dict:
    if len(raw) < HEADER_LEN:
        raise FormatError("shorter than a header")
    if raw[:7] != b"PMTiles":
        raise FormatError("wrong magic")
    if raw[7] != 3:
        raise FormatError(f"version {raw[7]}")
    values = struct.unpack_from("<11Q", raw, 8) + struct.unpack_from("<6B4iB2i", raw, 96)
    head = dict(zip(_NAMES[1:-1], values, strict=True))
    if any(v >= 1 << 63 for v in values[:11]):
        raise FormatError("offset over 63 bits")
    if not head["root_len"]:
        raise FormatError("empty root directory")
    head["clustered"] = bool(head["clustered"])
    return head


@dataclass
class Entry:
    tile_id: int
    run: int
    length: int
    offset: int


def parse_directory(raw: bytes) -> list[Entry]:
    """Entries of an unpacked directory: runs of id steps, run lengths, lengths, offsets; a stored offset of 0 follows
    on the entry before it."""
    end = len(raw)
    n, at = varint(raw, 0, end)
    if n > end:
        raise FormatError("more entries than bytes")
    columns: list[list[int]] = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(raw, at, end)
            column.append(v)
        columns.append(column)
    out, tile, follow = [], 0, 0
    for step, run, length, stored in zip(*columns, strict=True):
        tile += step
        offset = follow if stored == 0 else stored - 1
        if tile >= 1 << 63 or offset >= 1 << 63:
            raise FormatError("number over 63 bits")
        follow = offset + length
        out.append(Entry(tile, run, length, offset))
    return out


class Archive:
    """An open archive: its header and directories."""

    def __init__(self, path: str, verify: bool = True):
        self.path, self.verify = path, verify
        self.file = RangeFile(path)
        self.head = parse_header(self.file.read(0, min(HEADER_LEN, self.file.size)))
        if self.file.size < self.head["data_off"] + self.head["data_len"]:
            raise FormatError("file shorter than its data")

    def directory(self, offset: int, length: int) -> list[Entry]:
        raw, codec = self.file.read(offset, length), self.head["internal_compression"]
        if codec == GZIP:
            raw = inflate(raw, self.verify)
        elif codec != NONE:
            raise FormatError(f"directory compression {codec}")
        return parse_directory(raw)

    def root(self) -> list[Entry]:
        return self.directory(self.head["root_off"], self.head["root_len"])

    def flat(self, entries: list[Entry], level: int = 1) -> Iterator[Entry]:
        """Entries with leaves replaced by what they hold."""
        for e in entries:
            if e.run:
                yield e
            elif level >= MOST_LEVELS:
                raise FormatError("directories nested too deep")
            else:
                yield from self.flat(self.directory(self.head["leaf_off"] + e.offset, e.length), level + 1)


@dataclass
class Part(InputPartition):
    path: str
    turn: int
    turns: int


class PmtilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.what = options.get("what", "entries")
        self.paths = expand(options["path"])
        self.verify = options.get("verify", "true").lower() == "true"
        self.skip = options.get("skip_damaged", "false").lower() == "true"
        self.most = max(1, int(options.get("partitions", 64)))
        low, high = int(options.get("minzoom", 0)), int(options.get("maxzoom", 30))
        below = lambda z: (4**z - 1) // 3
        self.first, self.end = below(low), below(high + 1)

    def partitions(self) -> list[Part]:
        turns = 1 if self.what == "header" else self.most
        return [Part(p, k, turns) for p in self.paths for k in range(turns)]

    def read(self, part: Part) -> Iterator[tuple]:
        if self.what == "header":
            try:
                head = Archive(part.path, self.verify).head
                yield (part.path, *(head[n] for n in _NAMES[1:-1]), None)
            except (FormatError, OSError) as e:
                yield (part.path, *([None] * (len(_NAMES) - 2)), str(e))
            return
        try:
            yield from self._rows(part)
        except (FormatError, OSError):
            if not self.skip:
                raise

    def _rows(self, part: Part) -> Iterator[tuple]:
        archive = Archive(part.path, self.verify)
        root = archive.root()
        # an entry covers ids up to the next one's: those outside the zooms are left out before any leaf is read
        ends = [e.tile_id for e in root[1:]] + [1 << 63]
        wanted = [e for e, stop in zip(root, ends, strict=True) if e.tile_id < self.end and stop > self.first]
        inside = lambda e: e.tile_id < self.end and e.tile_id + e.run > self.first
        if self.what == "entries":
            size = -(-len(wanted) // part.turns)
            own = wanted[part.turn * size : (part.turn + 1) * size]
            yield from ((part.path, part.turn * size, k, e.tile_id, e.run, e.length, e.offset) for k, e in enumerate(archive.flat(own)) if inside(e))
            return
        stretch = -(-archive.head["data_len"] // part.turns) or 1
        blobs = {(e.offset, e.length) for e in archive.flat(wanted) if inside(e) and min(e.offset // stretch, part.turns - 1) == part.turn}
        for offset, length in sorted(blobs):
            yield (part.path, offset, length, archive.file.read(archive.head["data_off"] + offset, length))


class PmtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return {"header": HEADER, "entries": ENTRIES, "blobs": BLOBS}[self.options.get("what", "entries")]

    def reader(self, schema) -> PmtilesReader:
        return PmtilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and send the package to its executors."""
    ship(spark)
    spark.dataSource.register(PmtilesSource)


def read_blobs(entries: DataFrame) -> DataFrame:
    """(path, offset, length, payload) of entries (path, offset, length): each stored blob is read once, however many
    entries and tasks name it. Blobs are dealt by path and neighbourhood, so a task opens an archive once and reads
    forward in it."""
    spark = entries.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), 64):
                payloads = []
                for r in rows[k : k + 64]:
                    if archive is None or archive.path != r["path"]:
                        archive = Archive(r["path"])
                    payloads.append(archive.file.read(archive.head["data_off"] + r["offset"], r["length"]))
                part = batch.slice(k, 64)
                yield pa.record_batch([*part.columns, pa.array(payloads, pa.binary())], ["path", "offset", "length", "payload"])

    distinct = entries.select("path", "offset", "length").distinct()
    # a stretch of 16 MB of an archive is one task's
    dealt = distinct.selectExpr("*", f"offset div {16 << 20} as _stretch").repartition("path", "_stretch").sortWithinPartitions("path", "offset").drop("_stretch")
    return dealt.mapInArrow(run, BLOBS)
