"""Vector tiles: one row for each part of each feature.

A wire reader for the tile's protocol buffer, with the layer filter applied before a layer's body is read, so that a
layer that nobody asked for costs a skip and may even be damaged. `decode_tiles` runs it over a DataFrame in Arrow
batches; `DecodeMvt` is the same as a table function for SQL. A damaged tile gives the rows before the damage and a row
with the error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from geostride.session import ship
from geostride.sources.bytes import FormatError, inflate, varint

PART = (
    "layer string, layer_index int, extent int, version int, feature_index int, feature_id long, geom string, part_index int, "
    "kind string, name string, pts array<struct<x:int,y:int>>, area2 long, is_outer boolean, error string"
)
NAMES = [f.split()[0] for f in PART.replace("struct<x:int,y:int>", "struct").split(", ")]
GEOMS = {1: "point", 2: "line", 3: "polygon"}
MOST_TILE = 3 << 20


def _fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, value or start, end) of a message."""
    while at < end:
        key, at = varint(data, at, end)
        field, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at, end)
            yield field, kind, value, at
        elif kind == 2:
            size, at = varint(data, at, end)
            if size > end - at:
                raise FormatError("field longer than its message")
            yield field, kind, at, at + size
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if size > end - at:
                raise FormatError("field longer than its message")
            yield field, kind, at, at + size
            at += size
        else:
            raise FormatError(f"wire type {kind}")


def _string(data: bytes, at: int, end: int) -> str:
    return data[at:end].decode("utf-8", "replace")


def _value(data: bytes, at: int, end: int) -> str | None:
    """A string value; values of other types take no part."""
    text = None
    for field, kind, a, b in _fields(data, at, end):
        if field == 1 and kind == 2:
            text = _string(data, a, b)
    return text


def _signed(v: int) -> int:
    v &= 0xFFFFFFFF
    return (v >> 1) ^ -(v & 1)


def _wrap(v: int) -> int:
    return (v + 0x80000000 & 0xFFFFFFFF) - 0x80000000


def decode_geometry(data: bytes, at: int, end: int, geom: str) -> Iterator[list[tuple[int, int]]]:
    """Parts of a geometry; a ring ends with its first point."""
    x = y = 0
    part: list[tuple[int, int]] = []
    while at < end:
        command, at = varint(data, at, end)
        op, count = command & 7, command >> 3 & 0x1FFFFFFF
        if op == 7:
            if geom != "polygon" or not part:
                raise FormatError("close without a ring")
            yield [*part, part[0]]
            part = []
            continue
        if op not in (1, 2):
            raise FormatError(f"command {op}")
        if op == 2 and not part:
            raise FormatError("line without a start")
        if op == 1 and part:
            yield part
            part = []
        for k in range(count):
            a, at = varint(data, at, end)
            b, at = varint(data, at, end)
            x, y = _wrap(x + _signed(a)), _wrap(y + _signed(b))
            if op == 1 and k and geom != "point":
                yield part
                part = []
            part.append((x, y))
    if part:
        yield part


def area2(pts: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip([pts[-1], *pts], pts, strict=False))


def decode_tile(tile: bytes, layers: frozenset[str] | None = None, kind_key: str = "kind", name_key: str = "name") -> Iterator[tuple]:
    """Rows as PART has them."""
    try:
        index = 0
        for field, kind, a, b in _fields(tile, 0, len(tile)):
            if field == 3 and kind == 2:
                yield from _layer(tile, a, b, index, layers, kind_key, name_key)
                index += 1
    except FormatError as e:
        yield (None,) * (len(NAMES) - 1) + (str(e),)


def _layer(tile: bytes, at: int, end: int, index: int, layers: frozenset[str] | None, kind_key: str, name_key: str) -> Iterator[tuple]:
    name = next((_string(tile, a, b) for f, k, a, b in _fields(tile, at, end) if f == 1 and k == 2), "")
    if layers is not None and name not in layers:
        return
    extent, version, keys, values, features = 4096, 1, [], [], []
    for f, k, a, b in _fields(tile, at, end):
        if f == 5 and k == 0:
            extent = a & 0xFFFFFFFF
        elif f == 15 and k == 0:
            version = a & 0xFFFFFFFF
        elif f == 3 and k == 2:
            keys.append(_string(tile, a, b))
        elif f == 4 and k == 2:
            values.append(_value(tile, a, b))
        elif f == 2 and k == 2:
            features.append((a, b))
    if not extent:
        raise FormatError("extent 0")
    wanted = {keys.index(key): slot for slot, key in enumerate((kind_key, name_key)) if key in keys}
    for number, (a, b) in enumerate(features):
        fid, geom, tags, body = 0, 0, (0, 0), (0, 0)
        for f, k, s, e in _fields(tile, a, b):
            if f == 1 and k == 0:
                fid = s
            elif f == 2 and k == 2:
                tags = (s, e)
            elif f == 3 and k == 0:
                geom = s
            elif f == 4 and k == 2:
                body = (s, e)
        if geom not in GEOMS or body[0] == body[1]:
            continue
        own: list[str | None] = [None, None]
        left, p = set(wanted), tags[0]
        while p < tags[1] and left:
            key, p = varint(tile, p, tags[1])
            if p >= tags[1]:
                break
            value, p = varint(tile, p, tags[1])
            if key in left:
                left.discard(key)
                own[wanted[key]] = values[value] if value < len(values) else None
        signed = fid - (1 << 64) if fid >= 1 << 63 else fid
        for part, pts in enumerate(decode_geometry(tile, *body, GEOMS[geom])):
            twice = area2(pts) if geom == 3 and len(pts) >= 3 else 0
            yield (name, index, extent, version, number, signed, GEOMS[geom], part, own[0], own[1], pts, twice, twice > 0 if geom == 3 and len(pts) >= 3 else True, None)


def unpack_tile(data: bytes | None) -> bytes:
    """A stored tile's bytes: gzip with its frame, at most MOST_TILE unpacked."""
    if data is None or len(data) < 18 or data[:2] != b"\x1f\x8b":
        raise FormatError("no gzip frame")
    return inflate(data, False, MOST_TILE)


_TYPES = (
    pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(),
    pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])), pa.int64(), pa.bool_(), pa.string(),
)


def decode_tiles(tiles: DataFrame, payload: str = "payload", layers: list[str] | None = None, compressed: bool = True, keys: tuple[str, str] = ("kind", "name")) -> DataFrame:
    """The other columns of tiles with each part of each feature."""
    ship(tiles.sparkSession)
    kept = [f for f in tiles.schema.fields if f.name != payload]
    wanted = None if layers is None else frozenset(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(0)[row].as_py()
                try:
                    raw = unpack_tile(data) if compressed else data or b""
                    rows = list(decode_tile(raw, wanted, *keys))
                except FormatError as e:
                    rows = [(None,) * (len(NAMES) - 1) + (str(e),)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    pts = [None if p is None else [{"x": x, "y": y} for x, y in p] for p in columns[10]]
                    own = [pa.array(pts if i == 10 else list(c), t) for i, (c, t) in enumerate(zip(columns, _TYPES, strict=True))]
                    again = [batch.column(i + 1).slice(row, 1).take(pa.array([0] * len(rows))) for i in range(len(kept))]
                    yield pa.record_batch([*again, *own], [*(f.name for f in kept), *NAMES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), PART])
    return tiles.select(payload, *(f.name for f in kept)).mapInArrow(run, schema)


@udtf(returnType=PART)
class DecodeMvt:
    """SQL: SELECT ... FROM tiles, LATERAL decode_mvt(payload)."""

    def eval(self, payload: bytes):
        try:
            yield from decode_tile(unpack_tile(payload))
        except FormatError as e:
            yield (None,) * (len(NAMES) - 1) + (str(e),)


UBX = "frame_class int, frame_id int, payload binary, checksum_ok boolean"


@udtf(returnType=UBX)
class SplitUbx:
    """SQL: SELECT ... FROM streams, LATERAL split_ubx(content)."""

    def eval(self, content: bytes):
        yield from split_ubx(content or b"")


def register(spark: SparkSession) -> None:
    """Make the table functions decode_mvt and split_ubx known to a session, and send the package to its executors."""
    ship(spark)
    spark.udtf.register("decode_mvt", DecodeMvt)
    spark.udtf.register("split_ubx", SplitUbx)


def ubx_frames(streams: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of streams with each binary frame in their bytes."""
    ship(streams.sparkSession)
    kept = [f for f in streams.schema.fields if f.name != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                frames = list(split_ubx(batch.column(0)[row].as_py() or b""))
                if frames:
                    columns = [pa.array(c, t) for c, t in zip(zip(*frames, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)]
                    again = [batch.column(i + 1).slice(row, 1).take(pa.array([0] * len(frames))) for i in range(len(kept))]
                    yield pa.record_batch([*again, *columns], [*(f.name for f in kept), *(f.split()[0] for f in UBX.split(", "))])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), UBX])
    return streams.select(content, *(f.name for f in kept)).mapInArrow(run, schema)


def decoder_stats(parts: DataFrame) -> DataFrame:
    """One row: what a decode met. layers, features, parts, points, most points of a part, damaged tiles. parts: of
    decode_tiles, with the tile's z, x, y."""
    n = F.size("pts")
    tile = ("z", "x", "y")
    whole = F.col("error").isNull()
    return parts.agg(
        F.count_distinct(F.when(whole, F.struct(*tile, "layer_index"))).alias("layers"), F.count_distinct(F.when(whole, F.struct(*tile, "layer_index", "feature_index"))).alias("features"),
        F.count(F.when(whole, 1)).alias("parts"), F.coalesce(F.sum(F.when(whole, n)), F.lit(0)).cast("long").alias("points"), F.coalesce(F.max(F.when(whole, n)), F.lit(0)).alias("most_points"), F.count(F.when(~whole, 1)).alias("damaged"),
    )


def quarantine(parts: DataFrame) -> DataFrame:
    """(z, x, y, error): each tile that failed to decode, once."""
    return parts.filter("error is not null").groupBy("z", "x", "y").agg(F.min("error").alias("error"))


def split_ubx(stream: bytes, most: int = 504) -> Iterator[tuple[int, int, bytes, bool]]:
    """(class, id, payload, checksum right) of the binary frames in a receiver's stream; oversized ones are dropped."""
    at = 0
    while (at := stream.find(b"\xb5\x62", at)) >= 0 and at + 8 <= len(stream):
        cls, ident, size = struct.unpack_from("<BBH", stream, at + 2)
        if size > most or at + 8 + size > len(stream):
            at += 2
            continue
        a = k = 0
        for b in stream[at + 2 : at + 6 + size]:
            a = (a + b) & 255
            k = (k + a) & 255
        yield cls, ident, stream[at + 6 : at + 6 + size], stream[at + 6 + size : at + 8 + size] == bytes((a, k))
        at += 8 + size
