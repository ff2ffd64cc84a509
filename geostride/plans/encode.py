"""Bytes of archives and tiles, for the surrogates of the queries and for tests."""

from __future__ import annotations

import gzip
import struct


def varint(v):
    out = bytearray()
    while True:
        out.append(v & 127 | (128 if v > 127 else 0))
        v >>= 7
        if not v:
            return bytes(out)


def directory(entries):
    """entries: (tile_id, run, length, offset), offsets contiguous where they can be."""
    ids, runs, lengths, offsets, last, follow = b"", b"", b"", b"", 0, None
    for tile, run, length, offset in entries:
        ids += varint(tile - last)
        runs += varint(run)
        lengths += varint(length)
        offsets += varint(0 if offset == follow else offset + 1)
        last, follow = tile, offset + length
    return varint(len(entries)) + ids + runs + lengths + offsets


def archive(tiles, leaf_size=None, codec=2, version=3, zooms=(0, 14), bounds=(-1800000000, -850000000, 1800000000, 850000000)):
    """Bytes of an archive. tiles: {(first id, run): payload}; equal payloads are stored once."""
    data, where, entries = b"", {}, []
    for (tile, run), payload in sorted(tiles.items()):
        if payload not in where:
            where[payload] = len(data)
            data += payload
        entries.append((tile, run, len(payload), where[payload]))
    pack = (lambda b: gzip.compress(b, mtime=0)) if codec == 2 else (lambda b: b)
    leaves = b""
    if leaf_size:
        root = []
        for k in range(0, len(entries), leaf_size):
            leaf = pack(directory(entries[k : k + leaf_size]))
            root.append((entries[k][0], 0, len(leaf), len(leaves)))
            leaves += leaf
        root = pack(directory(root))
    else:
        root = pack(directory(entries))
    at = [127, 127 + len(root), 127 + len(root), 127 + len(root) + len(leaves)]
    head = b"PMTiles" + bytes([version]) + struct.pack("<11Q", at[0], len(root), at[1], 0, at[2], len(leaves), at[3], len(data), len(entries), len(entries), len(where))
    head += struct.pack("<6B4iB2i", 1, codec, 2, 1, *zooms, *bounds, 3, 0, 0)
    return head + root + leaves + data


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def zigzag(v):
    return (v << 1) ^ (v >> 63)


def geometry(kind, parts):
    out, x, y = b"", 0, 0
    if kind == "point":
        parts = [[p for part in parts for p in part]]
    for part in parts:
        ring = part[:-1] if kind == "polygon" else part
        steps = []
        for px, py in ring:
            steps.append(varint(zigzag(px - x)) + varint(zigzag(py - y)))
            x, y = px, py
        if kind == "point":
            out += varint(len(steps) << 3 | 1) + b"".join(steps)
        else:
            out += varint(1 << 3 | 1) + steps[0] + varint(len(steps) - 1 << 3 | 2) + b"".join(steps[1:])
        if kind == "polygon":
            out += varint(1 << 3 | 7)
    return out


def tile(layers):
    """layers: (name, extent, [(id, kind of geometry, {tags}, parts)])."""
    out = b""
    for name, extent, features in layers:
        keys, values, body = [], [], b""
        for fid, kind, tags, parts in features:
            pairs = b""
            for k, v in tags.items():
                keys += [k] * (k not in keys)
                values += [v] * (v not in values)
                pairs += varint(keys.index(k)) + varint(values.index(v))
            shape = parts if isinstance(parts, bytes) else geometry(kind, parts)
            body += message((2, message((1, fid), (2, pairs), (3, {"point": 1, "line": 2, "polygon": 3}.get(kind, 0)), (4, shape))))
        encoded = [message((1, v.encode())) if isinstance(v, str) else message((4, v)) for v in values]
        out += message((3, message((1, name.encode())) + body + b"".join(message((3, k.encode())) for k in keys) + b"".join(message((4, v)) for v in encoded) + message((5, extent), (15, 2))))
    return out
