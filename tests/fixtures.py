"""Writers of the formats that the sources read."""

from geostride.plans import encode
from geostride.plans.encode import directory, geometry, message, tile, varint, zigzag

__all__ = ["archive", "directory", "geometry", "message", "sentence", "tile", "varint", "zigzag"]


def archive(path, tiles, *args, **options):
    with open(path, "wb") as f:
        f.write(encode.archive(tiles, *args, **options))


def sentence(body):
    total = 0
    for c in body.encode():
        total ^= c
    return f"${body}*{total:02X}"
