"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids plus an end id; only those longer than a sequence are cut. Packing needs nothing but the
lengths, and a length is one of at most CAPACITY values, so the instance is a histogram: its size does not grow with the
corpus. On it, sets that provably dominate every other set with the same item are fixed for good, as often as the counts
allow: a pair that fills a sequence exactly; an item beside which nothing fits; an item beside which at most one item
fits, with the largest such; an item with at most two beside it, if the largest single one is at least as long as any
such two. What remains is packed best-fit in decreasing order, class by class. Pieces then find their place by their
rank among the pieces of their length: ranks are counted in slices of a hash, so that a length that a third of all
pieces share is spread over many tasks.

Defined cases: null text is empty and packs as its end id alone; rows that repeat a doc_id are packed each; null doc_ids
are kept; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostride.llm.memory import released
from geostride.llm.tokens import default_path, encoder, slices
from geostride.session import materialize, ship, table

CAPACITY = 2048
END_ID = 0


@dataclass
class Bins:
    """`count` sequences that all hold items of these lengths."""

    count: int
    items: tuple[int, ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Fix dominating sets, taking them out of `counts`."""
    fixed: list[Bins] = []

    def take(n: int, *items: int) -> None:
        fixed.append(Bins(n, items))
        for x in items:
            counts[x] -= n
            if not counts[x]:
                del counts[x]

    if n := counts.get(capacity, 0):
        take(n, capacity)
    for a in sorted(counts, reverse=True):  # exact pairs dominate, whatever the item
        b = capacity - a
        if a in counts and b in counts and (n := counts[a] // 2 if a == b else min(counts[a], counts[b])):
            take(n, a, b)
    changed = True
    while changed:
        changed = False
        for a in sorted(counts, reverse=True):
            while a in counts:
                rest = capacity - a
                sizes = sorted(counts)
                others = lambda x: counts[x] - (x == a)  # noqa: E731  besides one item a
                small = []  # the three smallest besides a
                for x in sizes:
                    small += [x] * min(3 - len(small), others(x))
                    if len(small) == 3:
                        break
                if not small or small[0] > rest:
                    take(1 if a in sizes and 2 * a <= capacity else counts[a], a)
                    changed = True
                    continue
                k = next(x for x in reversed(sizes[: bisect.bisect_right(sizes, rest)]) if others(x))
                alone = len(small) < 2 or small[0] + small[1] > rest
                if not alone:
                    if len(small) == 3 and sum(small) <= rest:
                        break
                    if _largest_pair(sizes, others, rest) > k:
                        break
                # all alike pairs at once only while the same argument holds for each of them: the counts of the two lengths bound it
                n = counts[a] // 2 if k == a else min(counts[a], counts[k])
                take(n if alone else 1, a, k)
                changed = True
    return fixed


def _largest_pair(sizes: list[int], others, most: int) -> int:
    """The largest sum of two items besides the one in question that is at most `most`; 0 without one."""
    there = [x for x in sizes if others(x)]
    best = max((2 * x for x in there if 2 * x <= most and others(x) >= 2), default=0)
    lo, hi = 0, len(there) - 1
    while lo < hi:
        s = there[lo] + there[hi]
        if s <= most:
            best = max(best, s)
            lo += 1
        else:
            hi -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing, all items of a length and all sequences with the same room at once."""
    open_: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(room: int, b: Bins) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(b)

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                b = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, b = capacity, Bins(n, ())
            each = room // x
            full = min(b.count, n // each)
            used = full
            if full:
                put(room - each * x, Bins(full, b.items + (x,) * each))
                n -= full * each
            if n and full < b.count and n < each:
                put(room - n * x, Bins(1, b.items + (x,) * n))
                n, used = 0, full + 1
            if b.items and used < b.count:
                put(room, Bins(b.count - used, b.items))
    return [b for bs in open_.values() for b in bs]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """L2: the sequences that any packing needs."""
    best = 0
    for k in range(0, capacity // 2 + 1):
        big = sum(n for x, n in counts.items() if x > capacity - k)
        mid = sum(n for x, n in counts.items() if capacity / 2 < x <= capacity - k)
        room = mid * capacity - sum(n * x for x, n in counts.items() if capacity / 2 < x <= capacity - k)
        small = sum(n * x for x, n in counts.items() if k <= x <= capacity / 2)
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Length -> (first ranks, first sequence numbers, offsets): pieces of this length with ranks from first rank k on
    lie in the sequences from first sequence k on, at offset k."""
    counts = {x: n for x, n in histogram.items() if n}
    bins = reduce_by_dominance(counts, capacity)
    bins += best_fit(counts, capacity)
    places: dict[int, tuple[list[int], list[int], list[int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for b in bins:
        offset = 0
        for x in b.items:
            firsts, sequences, offsets = places.setdefault(x, ([], [], []))
            firsts.append(ranks.get(x, 0))
            sequences.append(base)
            offsets.append(offset)
            ranks[x] = ranks.get(x, 0) + b.count
            offset += x
        base += b.count
    return places


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids as bytes if asked for) of the whole texts."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    tail = struct.pack("<I", end_id)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows = []
                for key, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids += tail
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        rows.append((key, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.record_batch([pa.array(c, t) for c, t, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(released(cut), schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. cut must be written already: it is read twice."""
    spark = cut.sparkSession
    ship(spark)
    slices_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices_)).cast("int"))
    per_slice = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(per_slice.withColumn("_base", before), "pack-bases")
    # one row a length: at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = plan(histogram, capacity)
    own = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    # the rows are dealt and sorted by (length, slice) already, so a merge join moves only the bases
    ranked = sliced.withColumn("_rank", F.row_number().over(own) - 1).join(bases.select("length", "_slice", "_base").hint("merge"), ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_slice", "_base")
    columns = cut.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        arrays = {x: tuple(np.array(c, "i8") for c in p) for x, p in places.items()}
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
            for x in np.unique(lengths):
                at = lengths == x
                firsts, sequences, offsets = arrays[int(x)]
                k = np.searchsorted(firsts, ranks[at], "right") - 1
                sequence[at], offset[at] = sequences[k] + ranks[at] - firsts[k], offsets[k]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_rank").mapInArrow(released(located), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialize(pieces(docs, tokenizer, capacity, end_id), "pack-pieces"), capacity)


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids (bytes, little-endian u32), doc_ids in place order. A group is
    one sequence, so never more than `capacity` ids."""
    placed = place(materialize(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pack-pieces"), capacity)
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    grouped = placed.groupBy("sequence_id").agg(rows.alias("r"))
    hexed = F.array_join(F.transform("r", lambda x: F.hex(x["ids"])), "")
    return grouped.select("sequence_id", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.unhex(hexed).alias("ids"), F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
