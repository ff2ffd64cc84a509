"""Token ids as length-delimited binary records.

A file holds one record after another, in ascending doc_id order over the files by number. A record:

    length   u64  bytes of the body
    masked   u32  checksum of those eight bytes
    body          flag u8 (1: the id is null), doc_id i64, width u8 (2 or 4), then the ids, unsigned, `width` bytes each
    masked   u32  checksum of the body
    end      one byte 0x0A

All integers are little-endian. A masked checksum is the CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that
checksums of data that hold checksums stay apart. A separate index, written beside the files (Parquet: file, doc_id,
offset, length, n_tokens, before, ids_crc32), gives every record's place, for reads in any order.

Files are written by Spark's own writer, so they land in any store that Spark writes; they are read back with the
binaryFile source, a file at a time. Rows are range-partitioned by doc_id before they are encoded, so each task writes one
sorted file; there are as many as keep the text of a file at FILE_BYTES on average, so files grow in number, not in size.
The index is made by reading the files back, with every checksum checked.

Defined cases: null text is empty; null doc_ids come first; rows of one doc_id are ordered by text (a doc_id that very
many rows share makes one large file); empty tables write no record. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostride.llm.memory import released
from geostride.llm.tokens import default_path, encoder, slices
from geostride.session import fresh_path, materialize, ship, table

END_ID = 2
#: Bytes of text for a file, on average.
FILE_BYTES = 128 << 20
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<BqB")
RECORD = "file string, doc_id long, offset long, length long, n_tokens long, before long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """A record without its end byte. ids: little-endian u32; narrowed to 16 bits where all fit."""
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or int(wide.max()) < 1 << 16 else 4
    body = BODY.pack(doc_id is None, doc_id or 0, width) + (wide.astype("<u2").tobytes() if width == 2 else ids)
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def read_record(content: bytes, at: int) -> tuple[int | None, bytes, int]:
    """(doc_id, ids as u32, place after the record); ValueError where a checksum or the end byte is wrong."""
    import numpy as np

    if at + HEAD.size > len(content):
        raise ValueError(f"record at {at}: the file ends in its head")
    size, check = HEAD.unpack_from(content, at)
    if masked(content[at : at + 8]) != check:
        raise ValueError(f"record at {at}: wrong checksum of the length")
    start = at + HEAD.size
    body = content[start : start + size]
    end = start + size + 5
    if len(body) < size or content[end - 1 : end] != b"\n" or struct.unpack_from("<I", content, start + size)[0] != masked(body):
        raise ValueError(f"record at {at}: wrong checksum of the body")
    null, doc_id, width = BODY.unpack_from(body)
    ids = np.frombuffer(body, f"<u{width}", offset=BODY.size)
    return (None if null else doc_id), ids.astype("<u4").tobytes(), end


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Encode docs (doc_id, text) and write the record files below path."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    tail = struct.pack("<I", end_id)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = encode(texts[a:b])
                yield pa.record_batch([pa.array([frame(k, x + tail) for k, x in zip(keys[a:b], ids, strict=True)], pa.binary())], ["record"])

    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    records = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(released(framed), "record binary")
    # a cast to string keeps the bytes as they are, and the text writer writes them as they are
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back whole, check every checksum, and give each record's place and content digest."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at, before = [], 0, 0
                while at < len(content):
                    doc_id, ids, after = read_record(content, at)
                    rows.append((file.rpartition("/")[2], doc_id, at, after - at, len(ids) // 4, before, zlib.crc32(ids)))
                    before += len(ids) // 4
                    at = after
                for k in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[k : k + 10_000], strict=True))
                    yield pa.record_batch([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], [f.split()[0] for f in RECORD.split(", ")])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(released(parsed), RECORD)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids of all records before it, over all files in the order of their numbers (as text, the name of
    file 100000 would come before that of file 99999)."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long")
    # one row a file
    base = F.coalesce(F.sum("total").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(totals.select("file", base.alias("base")), "record-bases")
    return index.join(bases, "file").withColumn("start", F.col("base") + F.col("before"))


def read_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records at places (rows of the index), in any order: each file is opened once."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for content, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [read_record(content, at)[:2] for at in offsets]
                yield pa.record_batch([pa.array([d for d, _ in found], pa.int64()), pa.array([np.frombuffer(x, "<u4").astype("i8") for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    wanted = places.groupBy("file").agg(F.collect_list("offset").alias("offsets"))  # no more than a file's own records
    return files.join(wanted, "file").select("content", "offsets").mapInArrow(released(pick), "doc_id long, ids array<long>")


def write_indexed(docs: DataFrame, path: str, **options) -> None:
    """The record files below path/records and their index below path/index."""
    write_records(docs, f"{path}/records", **options)
    index_records(docs.sparkSession, f"{path}/records").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{path}/index")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    write_indexed(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return with_starts(read_index(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
