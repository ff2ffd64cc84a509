"""A Bloom filter of fixed size over long ids: built by a grouped bit_or, looked up in numpy. It only saves work: what it
lets through is joined exactly afterwards, so a full filter costs time and no result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostride.llm.shingles import mix

#: 2^24 bits: 2 MB, whatever the input.
BITS = 1 << 24


def _places(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(BITS - 1), h >> np.uint64(40)])


def build(ids: DataFrame) -> np.ndarray:
    """ids: one long column. The filter as BITS / 64 words; at most so many rows come to the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)).ravel()
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
            merged = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            yield pa.record_batch([pa.array(word[first].astype(np.int64)), pa.array(merged.view(np.int64))], ["word", "bits"])

    rows = ids.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids)
    return ((filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)
