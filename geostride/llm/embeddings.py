"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated by a seeded random rotation and kept as the signs of its coordinates, with two correction
factors: the inner product of the vector with its own code, and the length that code leaves unexplained. From the codes
and the factors follows an unbiased estimate of the inner product of two vectors, and a bound of its error that holds
with the confidence of BOUND standard deviations. A pair whose upper bound lies under the threshold is done with; every
other pair is computed again in double precision from the vectors, and only that decides a link. A pair that the bound
wrongly rules out is a chance of about 1e-9.

Which pairs are looked at: equal vectors of a label are first folded into one with a count (a grouped count, combined
before the exchange). The distinct vectors of a label and length then meet in buckets: a band is some sign bits of random
projections, and vectors with equal bits share a bucket. There are so many bands that a pair at the threshold shares none
of them with a chance of at most MISS (closer pairs with less). Bits and bands are those that copy a vector least often:
for few vectors no bits at all, which is every pair; more bits for more vectors, so that a bucket stays at about BLOCK
vectors and copies grow much slower than the vectors. A bucket of more than BLOCK vectors is cut into chunks that meet in
pairs, so a task never holds more than two. A pair that shares several bands counts in the first of them. A task returns
counts of links and a spanning forest, never the links themselves.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null label link with
nothing (n_links 0, component the row's own id, kept); vectors of different lengths don't link; rows that repeat an id
with the same vector count as copies of each other; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostride.llm.graph import UnionFind, components
from geostride.llm.memory import released
from geostride.session import discard, materialize, ship, table

LEAST = 0.98
BLOCK = 1500
BOUND = 6.0
SEED = 3
#: Chance that a pair at the threshold shares no band; bits of a band at most.
MISS, MOST_BITS = 1e-12, 24


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    v = np.asarray(vectors, float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as packed sign bits, inner product of each vector with its code's unit vector)."""
    rotated = u @ rotation(u.shape[1]).T
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(1) / math.sqrt(u.shape[1])


def upper_bounds(codes: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Of the inner products of coded vectors (rows) with rotated vectors (columns).

    With o a vector, s its code's unit vector and f = <o, s>, <s, q> / f estimates <o, q> without bias; the error has the
    deviation sqrt((1 - f^2) / f^2 / (d - 1)) for a random rotation."""
    d = rotated.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    estimate = (signs @ rotated.T.astype(np.float32)) / factor[:, None].astype(np.float32)
    error = BOUND * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1))
    return estimate + (error + 1e-4)[:, None].astype(np.float32)


def linked_pairs(a: np.ndarray, b: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with inner product >= least: of a with b, or within a (i < j) where b is None."""
    codes, factor = encode(a)
    other = a if b is None else b
    rotated = other @ rotation(a.shape[1]).T
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for k in range(0, len(a), 512):
        i, j = np.nonzero(upper_bounds(codes[k : k + 512], factor[k : k + 512], rotated) >= least)
        i += k
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 200_000):
            ii, jj = i[s : s + 200_000], j[s : s + 200_000]
            ok = np.einsum("ij,ij->i", a[ii], other[jj]) >= least
            left.append(ii[ok])
            right.append(jj[ok])
    return np.concatenate(left), np.concatenate(right)


def bands_of(bits: int, least: float) -> int:
    """Bands of so many bits after which a pair with cosine `least` has met with a chance of 1 - MISS. Two vectors differ
    in the sign of a random projection with a chance of their angle over pi."""
    agree = (1 - math.acos(least) / math.pi) ** bits
    return 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))


def banding(rows: Column, block: int, least: float) -> Column:
    """struct(copies, bits, bands) for a group of so many vectors: of all choices of bits the one with the fewest copies
    of a vector, each of its buckets being cut into chunks of `block`."""
    choices = [F.struct((F.ceil(rows / (block * 2.0**bits)) * bands_of(bits, least)).alias("copies"), F.lit(bits).alias("bits"), F.lit(bands_of(bits, least)).alias("bands")) for bits in range(MOST_BITS + 1)]
    return F.array_min(F.array(*choices))


@lru_cache(maxsize=8)
def _planes(d: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, d, 1]).standard_normal((count, d))


def band_keys(u: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Buckets of unit vectors: a row a vector, a column a band."""
    if not bits:
        return np.zeros((len(u), 1), "<u4")
    above = (u @ _planes(u.shape[1], bits * bands).T > 0).reshape(len(u), bands, bits)
    return (above @ (1 << np.arange(bits))).astype("<u4")


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, unit vectors, bucket keys) of the rows of a batch that have a length and a banding in common."""
    vectors = batch.column("embedding")
    start = vectors.offsets.to_numpy()
    values = np.asarray(vectors.values)
    kinds = np.stack([np.diff(start), batch.column("bits").to_numpy(), batch.column("bands").to_numpy()], 1)
    for d, bits, bands in np.unique(kinds, axis=0).tolist():
        at = np.flatnonzero((kinds == (d, bits, bands)).all(1))
        u = unit(values[start[at][:, None] + np.arange(d)])
        yield at, u, band_keys(u, bits, bands)


def _bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group = batch.column("g").to_numpy()
        for at, _, keys in _alike(batch):
            bands = keys.shape[1]
            flat = np.stack([np.repeat(group[at], bands), np.tile(np.arange(bands), len(at)), keys.ravel().astype("i8")], 1)
            kinds, n = np.unique(flat, axis=0, return_counts=True)
            yield pa.record_batch([*(pa.array(kinds[:, k]) for k in range(3)), pa.array(n.astype("i8"))], ["g", "band", "key", "c"])


def _dealt(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            start, values = vectors.offsets.to_numpy(), np.asarray(vectors.values)
            for at, _, keys in _alike(batch):
                bands = keys.shape[1]
                rows = batch.take(pa.array(at))
                raw = pa.array([values[start[k] : start[k + 1]].astype(width).tobytes() for k in at], pa.binary())
                every = pa.array([k.tobytes() for k in keys], pa.binary())
                for band in range(bands):
                    yield pa.record_batch([rows.column("g"), pa.array(np.full(len(at), band)), pa.array(keys[:, band].astype("i8")), rows.column("rep"), rows.column("h"), rows.column("n"), raw, every], ["g", "band", "key", "rep", "h", "n", "v", "keys"])

    return run


def _chunk_pair(least: float, width: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "rep", "h"], kind="stable").reset_index(drop=True)
        rep, h, n = frame["rep"].to_numpy(), frame["h"].to_numpy(), frame["n"].to_numpy()
        keys = np.frombuffer(b"".join(frame["keys"]), "<u4").reshape(len(frame), -1)[:, : int(frame["band"].iloc[0])]
        split = int((frame["side"] == 0).sum())
        within = frame["i"].iloc[0] == frame["j"].iloc[0]
        i = j = np.zeros(0, int)
        # where all share an earlier band, all their pairs count there
        if (within or 0 < split < len(frame)) and not (keys == keys[:1]).all(0).any():
            u = unit(np.frombuffer(b"".join(frame["v"]), width).reshape(len(frame), -1))
            i, j = linked_pairs(u, None, least) if within else linked_pairs(u[:split], u[split:], least)
            j = j if within else j + split
            fresh = ~(keys[i] == keys[j]).any(1)
            i, j = i[fresh], j[fresh]
        links = np.bincount(i, n[j], len(frame)) + np.bincount(j, n[i], len(frame))
        forest = UnionFind(len(frame))
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            forest.union(x, y)
        roots = forest.roots()
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[hit], "h": h[hit], "links": links[hit].astype("i8"), "root_rep": rep[roots[hit]], "root_h": h[roots[hit]]})

    return run


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    ship(rows.sparkSession)
    width = "<f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("label").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    given = given.withColumn("usable", F.coalesce(sound & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    # -0.0 and 0.0 are one value
    usable = given.filter("usable").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("label", "v"))
    distinct = usable.groupBy("label", "h", "v").agg(F.count("*").alias("n"), F.min("key").alias("rep"))
    distinct = materialize(distinct.withColumn("d", F.size("v")).withColumnRenamed("v", "embedding"), "emb-distinct")
    # one row a label and length
    groups = distinct.groupBy("label", "d").agg(F.count("*").alias("rows")).withColumn("p", banding(F.col("rows"), block, least))
    groups = materialize(groups.select("label", "d", "p.bits", "p.bands", F.monotonically_increasing_id().alias("g")), "emb-groups")
    placed = distinct.join(groups, ["label", "d"]).select("g", "bits", "bands", "rep", "h", "n", "embedding")
    sizes = placed.select("g", "bits", "bands", "embedding").mapInArrow(released(_bucket_sizes), "g long, band long, key long, c long")
    large = materialize(sizes.groupBy("g", "band", "key").agg(F.sum("c").alias("c")).filter(F.col("c") > block).select("g", "band", "key", F.ceil(F.col("c") / block).cast("int").alias("of")), "emb-large")
    dealt = placed.mapInArrow(released(_dealt(width)), "g long, band long, key long, rep long, h long, n long, v binary, keys binary")
    dealt = dealt.join(large, ["g", "band", "key"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "rep", "h"), "of").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j"), (F.col("chunk") > k).cast("int").alias("side")))
    met = dealt.withColumn("m", F.explode(pairs)).select("g", "band", "key", "m.*", "rep", "h", "n", "v", "keys")
    found = met.groupBy("g", "band", "key", "i", "j").applyInPandas(_chunk_pair(least, width), "rep long, h long, links long, root_rep long, root_h long")
    found = materialize(found, "emb-found")
    node = lambda r, h: F.struct(F.col(r).alias("rep"), F.col(h).alias("h"))
    component = components(found.select(node("rep", "h").alias("a"), node("root_rep", "root_h").alias("b")))
    component = component.select(F.col("node.rep").alias("rep"), F.col("node.h").alias("h"), F.col("component.rep").alias("component"))
    degree = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    facts = distinct.select("rep", "h", "n").join(degree, ["rep", "h"], "left").join(component, ["rep", "h"], "left")
    facts = materialize(facts.select(F.col("h").alias("node_h"), "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "emb-nodes")
    discard(distinct, groups, large, found)
    # rows of one vector share its facts; the others link with nothing
    out = usable.select("key", "h").join(facts, F.col("h") == F.col("node_h")).select("key", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), F.col("component").cast("long").alias("component_id"))
    out = out.union(given.filter("not usable").select("key", F.lit(0).cast("long"), F.col("key").cast("long")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same links in DuckDB, every pair of a label computed.
ORACLE_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""
