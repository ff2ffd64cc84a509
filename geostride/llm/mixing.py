"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Sizes are summed per source with map-side partial aggregation, so a source with a third of all rows costs no more
than any other. The water level is found on the table of sources (one row per source, already aggregated). Whole
repetitions are repeated rows; the fractional repetition is a seeded sample: the documents of a source in the order
of a seeded hash, as far as the fraction of the source's size reaches. The hash order is cut in two steps, slices of
the hash first and then the one slice in which the cut lies, so no task ever orders a whole source.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; null keys hash as the empty
string with a marker; rows that repeat a key share its hash and are taken or left together; empty tables give empty
results; `mix` ignores extra columns, `mixed_documents` passes columns of any name through as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits that name a slice of the hash: 4096 slices.
SLICE = 3


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_hash(key: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null:")))) 


def water_fill(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target: the sources, by code point and null last, weigh
    `weights` in turn and share `share` times all sizes; each stops at max_epochs times its size and what it can't
    take goes to the others by weight, until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    at = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.select("source", "source_size", at.alias("_at")).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_at") + 1).cast("double"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    weighed = weighed.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rising = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    weighed = weighed.withColumn("_level", level).withColumn("_rank", F.row_number().over(rising))
    first_free = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_rank", "_level"))).over(everything)["_level"]
    return weighed.withColumn("_free", first_free).select("source", "source_size", F.when(F.col("_free").isNull() | (F.col("_ratio") <= F.col("_free")), F.col("_cap")).otherwise(F.col("_w") * F.col("_free")).alias("target"))


def mixing_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(sized, plan). sized: key, source, size, hash of each row, written once so that the texts are read once.
    plan: one row per source with source_size, target, whole (repetitions of every row) and cut (rows whose hash is at
    most this get one more)."""
    sized = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), sample_hash(F.col(key), seed).alias("hash")), "mix-sized")
    slices = sized.groupBy("source", F.substring("hash", 1, SLICE).alias("slice")).agg(F.sum("size").alias("slice_size"))
    slices = materialize(slices, "mix-slices")
    targets = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = materialize(targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    upto = Window.partitionBy("source").orderBy("slice")
    before = F.coalesce(F.sum("slice_size").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    # the cut lies in the first slice whose end is past the need; earlier slices are taken whole
    ranged = slices.select("source", "slice", "slice_size", before).alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    cut_slice = ranged.filter("before + slice_size >= need").groupBy("r.source").agg(F.min(F.struct("slice", "before", "need")).alias("c")).select("source", "c.*")
    cut_slice = materialize(cut_slice, "mix-cut")
    inside = sized.withColumn("slice", F.substring("hash", 1, SLICE)).alias("d").join(cut_slice.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.slice") == F.col("c.slice")))
    inside = inside.groupBy(F.col("d.source").alias("source"), "hash").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("need").alias("need"))
    sums = F.sum("size").over(Window.partitionBy("source").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("before") + sums - F.col("size") / 2
    last = inside.withColumn("taken", middle <= F.col("need")).filter("taken").groupBy("source").agg(F.max("hash").alias("last"))
    # without a row of the cut slice: everything below that slice
    plan = targets.alias("t").join(cut_slice.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    plan = plan.select("t.source", "source_size", "target", "whole", F.coalesce("l.last", "c.slice", F.lit("g")).alias("cut"))
    return sized, materialize(plan, "mix-plan")


def _with_reps(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows: _source, _hash and others. Adds source_size and target of the source, and reps."""
    # the plan was written: its size is known, and Spark broadcasts it only below the session's threshold
    p = plan.select(F.col("source").alias("_p_source"), "source_size", "target", "whole", "cut")
    joined = rows.join(p, F.col("_source").eqNullSafe(F.col("_p_source")))
    return joined.withColumn("reps", F.col("whole") + (F.col("_hash") <= F.col("cut")).cast("int"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (words taken, repeats counted), reps."""
    sized, plan = mixing_plan(docs, key, text, source, **options)
    rows = _with_reps(sized.withColumnsRenamed({"source": "_source", "hash": "_hash"}), plan)
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"), "reps")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: the documents' own columns, each row as often as it is repeated (not at all: dropped)."""
    _, plan = mixing_plan(docs, key, text, source, **options)
    # a row's own columns travel in a struct, so that their names meet none of this operator's
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(own, F.col(source).alias("_source"), sample_hash(F.col(key), options.get("seed", SEED)).alias("_hash"))
    rows = _with_reps(keyed, plan).filter("reps > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("reps")))).select("_row.*")


#: The same result in DuckDB.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:')) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM sizes),
levels AS (
  SELECT *, row_number() OVER o AS rk,
         (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)),
free AS (SELECT arg_min(lvl, rk) AS f FROM levels WHERE cap / w > lvl),
targets AS (SELECT source, source_size, CASE WHEN f IS NULL OR cap / w <= f THEN cap ELSE w * f END AS target FROM levels, free),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
grouped AS (SELECT source, hash, sum(size) AS size FROM sized GROUP BY source, hash),
mids AS (SELECT source, hash, sum(size) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid FROM grouped)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (t.whole + CASE WHEN m.mid <= t.target - t.whole * t.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN wholes t ON d.source IS NOT DISTINCT FROM t.source
JOIN mids m ON m.source IS NOT DISTINCT FROM d.source AND m.hash = d.hash
"""
