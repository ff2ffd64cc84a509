"""Orders without ties, and numbers along an order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.session import materialize


def in_order(rows: DataFrame, ts: str, tie: str = "seq") -> list[str]:
    """The columns to order by: the time, and the arrival where rows have it, since times may be equal."""
    return [ts, tie] if tie in rows.columns and tie != ts else [ts]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds name: 0, 1, .. along the order. Rows are range-partitioned and sorted inside their partition; only the counts
    of the partitions are added up in one place."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id are the row's place in its partition, the others name the partition
    placed = materialize(parted.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(counts.select("_part", before.alias("_before")), "numbered-bases")
    return placed.withColumn("_part", part).join(bases, "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before", "_id")
