"""Joins of many rows with one fact a key, where one key may be held by a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostride.session import materialize

#: Hot keys at most, which bounds the one table that is broadcast, and the rows that a key has to be held by at least.
HOT_KEYS, LEAST_HOT = 100_000, 100_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with facts: (key, held, ..), written, one row a key, held saying how many of rows have it.

    A key held by more rows than a share is dealt over as many tasks as it has shares, by a hash of `spread`, and its facts
    go to each of them. A share is at least one part in HOT_KEYS of all held rows, so there are at most HOT_KEYS such keys:
    the table of them is the only thing broadcast. Without any the join is a plain one."""
    total = facts.agg(F.sum("held").alias("n")).first()["n"] or 0
    share = max(LEAST_HOT, -(-total // HOT_KEYS))
    parts = F.ceil(F.col("held") / share).cast("int")
    hot = materialize(facts.filter(F.col("held") > share).select(key, parts.alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(facts.drop("held"), key)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(F.lit("part"), spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copied = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("held")
    return dealt.join(copied, [key, "_part"]).drop("_part")
