"""Numbering rows without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dense_ids(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``name`` = 0-based ordinal of each row in ``order``, without gaps.

    A range sort spreads the rows; each partition numbers its own, and the counts
    of the partitions, one row each, give the offsets. The sorted rows are
    checkpointed, so that a lost executor cannot renumber them. Rows that tie in
    ``order`` are numbered as they lie.
    """
    flat = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = flat.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # One row for each partition of the sort: bounded by spark.sql.shuffle.partitions.
    return (
        flat.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_before")
    )


def rank_within(df: DataFrame, group: list[str], key: str, name: str = "rank", buckets: int = 64) -> DataFrame:
    """``name`` = a 0-based number of each row within its group, each used once.

    A group that holds a third of all rows is no hot task: rows are numbered within
    (group, hash bucket of ``key``), and the sizes of the buckets give the offsets.
    Numbers follow the hash of ``key``, then ``key``; they do not depend on the
    layout of the input. Rows with equal ``key`` in one group get different
    numbers in no stated order.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_before")
    )
    inner = b.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)))
    return (
        inner.join(offsets, [*group, "_b"])
        .withColumn(name, F.col("_before") + F.col("_r") - 1)
        .drop("_b", "_r", "_before")
    )
