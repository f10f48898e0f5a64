"""Containers of fixed capacity filled by planning over lengths.

How many items have each length fits on one page whatever the number of items: there
are at most ``capacity`` lengths. Best fit is run over those counts, longest first,
whole runs of equal containers at a time. The plan says which ranks of a length go to
which containers; items take their places by joining on their rank within the length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import rank_within
from ..session import stored

#: Ranks of a stretch, and planned runs that are broadcast at most.
STRETCH, MOST_RUNS = 4096, 200_000
PLAN = "capacity_id int, length bigint, rank_from bigint, rank_to bigint, first_container bigint, per bigint"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``length, rank_from, rank_to, first_container, per`` by best fit decreasing over counts.

    Items of ``length`` with ranks from ``rank_from`` up to ``rank_to`` (exclusive) fill
    containers from ``first_container`` on, ``per`` to each.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first container, how many)
    rooms: list[int] = []
    out, containers = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, have = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = capacity, containers
                have = -(-left // (capacity // length))
                containers += have
            per = room // length
            full = min(have, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per))
                put(room - per * length, first, full)
                rank, left, first, have = rank + full * per, left - full * per, first + full, have - full
            if left and have and left < per:
                out.append((length, rank, rank + left, first, left))
                put(room - left * length, first, 1)
                rank, left, first, have = rank + left, 0, first + 1, have - 1
            put(room, first, have)
    return out


def pieces(sizes: DataFrame, capacities: DataFrame, key: str) -> DataFrame:
    """``capacity_id, key, piece, start_token, length``: items as they go into containers.

    An item within the capacity is one piece. A larger one gives as many full pieces as
    it holds and one with the rest. Null and zero sizes take no place.
    """
    cap = capacities.select("capacity_id", F.col("max_tokens").cast("bigint").alias("cap")).where(F.col("cap") > 0)
    some = sizes.where(F.col("tokens") > 0).join(F.broadcast(cap))  # a fixed short list of capacities
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.col("cap"))
    return some.select("capacity_id", key, "tokens", "cap", F.posexplode(starts).alias("piece", "start_token")).select(
        "capacity_id", key, "piece", "start_token", F.least("cap", F.col("tokens") - F.col("start_token")).alias("length")
    )


def fill(spark: SparkSession, sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """``capacity_id, container_id, key, piece, start_token, tokens``: every item in a container of each capacity.

    The counts by length, at most the sum of the capacities in rows, come to the driver
    for planning. An empty table gives no rows. Repeated keys are separate items.
    """
    items = stored(pieces(sizes, capacities, key), "pieces")
    counts: dict[int, dict[int, int]] = {}
    for r in items.groupBy("capacity_id", "length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["capacity_id"], {})[r["length"]] = r["n"]
    room = {r["capacity_id"]: r["max_tokens"] for r in capacities.select("capacity_id", "max_tokens").collect()}
    rows = [(c, *p) for c, by in counts.items() for p in plan(by, room[c])]
    # Ranks are cut into stretches, and a planned run stands in each it reaches: an item meets the runs of its own stretch alone.
    slots = spark.createDataFrame(rows, PLAN)
    stretch = F.sequence(F.floor(F.col("rank_from") / STRETCH), F.floor((F.col("rank_to") - 1) / STRETCH))
    slots = slots.withColumn("stretch", F.explode(stretch))
    placed = rank_within(items.withColumn("_k", F.struct(key, "piece")), ["capacity_id", "length"], "_k").drop("_k")
    placed = placed.withColumn("stretch", F.floor(F.col("rank") / STRETCH))
    # As many as runs and stretches: of the plan, not of the items, unless these are very many.
    if len(rows) + sum(n for by in counts.values() for n in by.values()) // STRETCH <= MOST_RUNS:
        slots = F.broadcast(slots)
    here = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return (
        placed.join(slots, ["capacity_id", "length", "stretch"])
        .where(here)
        .withColumn("container_id", F.col("first_container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per")).cast("bigint"))
        .select("capacity_id", "container_id", key, "piece", "start_token", F.col("length").alias("tokens"))
    )


def fill_summary(filled: DataFrame, capacities: DataFrame) -> DataFrame:
    """``capacity_id, items, containers, tokens, least_containers, filled`` for each capacity in use."""
    cap = capacities.select("capacity_id", "max_tokens")
    by = filled.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    out = by.groupBy("capacity_id").agg(
        F.sum("i").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")
    )
    return out.join(F.broadcast(cap), "capacity_id").select(
        "capacity_id", "items", "containers", "tokens", "fullest",
        F.ceil(F.col("tokens") / F.col("max_tokens")).alias("least_containers"),
        (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("filled"),
    )
