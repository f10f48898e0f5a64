"""Greedy packing of a file's paragraphs into chunks.

A chunk is closed when it holds something and the next paragraph would take it
over the target. Where a chunk starts thus depends on everything before it in the
file, which would make one huge file one task. But all that a stretch of the file
passes on is the number of words in the open chunk, a whole number from 0 to the
target (anything above behaves like the target, as a further paragraph never
fits). So a file is cut into blocks by position; every block works out where each
possible inflow leads, the blocks of a file are chained over these small tables,
and each block then packs from its true inflow. Files of one block, nearly all,
skip the first two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .ids import dense_ids


def _flows(words: np.ndarray, target: int) -> np.ndarray:
    """Outflow of a block for every inflow 0..target."""
    state = np.arange(target + 1, dtype=np.int64)
    for w in words:
        full = (state > 0) & (state + w > target)
        state = np.minimum(np.where(full, w, state + w), target)
    return state


def assign_chunks(paragraphs: DataFrame, target_words: int = 180, block: int = 20_000) -> DataFrame:
    """Adds ``chunk``: the 0-based ordinal of the row's chunk within its source.

    ``paragraphs`` has ``source, position, words``; rows of one source are taken in
    order of ``position`` (ties: by ``id`` if there is one). A null ``source`` is a
    source of its own; a null ``position`` comes first; null ``words`` count 0. A
    paragraph above the target makes a chunk by itself, unless empty ones precede.

    The rows are stored once, with a number each; only these numbers and the words
    travel through Python, and texts are joined again by the number.
    """
    if target_words < 1:
        raise ValueError("target_words must be at least 1")
    tie = ["id"] if "id" in paragraphs.columns else []
    in_block = F.floor(F.coalesce("position", F.lit(-1)) / F.lit(block)).cast("long")
    rows = stored(paragraphs.withColumn("_block", in_block).withColumn("_row", F.monotonically_increasing_id()), "to-pack")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))

    fed = rows.select("source", "_block", "position", *tie, F.coalesce("words", F.lit(0)).cast("long").alias("words"), "_row")
    blocks = rows.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"))
    long_files = stored(blocks.groupBy("source").agg(F.count(F.lit(1)).alias("_blocks")).where(F.col("_blocks") > 1).select(F.col("source").alias("_s")), "long-files")
    several = bool(long_files.head(1))
    if several:
        inflows = _inflows(fed.join(long_files, F.col("source").eqNullSafe(F.col("_s")), "left_semi"), tie, target_words)
        fed = fed.join(inflows, same, "left").drop("_s", "_b").withColumn("_inflow", F.coalesce("_inflow", F.lit(0).cast("long")))
    else:
        fed = fed.withColumn("_inflow", F.lit(0).cast("long"))
    fed = fed.repartition("source", "_block").sortWithinPartitions("source", "_block", "position", *tie)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, starts = None, 0, 0
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            cols = [b.column(c).to_pylist() for c in ("source", "_block", "words", "_inflow")]
            for i, (source, block_no, w, inflow) in enumerate(zip(*cols)):
                if (source, block_no) != key:
                    key, state, starts = (source, block_no), inflow, 0
                if state > 0 and state + w > target_words:
                    state, starts = w, starts + 1
                else:
                    state += w
                out[i] = starts
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out)] + [b.column(c) for c in ("source", "_block")] * several, names=["_row", "_starts"] + ["_s", "_b"] * several)

    packed = fed.select("source", "_block", "words", "_inflow", "_row").mapInArrow(pack, "_row long, _starts long" + ", _s string, _b long" * several)
    if not several:
        return rows.join(packed.withColumnRenamed("_starts", "chunk"), "_row").drop("_row", "_block")
    packed = stored(packed, "packed")
    ends = packed.groupBy("_s", "_b").agg(F.max("_starts").alias("_last"))
    before = (F.sum("_last").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_last")).alias("_before")
    before = ends.select("_s", "_b", before).where(F.col("_before") > 0)
    # Only long files have blocks with anything before them; the rest join nothing.
    both = rows.join(packed.select("_row", "_starts"), "_row").join(before, same, "left")
    return both.withColumn("chunk", F.coalesce("_before", F.lit(0)) + F.col("_starts")).drop("_s", "_b", "_block", "_row", "_starts", "_before")


def _inflows(need: DataFrame, tie: list[str], target_words: int) -> DataFrame:
    """``_s, _b, _inflow``: the words that each block of a long file starts with."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            flow = pa.array([_flows(np.array(held, np.int64), target_words).tolist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), flow], names=["source", "_block", "flow"])

        for b in batches:
            for k, w in zip(zip(b.column("source").to_pylist(), b.column("_block").to_pylist()), b.column("words").to_pylist()):
                if k != key:
                    if key is not None:
                        yield flush()
                    key, held = k, []
                held.append(w)
        if key is not None:
            yield flush()

    flows = (
        need.repartition("source", "_block")
        .sortWithinPartitions("source", "_block", "position", *tie)
        .select("source", "_block", "words")
        .mapInArrow(tables, "source string, _block long, flow array<long>")
    )
    # Chained in the JVM over one small table for each block of a long file.
    chain = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_block", "flow"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<b:long,inflow:long>>").alias("log")),
        lambda s, x: F.struct(
            F.element_at(x["flow"], (s["at"] + 1).cast("int")).alias("at"),
            F.concat(s["log"], F.array(F.struct(x["_block"].alias("b"), s["at"].alias("inflow")))).alias("log"),
        ),
    )
    return (
        flows.groupBy("source")
        .agg(chain.alias("c"))
        .select(F.col("source").alias("_s"), F.explode("c.log").alias("e"))
        .select("_s", F.col("e.b").alias("_b"), F.col("e.inflow").alias("_inflow"))
    )


def chunk_rows(paragraphs: DataFrame, target_words: int = 180, min_words: int = 20, block: int = 20_000) -> DataFrame:
    """``source, chunk, paragraph_ids, text, fp, words``, chunks under ``min_words`` dropped.

    A group holds at most ``target_words`` paragraphs with words, so collecting it
    is bounded.
    """
    rows = assign_chunks(paragraphs, target_words, block)
    items = F.array_sort(F.collect_list(F.struct("position", "id", "text")))
    grouped = rows.groupBy("source", "chunk").agg(items.alias("items"))
    text = F.array_join(F.col("items.text"), "\n\n")
    return (
        grouped.select("source", "chunk", F.col("items.id").alias("paragraph_ids"), text.alias("text"))
        .withColumn("fp", T.fingerprint(F.col("text")))
        .withColumn("words", T.word_count(F.col("text")))
        .where(F.col("words") >= min_words)
    )


def pack_chunks(paragraphs: DataFrame, target_words: int = 180, min_words: int = 20) -> DataFrame:
    """``id, source, paragraph_ids, text, fp, words``; ids are dense over the kept chunks."""
    rows = chunk_rows(paragraphs, target_words, min_words)
    return dense_ids(rows, [F.split("source", "/"), F.col("chunk")]).select(
        "id", "source", "paragraph_ids", "text", "fp", "words"
    )
