"""Small readable samples for a model's prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(chunks: DataFrame, most: int = 12, words: int = 900) -> DataFrame:
    """First chunk of every file in file order, then every second one, and so on.

    Stops at ``most`` chunks or once ``words`` are reached; the chunk that crosses
    the limit stays. Adds ``turn`` (1 for first chunks) and ``ord`` (1, 2, ...).

    Only the first ``most`` chunks of a file can be taken, and of the rows so left
    only the first ``most`` in order: both are top-n before the running sums, so the
    single-partition window sees at most ``most`` rows.
    """
    file = F.split("source", "/")
    turns = chunks.withColumn(
        "turn", F.row_number().over(Window.partitionBy("source").orderBy("id"))
    ).where(F.col("turn") <= most)
    first = turns.orderBy("turn", file, "source").limit(most)
    w = Window.orderBy("turn", file, "source")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        first.withColumn("ord", F.row_number().over(w))
        .withColumn("_words", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where(F.col("_words") < words)
        .drop("_words")
    )


def label_sample(members: DataFrame, group: str, score: str, most: int = 6, words: int = 600, tie: str = "id") -> DataFrame:
    """Of each group the ``most`` rows with the highest ``score`` while they fit ``words``.

    The first is kept whatever its length; the list ends at the first row that does
    not fit. Adds ``rn``. Ties by ``tie``.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    top = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    run = F.sum("words").over(Window.partitionBy(group).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("running_words", run.cast("bigint")).where(
        (F.col("rn") == 1) | (F.col("running_words") <= words)
    )
