"""Text that arrives as a stream, held against what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def known_fingerprints(snapshot: DataFrame) -> DataFrame:
    """Distinct fingerprints of a stored snapshot."""
    return snapshot.where(F.col("fp").isNotNull()).select("fp").distinct()


def save_snapshot(paragraphs: DataFrame, path: str) -> None:
    paragraphs.write.mode("overwrite").parquet(path)


def new_texts(stream: DataFrame, known: DataFrame, at: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of ``stream`` (batch or streaming) whose normalised text is not known, one of each.

    With an event time ``at`` the state of a stream is bounded: a repeat counts as
    one if it comes within ``late``. Null texts never count as new.
    """
    rows = stream.where(F.col("text").isNotNull()).withColumn("fp", T.fingerprint(F.col("text")))
    fresh = rows.join(known, "fp", "left_anti")
    if at is None:
        return fresh.dropDuplicates(["fp"])
    return fresh.withWatermark(at, late).dropDuplicatesWithinWatermark(["fp"])
