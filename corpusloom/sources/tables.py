"""The Parquet tables of a data folder, with the defects of delivery resolved."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` below ``folder``: one file or a folder of part files."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def deliveries(paragraphs: DataFrame) -> DataFrame:
    """One row per paragraph ``id``: its latest delivery.

    A null ``ingested_at`` is older than any other; of deliveries at the same time
    the greatest (source, position, text) stands, so the choice does not depend on
    row order. Rows with a null id are dropped, since nothing can refer to them.
    The aggregation is partial on the map side, so an id delivered very often is
    no hot key.
    """
    rest = [c for c in ("source", "position", "text", "batch") if c in paragraphs.columns]
    row = F.max(F.struct("ingested_at", *rest)).alias("row")
    return (
        paragraphs.where(F.col("id").isNotNull()).groupBy("id").agg(row).select("id", *[f"row.{c}" for c in rest])
    )


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """``id, source, position, text, batch, fp, words`` with fp and words worked out anew.

    The stored ``fp`` and ``words`` may be out of date; rows without text hold
    nothing to measure and are left out.
    """
    return measured(deliveries(table(spark, folder, "paragraphs")).where(F.col("text").isNotNull()))


def measured(rows: DataFrame) -> DataFrame:
    """Adds ``fp`` and ``words`` of ``text``."""
    return rows.withColumn("fp", T.fingerprint(F.col("text"))).withColumn("words", T.word_count(F.col("text")))


def documents_as_files(spark: SparkSession, folder: str, width: int = 12) -> DataFrame:
    """``source, text``: every document as a file of its own, named by its padded id."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return docs.select(F.lpad(F.col("doc_id").cast("string"), width, "0").alias("source"), "text")
