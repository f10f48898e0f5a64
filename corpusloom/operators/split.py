"""Documents to paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ids import dense_ids


def split_paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``source, position, text``: one row for each block of ``text`` that is not blank.

    ``position`` counts every block, blank ones too, so it may have gaps. A null
    or blank text gives no rows.
    """
    blocks = docs.select("source", F.posexplode(F.split("text", _literal(separator))).alias("position", "raw"))
    return blocks.select("source", "position", T.strip(F.col("raw")).alias("text")).where(F.col("text") != "")


def _literal(separator: str) -> str:
    """A pattern for exactly this separator."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in separator)


def read_paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``id, source, position, text, fp, words``; ids are dense in file order.

    Files sort by the parts of their path, so ``a/b.md`` comes before ``a-b.md``.
    """
    rows = split_paragraphs(docs, separator)
    rows = rows.withColumn("fp", T.fingerprint(F.col("text"))).withColumn("words", T.word_count(F.col("text")))
    return dense_ids(rows, [F.split("source", "/"), F.col("position")]).select(
        "id", "source", "position", "text", "fp", "words"
    )
