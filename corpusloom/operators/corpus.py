"""A corpus: lazily built tables behind one handle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.config import Config
from ..sources.files import read_folder
from .models import HashEmbedder, cached_vectors
from .packing import pack_chunks
from .split import read_paragraphs


class Corpus:
    """Tables of one set of documents. Vectors are made only when a detector asks for them.

    ``cache`` is the folder of the embedding cache: what it lacks is embedded once and
    added to it, so a second run over unchanged text asks the embedder for nothing.
    """

    def __init__(self, docs: DataFrame, config: Config | None = None, embedder=None, cache: str | None = None, separator: str = "\n\n"):
        self.docs, self.config, self.separator = docs, config or Config(), separator
        self.embedder, self.cache = embedder or HashEmbedder(), cache

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, config: Config | None = None, **kw) -> Corpus:
        return cls(read_folder(spark, root), config, **kw)

    @classmethod
    def of_tables(cls, paragraphs: DataFrame, chunks: DataFrame, config: Config | None = None, **kw) -> Corpus:
        """From tables that exist already: ``paragraphs`` and ``chunks`` as this class has them."""
        self = cls(paragraphs.select("source", "text"), config, **kw)
        self.__dict__ |= {"paragraphs": paragraphs, "chunks": chunks}
        return self

    @cached_property
    def paragraphs(self) -> DataFrame:
        return read_paragraphs(self.docs, self.separator)

    @cached_property
    def groups(self) -> DataFrame:
        """Distinct texts with their counts, which several detectors read: counted once."""
        from .signals import by_fingerprint

        return stored(by_fingerprint(self.paragraphs), "groups")

    @cached_property
    def chunks(self) -> DataFrame:
        return pack_chunks(self.paragraphs, self.config.target_words, self.config.min_words)

    @cached_property
    def paragraph_vectors(self) -> DataFrame:
        """``fp, vec`` of paragraphs of ten words or more."""
        return self._vectors(self.paragraphs.where(F.col("words") >= 10))

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        return self._vectors(self.chunks)

    def _vectors(self, items: DataFrame) -> DataFrame:
        return cached_vectors(items, self.embedder, self.cache)

    def totals(self) -> DataFrame:
        """``files, paragraphs, words, chunks`` in one row."""
        return corpus_totals(self.paragraphs).join(F.broadcast(self.chunks.agg(F.count(F.lit(1)).alias("chunks"))))


def corpus_totals(paragraphs: DataFrame) -> DataFrame:
    """``files, paragraphs, words`` in one row; zeros for an empty table."""
    return paragraphs.agg(
        F.countDistinct("source").alias("files"),
        F.count(F.lit(1)).alias("paragraphs"),
        F.coalesce(F.sum("words"), F.lit(0)).cast("bigint").alias("words"),
    )


def source_totals(paragraphs: DataFrame) -> DataFrame:
    """``source, paragraphs, words``."""
    return paragraphs.groupBy("source").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum("words").cast("bigint").alias("words")
    )
