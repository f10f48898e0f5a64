"""Model providers, the embedding cache, and reading what a model answers."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import stored


#: Context of the chat model, the margin kept free, texts per embedding call.
CONTEXT_TOKENS = 8192
CONTEXT_MARGIN = 64
BATCH = 32


class ContextOverflow(ValueError):
    """The prompt would not fit the model's context."""


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def ready(self) -> bool: ...


class ChatModel(Protocol):
    def answer(self, prompt: str, system: str = "", temperature: float = 0.0, max_tokens: int = 200) -> str: ...

    def ready(self) -> bool: ...


class HashEmbedder:
    """Signed feature hashing of words and word pairs: no model, no network, same text same vector.

    It measures shared wording, not meaning; it stands in where no embedding
    service can be reached, and scores from it are not those of a trained model.
    """

    def __init__(self, dim: int = 256):
        self.dim, self.name = dim, f"hash-{dim}"

    def ready(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            w = t.lower().split()
            for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class ServiceError(RuntimeError):
    """The model service cannot be reached or gives no usable answer."""


class HttpModels:
    """Embeddings and chat from a model service with a JSON interface, such as a local one.

    ``embed`` posts ``{model, input}`` to ``/api/embed``, ``answer`` posts messages to
    ``/api/chat``; ``ready`` says whether both models are listed by ``/api/tags``.
    """

    def __init__(self, url: str = "http://localhost:11434", embed_model: str = "", chat_model: str = "", timeout: float = 300.0):
        self.url, self.name, self.chat_model, self.timeout = url.rstrip("/"), embed_model, chat_model, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(
            self.url + path, data=None if body is None else json.dumps(body).encode(), headers={"Content-Type": "application/json"}
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except (OSError, ValueError) as why:
            raise ServiceError(f"{self.url}{path}: {why}") from None

    def ready(self) -> bool:
        try:
            there = {m.get("name", "") for m in self._call("/api/tags").get("models", [])}
        except ServiceError:
            return False
        want = [m for m in (self.name, self.chat_model) if m]
        return all(any(t == m or t.split(":")[0] == m for t in there) for m in want)

    def embed(self, texts: list[str]) -> np.ndarray:
        got = self._call("/api/embed", {"model": self.name, "input": texts}).get("embeddings", [])
        if len(got) != len(texts):
            raise ServiceError(f"{len(texts)} texts sent, {len(got)} vectors received")
        return np.asarray(got, np.float32)

    def answer(self, prompt: str, system: str = "", temperature: float = 0.0, max_tokens: int = 200) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        options = {"temperature": temperature, "num_predict": max_tokens, "num_ctx": CONTEXT_TOKENS}
        return self._call("/api/chat", {"model": self.chat_model, "messages": messages, "stream": False, "options": options}).get("message", {}).get("content", "")


def cache_misses(items: DataFrame, cache: DataFrame | None) -> DataFrame:
    """``fp, text`` of each distinct item that the cache lacks; of equal items the first by id."""
    want = items.where(F.col("fp").isNotNull())
    if cache is not None:
        want = want.join(cache.select("fp").distinct(), "fp", "left_anti")
    return want.groupBy("fp").agg(F.min(F.struct("id", "text")).alias("x")).select("fp", "x.text")


def embed_missing(items: DataFrame, cache: DataFrame | None, embedder: Embedder) -> DataFrame:
    """``fp, vec`` for every distinct ``fp`` of ``items``: cached, or embedded in batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                part = pdf.iloc[i : i + BATCH]
                yield pd.DataFrame({"fp": part["fp"], "vec": list(embedder.embed(part["text"].tolist()))})

    fresh = cache_misses(items, cache).mapInPandas(work, "fp string, vec array<float>")
    if cache is None:
        return fresh
    known = cache.join(items.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.max("vec").alias("vec"))
    return known.unionByName(fresh)


def cached_vectors(items: DataFrame, embedder: Embedder, path: str | None = None) -> DataFrame:
    """``fp, vec`` for every distinct ``fp`` of ``items``, made once and stored.

    What the cache at ``path`` holds of the embedder's model is taken from there; the
    rest is embedded and added to it. Without a path the vectors last as long as the session.
    """
    spark = items.sparkSession
    if path is None:
        return stored(embed_missing(items, None, embedder), "vectors")
    known = read_cache(spark, path, embedder.name)
    missing = stored(cache_misses(items, known), "misses")
    if missing.head(1):
        write_cache(embed_missing(missing.withColumn("id", F.lit(0)), None, embedder), path, embedder.name)
    wanted = items.select("fp").distinct()
    return stored(read_cache(spark, path, embedder.name).join(wanted, "fp", "left_semi").groupBy("fp").agg(F.max("vec").alias("vec")), "vectors")


def write_cache(vectors: DataFrame, path: str, model: str) -> None:
    """Appends new vectors; a reader takes those of its own model only."""
    vectors.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)


def read_cache(spark, path: str, model: str) -> DataFrame:
    """``fp, vec`` of ``model``; other models' partitions are not opened. No rows where there is no cache yet."""
    try:
        cache = spark.read.schema("fp string, vec array<float>, model string").parquet(path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return spark.createDataFrame([], "fp string, vec array<float>")
    return cache.where(F.col("model") == model).select("fp", "vec")


def estimate_tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def guarded_answer(chat: ChatModel, prompt: str, system: str = "", max_tokens: int = 200) -> str:
    """An answer, or ``ContextOverflow`` before anything is sent."""
    need = estimate_tokens(prompt + " " + system) + max_tokens
    if need > CONTEXT_TOKENS - CONTEXT_MARGIN:
        raise ContextOverflow(f"{need} tokens needed, {CONTEXT_TOKENS - CONTEXT_MARGIN} there")
    return chat.answer(prompt, system, 0.0, max_tokens)


def first_json_object(answer: str | None) -> str | None:
    """The first JSON object in a model's answer, through prose and code fences; None if there is none."""
    decoder, at = json.JSONDecoder(), 0
    while answer and (at := answer.find("{", at)) >= 0:
        try:
            value, _ = decoder.raw_decode(answer, at)
            return json.dumps(value)
        except ValueError:
            at += 1
    return None


@F.pandas_udf(StringType())
def _json_object(answers: pd.Series) -> pd.Series:
    return answers.map(first_json_object)


def json_object(answer: Column, schema: str) -> Column:
    """The first JSON object of ``answer`` as a struct; null where there is none."""
    return F.from_json(_json_object(answer), schema)


def sentence_quote(message: Column, width: int = 90) -> Column:
    """The text between the first two double quotes of a message."""
    return F.substring(F.split_part(message, F.lit('"'), F.lit(2)), 1, width)


