"""Embedding cache: known texts from the cache, the rest through a user's model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import ship_package

Embedder = Callable[[list[str]], list[list[float]]]


def cache_key(model: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), content), 256)


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Deterministic stand-in for a model: signed hashed word counts."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, content in enumerate(texts):
            for word in content.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                slot = int.from_bytes(digest[:4], "big") % dimensions
                out[row, slot] += 1.0 if digest[4] & 1 else -1.0
        return out.tolist()

    return embed


def embed_texts(texts: DataFrame, embed: Embedder, model: str, batch: int = 10) -> DataFrame:
    """(cache_key, embedding) of distinct texts, at most ``batch`` per model call."""
    ship_package(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = embed(part["content"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("embedder returned an unexpected vector count")
                yield pd.DataFrame({"cache_key": part["cache_key"].tolist(), "embedding": vectors})

    return texts.select("cache_key", "content").mapInPandas(run, "cache_key string, embedding array<float>")


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct non-blank texts the cache does not hold."""
    cleaned = texts.select(strip(F.col("content")).alias("content")).filter("content != ''").distinct()
    keyed = cleaned.withColumn("cache_key", cache_key(model, F.col("content")))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def embed_with_cache(
    texts: DataFrame, cache: DataFrame, embed: Embedder, model: str = "hashing", batch: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Texts with their embedding, and the new cache rows to append."""
    fresh = embed_texts(cache_misses(texts, cache, model), embed, model, batch)
    known = cache.select("cache_key", "embedding").unionByName(fresh)
    keyed = texts.withColumn("cache_key", cache_key(model, strip(F.col("content"))))
    return keyed.join(known, "cache_key", "left"), fresh
