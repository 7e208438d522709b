"""Sources of text embeddings behind one interface, and the index of a corpus of texts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import index, vectors


class EmbeddingSource(Protocol):
    """name: of the model; dims: size of every vector, 0 if it isn't known yet; embed: df with its texts' vectors as vec."""

    name: str
    dims: int

    def embed(self, df: DataFrame, text: str = "text") -> DataFrame: ...


class HashSource:
    """Token counts by hashed dimension."""

    def __init__(self, dims: int = 768, scale: int = 1_000_000):
        self.dims, self.scale, self.name = dims, scale, f"direct-hash-{dims}d"

    def embed(self, df: DataFrame, text: str = "text") -> DataFrame:
        return t.hash_embedding(df, self.dims, self.scale, text, dense=True)


class ServiceSource:
    """Vectors of a service over HTTP."""

    def __init__(self, url: str, model: str, dims: int = 0):
        self.url, self.name, self.dims = url, model, dims

    def embed(self, df: DataFrame, text: str = "text") -> DataFrame:
        from ..sources import embedding_service

        return embedding_service.embed(df, text, self.url, self.name)


class ModelSource:
    """Vectors of a transformer in a model file that the executors can open."""

    def __init__(self, path: str, dims: int = 0):
        self.path, self.dims, self.name = path, dims, path.rsplit("/", 1)[-1]

    def embed(self, df: DataFrame, text: str = "text") -> DataFrame:
        from . import transformers

        return df.withColumn("vec", transformers.embedding(F.col(text), self.path))


def build_index(corpus: DataFrame, source: EmbeddingSource, zero: float = 0.01, budget: int | None = None, cells: int = 64) -> index.Index:
    """Embed the texts of a corpus (id, text), quantise the vectors and index them. Texts are embedded once, and those of the pivots once more."""
    sample = corpus.select("id", "text").orderBy(F.xxhash64("id"), "id").limit(cells)
    return index.build(embedded(corpus, source, zero, budget), source.dims, cells, embedded(sample, source, zero, budget))


def embedded(texts: DataFrame, source: EmbeddingSource, zero: float = 0.01, budget: int | None = None) -> DataFrame:
    """id, e: quantised vectors of texts (id, text), as an index takes them and is asked with."""
    return source.embed(texts.select("id", "text")).select("id", vectors.quantize(F.col("vec"), zero=zero, budget=budget).alias("e"))
