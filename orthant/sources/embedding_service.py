"""Embeddings from a service over HTTP, one text a request."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import parse_embedding

TIMEOUT_S = 120


def ask(url: str, model: str, text: str) -> str:
    """The service's answer for one text."""
    body = json.dumps({"model": model, "input": text}).encode()
    request = urllib.request.Request(url.rstrip("/") + "/api/embed", body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
        return answer.read().decode()


def embed(texts: DataFrame, text: str, url: str, model: str, into: str = "vec") -> DataFrame:
    """texts with the service's vector; null and empty texts get an empty one and aren't sent. A failed request fails the task, which Spark retries."""

    @F.arrow_udf("string")
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([ask(url, model, t) if t else None for t in batch.to_pylist()], pa.string())

    empty: Column = F.array().cast("array<float>")
    return texts.withColumn(into, F.coalesce(parse_embedding(answers(text)), empty))
