"""Vectors for children, computed in Arrow batches next to their keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..providers import Embedder
from .chunking import contextualized


def checked(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    vectors = embedder.embed(texts)
    if len(vectors) != len(texts):
        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    if any(len(v) != embedder.dimensions for v in vectors):
        raise ValueError(f"a vector is not {embedder.dimensions} wide")
    return vectors


EMBEDDED = "child_id string, chunk_id string, text string, seq int, embedding array<float>, error string"


def embed_children(children: DataFrame, parents: DataFrame, embedder: Embedder, config: EngineConfig) -> DataFrame:
    """(child_id, chunk_id, text, seq, embedding, error). ``parents``: (chunk_id, text, source).

    What is embedded has the source and the parent's head before it; what is kept is the child's own text. Children whose
    request fails have no vector but an error, and can be filled in later; they never fail a job.
    """
    p = parents.select("chunk_id", F.col("text").alias("parent"), F.col("source"))
    asked = children.join(p, "chunk_id").withColumn("asked", contextualized(F.col("text"), F.col("parent"), F.coalesce("source", F.lit("unknown")), config.context_prefix_chars))
    size = config.embed_batch_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, vectors, errors = batch.pop("asked").tolist(), [], []
            for i in range(0, len(texts), size):
                part = texts[i : i + size]
                try:
                    vectors += checked(embedder, part)
                    errors += [None] * len(part)
                except Exception as e:  # a provider may raise anything
                    vectors += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            yield batch.assign(embedding=vectors, error=errors)

    return asked.select("child_id", "chunk_id", "text", "seq", "asked").mapInPandas(run, EMBEDDED)
