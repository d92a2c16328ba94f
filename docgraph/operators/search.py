"""Vector retrieval: nearest children, their parents once each, and the parents' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_score


def top_children(children: DataFrame, query: list[float], k: int) -> DataFrame:
    """(child_id, chunk_id, score): exact; the query is a literal, so a scan, a projection and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = children.select("child_id", "chunk_id", cosine_score(F.col("embedding"), q).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "child_id").limit(k)


def top_parents(hits: DataFrame, k: int) -> DataFrame:
    """(chunk_id, score, matched_children, rank): the best score, and a bonus for each further child."""
    grouped = hits.groupBy("chunk_id").agg(F.max("score").alias("score"), F.count("*").alias("matched_children"))
    ranked = grouped.withColumn("rank", F.col("score") + F.lit(0.02) * (F.col("matched_children") - 1))
    return ranked.orderBy(F.desc("rank"), "chunk_id").limit(k)


def passages(children: DataFrame, chunks: DataFrame, documents: DataFrame, query: list[float], k_child: int, k_parent: int) -> DataFrame:
    """chunk_id, text, source, score, matched_children, rank. At most k rows reach the joins, after both limits."""
    return passages_of(top_children(children, query, k_child), chunks, documents, k_parent)


def passages_of(hits: DataFrame, chunks: DataFrame, documents: DataFrame, k_parent: int) -> DataFrame:
    """As ``passages``, for hits that are found already: a top-k, so small enough to broadcast."""
    parents = chunks.select("chunk_id", "doc_id", "text")
    real = parents.join(F.broadcast(hits), "chunk_id").select("child_id", "chunk_id", "score")
    best = top_parents(real, k_parent)
    rows = parents.join(F.broadcast(best), "chunk_id")
    src = documents.select("doc_id", F.col("source_uri").alias("source")).join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi")
    return rows.join(F.broadcast(src), "doc_id", "left").select("chunk_id", "text", "source", "score", "matched_children", "rank").orderBy(F.desc("rank"), "chunk_id")
