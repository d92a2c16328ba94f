"""Mixing sources to target weights (DataFrame functions only).

Words are aggregated per source, capped weighted shares give each source a target and so a repetition
rate, and each document is emitted floor(rate) times plus one Bernoulli copy drawn from a seeded hash of
its id. The only shuffle is a partial aggregate of one row per source and task.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own,
last in order; rows that repeat an id share their draw; an empty table gives an empty result; columns
other than the three named ones pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_in

SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> + target: shares by weight, none above ``most`` times its source.

    Resharing an excess by weight until none is above has the fixed point target = min(cap, level * weight).
    With sources in the order of cap / weight, ``level`` is the first (budget - caps before) / weights left
    that does not exceed its own source's cap / weight. One row per source reaches the windows.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(left))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"])
    level = F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))
    return s.select("source", "source_size", F.least("cap", level).alias("target"))


def drawn(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a seeded digest of the id: any run and any engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), **shares).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = drawn(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    out = d.join(t, d["source"].eqNullSafe(t["of"])).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns as they came.

    The rate depends on the source alone, so only one row per source is joined to the documents.
    """
    sizes = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, **shares)
    t = t.select(F.col("source").alias("__of"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"))
    draw = drawn(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)
    copies = F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    out = docs.join(t, docs[source_col].eqNullSafe(t["__of"])).withColumn("__copy", F.explode(F.sequence(F.lit(0), copies.cast("int"))))
    return out.where(F.col("__copy") > 0).select(*[docs[c] for c in docs.columns])
