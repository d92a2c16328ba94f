"""An index over the children's vectors: a question reads the cells near it in place of every vector.

Centroids are fitted on a bounded sample; every vector lies in the cell of its nearest centroid, in folders by cell. How many
cells a question reads is measured when the centroids are fitted: as many as bring ``PROBES`` vectors of the sample ``RECALL`` of
their nearest 10, found by a scan of all vectors.

The index says which version of each partition of ``children`` it holds. Partitions that an upsert has rewritten since are
scanned, so answers never miss new rows nor give old ones, and ``refresh`` indexes only those. Vectors that are zero, of
another width or hold a component that is null or not finite are never near anything and are left out.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import GraphStore, Snapshot

SAMPLE = 8192  # vectors that centroids are fitted on, in expectation
CELLS = 512
PROBES, NEAR, RECALL = 64, 10, 0.95
ROWS = "child_id string, chunk_id string, embedding array<float>, place int"
NAMES = ("vectors", "centroids")


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype("f8")  # squares of large components leave single precision
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype("f4")


def usable(children: DataFrame, width: int) -> DataFrame:
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return children.where((F.size(v) == width) & sound)


def fit(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; cells that lose all their vectors keep their centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        at = (sample @ centroids.T).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        found, starts = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        size = np.linalg.norm(sums, axis=1)
        centroids[found[size > 0]] = sums[size > 0] / size[size > 0, None]
    return centroids


def in_cells(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with ``cell``, the number of the nearest centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["embedding"].tolist()).astype("f4")
                yield batch.assign(cell=(vectors @ centroids.T).argmax(axis=1).astype("i4"))

    return rows.mapInPandas(run, f"{ROWS}, cell int")


def near_by_scan(rows: DataFrame, queries: np.ndarray) -> DataFrame:
    """(query, cell, child_id) of the ``NEAR`` nearest of each query; a batch sends that many a query at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = queries @ unit(np.stack(batch["embedding"].tolist())).T
                k = min(NEAR, len(batch))
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(len(queries)), k)
                yield pd.DataFrame({"query": q.astype("i4"), "cell": batch["cell"].to_numpy()[best.ravel()], "child_id": batch["child_id"].to_numpy()[best.ravel()], "score": scores[q, best.ravel()]})

    found = rows.select("child_id", "embedding", "cell").mapInPandas(run, "query int, cell int, child_id string, score float")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "child_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEAR).select("query", "cell", "child_id")


def cells_needed(near: list[tuple[int, int]], queries: np.ndarray, centroids: np.ndarray) -> int:
    """The fewest cells, nearest first, that hold ``RECALL`` of what is near the queries."""
    order = np.argsort(-(queries @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    ranks = np.sort([place[q, c] for q, c in near])
    return int(ranks[int(np.ceil(RECALL * len(ranks))) - 1]) + 1


class VectorIndex:
    def __init__(self, store: GraphStore, width: int) -> None:
        self.children, self.width = store, width
        self.store = GraphStore(store.spark, f"{store.root}/_index", store.parts)
        self._centroids: tuple[str, np.ndarray] = ("", np.empty((0, width), "f4"))

    def _path(self, name: str, version: str) -> str:
        return f"{self.store.root}/{name}/v={version}"

    def centroids(self, version: str) -> np.ndarray:
        """At most ``CELLS`` rows; read once."""
        if self._centroids[0] != version:
            rows = self.store.spark.read.parquet(self._path("centroids", version)).orderBy("cell").collect()
            self._centroids = (version, np.array([r["centroid"] for r in rows], "f4"))
        return self._centroids[1]

    def _drawn(self, rows: DataFrame) -> np.ndarray:
        """Vectors of length one in the order of their ids, 2 * ``SAMPLE`` at most, as one Arrow buffer."""
        found = rows.select("child_id", "embedding").limit(2 * SAMPLE).toArrow().sort_by("child_id")
        return unit(found["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width))

    def current(self, now: Snapshot, index: Snapshot) -> set[str]:
        """The partitions of ``children`` that the index holds as they are."""
        held = index.tables.get("of", {})
        return {p for p, v in now.tables.get("children", {}).items() if held.get(p) == v}

    def refresh(self, rebuild: bool = False) -> dict:
        """Index the partitions that changed; with ``rebuild``, or where nothing is indexed yet, fit new centroids and index all."""
        now, index = self.children.snapshot(), self.store.snapshot()
        rebuild = rebuild or not index.tables.get("centroids")
        stale = set(now.tables.get("children", {})) - (set() if rebuild else self.current(now, index))
        rows = usable(now.table("children", {int(p) for p in stale}), self.width).select("child_id", "chunk_id", "embedding", now.place("children").alias("place"))
        version = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"
        tables = {n: dict(index.tables.get(n, {})) for n in ("of", "vectors", "centroids", "probe")}
        probes = None
        if rebuild:
            tables = {n: {} for n in tables}
            total = rows.count()
            if not total:
                return {"indexed": 0, "cells": 0, "probed": 0}
            share = F.pmod(F.xxhash64("child_id"), F.lit(1_000_000)) < max(1, int(1e6 * SAMPLE / total))
            drawn = self._drawn(rows.where(share) if total > SAMPLE else rows)
            sample = drawn if len(drawn) else self._drawn(rows.limit(1))
            cells = max(1, min(CELLS, int(total**0.5), len(sample)))
            fitted, probes = fit(sample, cells), sample[np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)]
            frame = self.store.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted)], "cell int, centroid array<float>")
            frame.coalesce(1).write.parquet(self._path("centroids", version))
            tables["centroids"] = {"0": version}
        centroids = self.centroids(tables["centroids"]["0"])
        if stale:
            # by range, so that a cell with many rows is several files and a task writes few cells
            in_cells(rows, centroids).repartitionByRange("cell", "child_id").write.partitionBy("cell").parquet(self._path("vectors", version))
        if probes is not None:
            held = self.store.spark.read.schema(f"{ROWS}, cell int").parquet(self._path("vectors", version))
            near = [(r["query"], r["cell"]) for r in near_by_scan(held, probes).collect()]  # PROBES x NEAR rows at most
            tables["probe"] = {"0": str(cells_needed(near, probes, centroids))}
        gone = set(tables["of"]) - set(now.tables.get("children", {}))
        for name, value in (("of", None), ("vectors", version)):
            tables[name] = {p: v for p, v in tables[name].items() if p not in gone} | {p: value or now.tables["children"][p] for p in stale}
        if not self.store._publish(index.number + 1, now.parts, tables):
            return self.refresh(rebuild)  # another refresh got in between
        self.store.vacuum(names=NAMES)
        return {"indexed": len(stale), "cells": len(centroids), "probed": int(tables["probe"]["0"])}

    def candidates(self, now: Snapshot, query: list[float]) -> DataFrame | None:
        """(child_id, chunk_id, embedding) of the cells near ``query`` and of the partitions not indexed; None without an index that helps."""
        index = self.store.snapshot()
        held = self.current(now, index) if index.tables.get("centroids") else set()
        if not held or len(query) != self.width:
            return None
        centroids = self.centroids(index.tables["centroids"]["0"])
        order = np.argsort(-(centroids @ np.asarray(query, "f4")), kind="stable")
        near = {f"cell={c}" for c in order[: int(index.tables["probe"]["0"])]}
        found = now.table("children", {int(p) for p in now.tables["children"] if p not in held}).select("child_id", "chunk_id", "embedding")
        for version in sorted({index.tables["vectors"][p] for p in held}):
            places = [int(p) for p in held if index.tables["vectors"][p] == version]
            paths = [f"{self._path('vectors', version)}/{n}" for n, _ in self.store._list(self._path("vectors", version)) if n in near]
            if paths:
                found = found.unionByName(self.store.spark.read.schema(ROWS).parquet(*paths).where(F.col("place").isin(places)).drop("place"))
        return found
