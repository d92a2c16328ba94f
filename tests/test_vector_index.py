import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.config import EngineConfig
from docgraph.operators import search
from docgraph.operators.vector_index import cells_needed, fit, unit
from docgraph.providers import HashEmbedder
from docgraph.service import Engine, dispatch

WIDTH, N = 16, 3000
CONFIG = EngineConfig(embedding_dimensions=WIDTH, store_partitions=8)


def clustered(rng, n):
    centres = rng.normal(size=(20, WIDTH))
    return (centres[rng.integers(0, 20, n)] + 0.35 * rng.normal(size=(n, WIDTH))).astype("f4")


def put(store, vectors, first=0):
    """One document, chunk and child a vector."""
    rows = [(f"d{i + first}", f"d{i + first}:0", f"d{i + first}:0:0", None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    df = store.spark.createDataFrame(rows, "doc_id string, chunk_id string, child_id string, embedding array<float>")
    docs = df.select("doc_id", F.col("doc_id").alias("source_uri"), F.lit("h").alias("content_hash"), F.current_timestamp().alias("ingested_at"))
    store.write_documents(docs, df.select("chunk_id", "doc_id", F.lit("t").alias("text"), F.lit(0).alias("seq"), F.lit("h").alias("content_hash")))
    store.write_children(df.select("child_id", "chunk_id", F.lit("t").alias("text"), F.lit(0).alias("seq"), "embedding"))


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", CONFIG, embedder=HashEmbedder(WIDTH))
    e.store.setup()
    return e


def ids(rows):
    return [r["child_id"] for r in rows.orderBy(F.desc("score"), "child_id").collect()]


def test_near_cells_hold_what_is_near(engine):
    rng = np.random.default_rng(5)
    vectors = clustered(rng, N)
    put(engine.store, vectors)
    done = engine.index()
    assert done["indexed"] == 8 and done["cells"] == int(N**0.5) and done["probed"] < done["cells"] / 2
    now, hit, read = engine.store.snapshot(), 0, 0
    queries = clustered(np.random.default_rng(5), N + 12)[-12:]
    for q in queries:
        scores = unit(vectors) @ unit(q[None])[0]
        want = {f"d{i}:0:0" for i in np.argsort(-scores, kind="stable")[:10]}
        hit += len(want & set(ids(engine.nearest(now, [float(x) for x in q], 10))))
        read += engine.vectors.candidates(now, [float(x) for x in q]).count()
    assert hit >= 0.9 * 10 * len(queries)
    assert read < 0.6 * N * len(queries)


def test_rewritten_partitions_are_scanned_until_they_are_indexed(engine):
    rng = np.random.default_rng(6)
    vectors = clustered(rng, 400)
    put(engine.store, vectors)
    engine.index()
    target = [float(x) for x in rng.normal(size=WIDTH)]
    put(engine.store, [target, [-x for x in target]], first=399)  # d399 gets another vector, d400 is new
    now = engine.store.snapshot()
    assert ids(engine.nearest(now, target, 1)) == ["d399:0:0"]
    old = [float(x) for x in vectors[399]]
    near = engine.vectors.candidates(now, old).where("child_id = 'd399:0:0'").collect()
    assert len(near) <= 1 and all(list(r["embedding"]) == pytest.approx(target) for r in near)
    again = engine.index()
    assert 1 <= again["indexed"] <= 2
    assert ids(engine.nearest(engine.store.snapshot(), target, 1)) == ["d399:0:0"]
    assert engine.index()["indexed"] == 0
    assert engine.index(rebuild=True)["indexed"] == 8


def test_unusable_vectors_copies_and_small_tables(engine, spark):
    assert engine.index() == {"message": "0 partition(s) indexed.", "indexed": 0, "cells": 0, "probed": 0}
    one = [1.0] + [0.0] * (WIDTH - 1)
    big = [3e38] * WIDTH
    odd = [None, [0.0] * WIDTH, [float("nan")] * WIDTH, [None] + one[1:], [1.0], [float("inf")] * WIDTH]
    put(engine.store, odd + [one] * 5 + [big])
    engine.index()
    now = engine.store.snapshot()
    indexed = {f"d{i}:0:0" for i in range(6, 12)}
    assert set(ids(engine.nearest(now, one, 5))) == indexed - {"d11:0:0"}
    assert engine.vectors.candidates(now, [1.0, 2.0]) is None  # of another width: all are scanned
    more = engine.nearest(now, one, 200)  # more than the cells hold: all are scanned
    assert ids(more) == ids(search.top_children(now.table("children"), one, 200))
    assert dispatch(engine, "POST", "/index")[0] == 200
    engine.reset()
    assert engine.vectors.candidates(engine.store.snapshot(), one) is None


def test_fit_and_cells_needed():
    x = unit(np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]], "f4"))
    c = fit(x, 2)
    assert sorted((x @ c.T).argmax(axis=1).tolist()) == [0, 0, 1, 1]
    assert cells_needed([(0, 0), (1, 0)], x[:2], c) == 1
    assert cells_needed([(0, 0), (0, 1)], x[:1], c) == 2
    copies = unit(np.ones((6, 2), "f4"))
    assert np.isfinite(fit(copies, 3)).all()
