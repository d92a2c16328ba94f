import random
import zlib

import numpy as np

from docgraph.llm.ann import Shard, nearest
from docgraph.llm.cnn_quality import CHUNK, FILTERS, WIDTH, Model, chunked, fit, keep_good, score_documents, scores, train


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def corpus(n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["tree", "river", "stone", "light", "quiet", "morning"]) for _ in range(rng.randint(4, 80))]
        text = " ".join(words) + "." if good else rng.choice([" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words)])
        rows.append((i, text, "x"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_clean_documents_stay(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (1002, "tree " * 50000, "x")], "doc_id long, text string, score string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train(docs, y)
    got = {r["doc_id"]: r for r in score_documents(docs, model).collect()}
    truth = {i: q for i, q, _ in labels}
    tested = [i for i in truth if held(i)]
    assert len(got) == len(rows) + 3 and all(got[i]["held_out"] == held(i) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    # Labels of held-out rows are never read.
    lie = spark.createDataFrame([(i, 1 - q if held(i) else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(train(docs, lie).table, model.table)


def test_every_window_lies_in_one_chunk():
    texts = [b"", b"a", b"abcd", b"x" * (CHUNK + WIDTH - 1), bytes(i % 251 for i in range(3 * CHUNK + 7))]
    rows, windows, of = chunked(texts)
    for k, t in enumerate(texts):
        mine = [bytes(r[j : j + WIDTH]) for r, w in zip(rows[of == k], windows[of == k], strict=True) for j in range(w)]
        assert mine == ([] if not t else [t[j : j + WIDTH] for j in range(len(t) - WIDTH + 1)] or [t.ljust(WIDTH, b"\0")])


def test_one_class_or_no_rows(spark):
    assert scores(fit([b"a", b"b"], np.array([1, 1])), [b"c"]).tolist() == [1.0]
    assert scores(fit([], np.array([])), [b"c", b""]).tolist() == [0.5, 0.5]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(none, fit([], np.array([]))).count() == 0


def brute(rows, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            near = [(-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in near)[:k]]
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[50][1]) for i in range(30)]  # equal vectors: ties to smaller ids
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None, 1.0]), (3200, []), (3250, [1.0, 2.0]), (3251, [2.0, 4.5]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, rank int").repartition(3)
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), shard_rows=500).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [j for j, _ in got[50]] == [2000, 2001, 2002, 2003, 2004] and got[3250][0][0] == 3251 and len(got[3250]) == 1
    vectors = {i: np.array(v, np.float64) for i, v in rows if v}
    for q, near in got.items():
        for j, s in near:
            a, b = vectors[q], vectors[j]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_few_candidates():
    v = np.eye(3, dtype=np.float32)
    q, c, s = Shard.of(np.arange(3), v).search(np.array([0]), v[:1], 5)
    assert sorted(c.tolist()) == [1, 2] and np.allclose(s, 0)


def test_a_repeated_id_is_one_item(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (1, [0.2, 0.9]), (2, [0.5, 0.5]), (3, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, df.where("vec_id % 50 = 0"), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_clustered_vectors_need_few_cells(spark, monkeypatch):
    """Many cells and shards, one cell with a third of the rows; recall is kept although queries visit few cells."""
    import docgraph.llm.ann as m

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 24))
    of = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 24, 3000))
    x = (centres[of] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(m, "BLOCK", 7)
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), shard_rows=150, probe=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows)
    assert sum(len(got[q] & {j for j, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_scores_equal_a_plain_convolution():
    """Every window of the whole text, one after another, in plain loops."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 4, 5, 6, 255, 256, 257, 260, 700)] + [b""]
    model = Model(rng.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), rng.normal(0, 0.5, 2 * FILTERS + 1), 0.2)
    for text, got in zip(texts, scores(model, texts), strict=True):
        padded = text.ljust(WIDTH, b"\0") if text else b""
        windows = [sum(model.table[j][padded[i + j]].astype(np.float64) for j in range(WIDTH)) for i in range(len(padded) - WIDTH + 1)] if text else []
        chunks = [np.maximum(np.max(windows[i : i + CHUNK], axis=0) + model.bias, 0) for i in range(0, len(windows), CHUNK)]
        f = np.zeros(2 * FILTERS + 1)
        if chunks:
            f[:FILTERS], f[FILTERS:-1] = np.mean(chunks, axis=0), np.max(chunks, axis=0)
            f[-1] = np.log(CHUNK / min(CHUNK, max(len(windows[i : i + CHUNK]) for i in range(0, len(windows), CHUNK))))
        assert abs(got - 1 / (1 + np.exp(-(f @ model.out + model.out_bias)))) < 1e-5


def test_odd_rows_and_the_bound_of_bytes(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "a"), (None, None), (2, "c" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 0), (3, 1), (4, None)], "doc_id long, quality int")
    model = fit([b"good text here", b"###"], np.array([1, 0]))
    got = score_documents(docs, model).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] == 1}) <= 2 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert train(docs, labels, held=9, sample_bytes=100).constant == 0.0  # id 1 alone: its least label
    assert train(docs, labels, held=9, sample_bytes=5000).constant == 0.0
    assert keep_good(docs, model, threshold=0.0).count() == 6
    assert keep_good(docs.limit(0), model).count() == 0 and train(docs.limit(0), labels).constant == 0.5
