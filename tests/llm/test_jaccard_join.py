import random
import sys

import numpy as np
from pyspark import cloudpickle

from docgraph.llm.jaccard_join import Sets, join, keep_one, linked, near_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return sorted((doc_id, len(sets[i]), min(least[find(i)])) for i, (doc_id, _) in enumerate(rows))


def corpus(rng, bases=12, copies=14):
    vocab = [f"Word{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = [None, "", "  ", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    for _ in range(bases):
        w = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 120]))]
        if rng.random() < 0.5:
            w = passage + w
        for _ in range(rng.randint(1, copies)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
    w = [rng.choice(vocab) for _ in range(80)]
    for _ in range(60):  # a chain: each differs a little from the one before
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 2, 3) for i, t in rows], "doc_id long, text string, key string, bucket int, block int").repartition(3)
    return sorted(tuple(r) for r in near_components(df).collect())


def test_against_brute_force(spark):
    rows = corpus(random.Random(4))
    assert run(spark, rows) == brute(rows)


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    import docgraph.llm.jaccard_join as m

    rows = corpus(random.Random(5))
    rows += [(1000 + i, f"one line that very many of the documents hold {i % 40} {i}") for i in range(200)]
    monkeypatch.setattr(m, "PAIRS", 4)
    assert run(spark, rows) == brute(rows)


def test_large_blocks_are_dealt_without_loss(spark, monkeypatch):
    import docgraph.llm.jaccard_join as m

    monkeypatch.setattr(m, "LIMIT", 5)
    for seed, pairs in ((6, 256), (7, 3)):
        monkeypatch.setattr(m, "PAIRS", pairs)
        rows = corpus(random.Random(seed), copies=30)
        assert run(spark, rows) == brute(rows)


def test_regions_are_named_by_all_bits(spark, monkeypatch):
    """Sets of 32 and 24 shingles, at 3/4 exactly, whose hashes agree in their upper halves and modulo small numbers."""
    import docgraph.llm.jaccard_join as m

    monkeypatch.setattr(m, "shingle_set", crowded)
    rows = [(1, "32"), (2, "24"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_components(df).collect()) == [(1, 32, 1), (2, 24, 1), (3, 0, 3)]


def crowded(text):
    return np.arange(int(text or 0)).astype(np.uint64) * np.uint64(720720)


def test_rows_are_judged_one_by_one(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(["other", *base[1:]])
    rows = [(3, " ".join(base)), (5, "alone " * 9), (5, near), (None, near + " x"), (None, "one more text of its own here"), (7, "alone " * 9), (9, ""), (9, None), (9, "alone " * 9)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, __of string, row int").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one(df.drop("__of")).collect()), key=str)
    assert got == sorted([(3, " ".join(base)), (5, "alone " * 9), (None, "one more text of its own here"), (9, ""), (9, None)], key=str)
    assert keep_one(df.limit(0).drop("__of")).count() == 0


def test_repeated_and_null_ids_and_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-500], "x"])), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, " ".join(long[:-3])), (6, None)]
    assert run(spark, rows) == brute(rows)
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g h"), (None, "p q"), (3, "p q")], "doc_id long, text string")
    assert sorted(((r[0], r[2]) for r in near_components(nulls).collect()), key=str) == sorted([(None, None), (None, None), (None, 3), (3, 3)], key=str)


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recursive_regions_equal_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(12):
            v = base.copy()
            k = int(rng.integers(0, 14))
            v[rng.choice(60, k, replace=False)] = rng.integers(0, 1 << 62, k).astype(np.uint64)
            sets.append(np.unique(v))
    s, t = Sets(sets), Sets(sets)
    join(s, np.arange(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                t.union(i, j)
    assert [s.find(i) for i in range(len(sets))] == [t.find(i) for i in range(len(sets))]
