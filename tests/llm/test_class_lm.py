import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docgraph.llm.class_lm import exchange, score_documents


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_base_scores_and_counts(spark):
    rng = random.Random(7)
    vocab = [f"W{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40]))), "s", 1) for i in range(80)]
    rows += [(80, None, None, 1), (81, "", "s", 1), (82, "never seen before", "s", 1), (None, "w1 w2", "s", 1), (3, rows[3][1], "s", 1)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out string, uid int").repartition(3), top=8, classes=3, listed=8).collect()
    words = {r[:2]: (r[1] or "").lower().split() for r in rows}
    count, ends = Counter(), 0
    for r in rows:
        if not held(r[0]):
            count.update(words[r[:2]])
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = []
    for r in rows:
        w = words[r[:2]]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want.append((r[0], held(r[0]), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(base, 6)))
    assert sorted([(*r[:5], round(r["base_score"], 6)) for r in got], key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d"[: 2 * (i % 6) + 1]) for i in range(40)]
    one = [(1000 + i, w) for i, w in enumerate(["a", "b", "c", "d", "unknown"])]
    free = [i for i in range(1000, 1100) if held(i)][:5]
    ask = [(i, w) for i, (_, w) in zip(free, one, strict=True)]
    empty = next(i for i in range(2000, 2100) if held(i))
    got = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame([*rows, *ask, (empty, "")], "doc_id long, text string"), top=2, classes=2, listed=1).collect()}
    # P(end | start) and the sum of P(w, end | start) stay below one; single words first, so P(w) > P(w, end).
    assert 10 ** got[empty] + sum(10 ** got[i] for i in free) <= 1 + 1e-9


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exchange_finds_alternating_classes():
    n = np.zeros((8, 8), np.int64)
    for a in (0, 2, 4):
        for b in (1, 3, 5):
            n[a, b] = n[b, a] = 50
    label = exchange(n, 2)
    assert len({label[0], label[2], label[4]}) == 1 and len({label[1], label[3], label[5]}) == 1 and label[0] != label[1]


def test_beats_the_base_on_held_out_text(spark):
    rng = random.Random(8)
    groups = [[f"{g}{i}" for i in range(12)] for g in "xyz"]
    rows = [(i, " ".join(rng.choice(groups[(j + i) % 3]) for j in range(30))) for i in range(150)]
    got = [r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), classes=3).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 5 * len(got)
    assert pytest.approx(31) == got[0]["n_tokens"]


def test_words_beyond_the_seeds_have_classes(spark):
    rng = random.Random(9)
    groups = [[f"{g}{i}" for i in range(40)] for g in "xyz"]
    rows = [(i, " ".join(rng.choice(groups[(j + i) % 3]) for j in range(30))) for i in range(400)]
    got = [r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), top=12, classes=3, listed=16).collect() if r["held_out"]]
    # Known classes save log10(3) = 0.48 a word; 12 of the 120 words are seeds.
    assert sum(r["score"] - r["base_score"] for r in got) > 0.3 * sum(r["n_tokens"] for r in got)
