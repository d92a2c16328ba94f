import hashlib
import random

import numpy as np

from docgraph.llm.substring_dedup import Bits, FMIndex, repeated_windows


def brute(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(words, key=lambda x: -(1 << 63) if x[0] is None else x[0]):
        key = -(1 << 63) if i is None else i
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (key, s))
            first[tuple(w[s : s + window])] = min(first[tuple(w[s : s + window])], (key, s))
    out = []
    for i, w in words:
        off = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (-(1 << 63) if i is None else i, s):
                off[s : s + window] = [True] * window
        kept = b" ".join(x for x, o in zip(w, off, strict=True) if not o)
        out.append((i, len(w), sum(off), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n=60):
    vocab = [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocab) for _ in range(55)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 19, 20, 21, 80, 200]))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : rng.randint(30, 55)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, "a " * 70), (n + 3, None), (n + 4, ""), (n + 5, "x y " * 40), (None, rows[7][1]), (n + 6, " ".join(f"u{i}" for i in range(30))), (5, rows[5][1]), (3, rows[9][1] + " other text " + rows[4][1])]
    return rows


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, owner string, bucket int").repartition(3)
    got = sorted([tuple(r) for r in repeated_windows(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)
    assert got == brute(rows, options.get("window", 20))


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(1)))


def test_hot_values_are_split_without_loss(spark):
    check(spark, corpus(random.Random(2)), hot=3)


def test_empty_table(spark):
    assert repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = FMIndex(text, 4, 20)
    for _ in range(200):
        m = int(rng.integers(1, 20))
        s = int(rng.integers(0, 380))
        p = text[s : s + m]
        lo, hi = np.array([0]), np.array([len(text)])
        for c in p[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        places = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
        assert hi[0] - lo[0] == len(places)


def test_packed_bits():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 1000):
        bit = rng.random(n) < 0.3
        b = Bits(bit)
        assert b.rank(np.arange(n + 1)).tolist() == [int(bit[:i].sum()) for i in range(n + 1)]
        assert b.select(np.arange(b.ones + 1)).tolist() == [*np.flatnonzero(bit).tolist(), n]


def test_very_long_texts_and_many_blocks(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(60_000))
    rows = [(1, long), (2, "start " + long[: len(long) // 2]), (3, "a b " * 30_000), (3, "a b " * 30_000)]
    check(spark, rows)
