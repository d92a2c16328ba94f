import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docgraph.llm.exact_dedup import chunks, exact_groups, keep_first
from docgraph.llm.mixing import mix, mixed, targets

ROWS = [
    (1, "a b  c", "s1"), (2, "a\tb\nc", "s1"), (3, " a b c", None), (4, None, "s2"), (5, "", "s2"), (6, "   ", "s2"), (7, "x " * 30000, "s3"), (8, "x\n" * 30000, "s3"), (7, "x " * 30000, "s3"), (None, "lone", "s1"), (9, "A b c", "s1"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("recipe", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("size", F.lit(2))


def test_exact_groups(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[norm(text)].append(doc_id)
    want = []
    for doc_id, text, _ in ROWS:
        members = groups[norm(text)]
        keep = min((m for m in members if m is not None), default=None)
        want.append((doc_id, keep, len(members), doc_id == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    assert sorted(map(tuple, exact_groups(frame(spark)).collect()), key=str) == sorted(want, key=str)
    assert exact_groups(frame(spark).limit(0)).count() == 0
    kept = keep_first(frame(spark))
    assert kept.columns == frame(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "6", "7", "None", "9"])


def test_rows_are_judged_one_by_one(spark):
    rows = [(3, "B", "s"), (5, "A", "s"), (5, "B", "s"), (5, "A", "s"), (None, "A", "s"), (None, "C", "s"), (None, "C", "t"), (None, None, "s"), (8, "", "s")]
    got = sorted(((r["doc_id"], r["text"]) for r in keep_first(frame(spark, rows).repartition(3)).collect()), key=str)
    assert got == sorted([(3, "B"), (5, "A"), (None, "C"), (8, "")], key=str)
    assert keep_first(frame(spark).limit(0)).count() == 0


def test_chunks_join_to_the_text_and_resist_shifts(spark):
    import random

    rng = random.Random(4)
    latin = " ".join(rng.choice(["tea.", "word", "no,", "über", "x" * 20, *(f"q{i}" for i in range(90))]) for _ in range(3000))
    others = ["".join(chr(rng.randint(a, b)) + " " * (rng.random() < 0.1) for _ in range(9000)) for a, b in ((0x430, 0x44F), (0x4E00, 0x9FA5), (0x627, 0x64A), (0x3041, 0x3096), (0x905, 0x939))]
    for text in (latin, *others):
        df = spark.createDataFrame([(text,), ("ins" + text,)], "t string")
        one, two = [r[0] for r in df.select(chunks(F.col("t"), 256, 4096)).collect()]
        assert "".join(one).encode("latin-1").decode() == text and len(one) > 10 and max(map(len, one)) <= 4096
        assert len(set(one) & set(two)) > 0.6 * len(one)


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated resharing, as the rule is told."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    for _ in range(len(names) + 1):
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] = left * weight[s] / total
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        capped |= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 400, None: 77, "d": 0}, {"a": 5}, {"a": 1000, "b": 1}, {"z": 100, "y": 100, "x": 100, "w": 5000, "v": 3}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_mix(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", "c", None][i % 4]) for i in range(4000)] + [(9000, None, "e")]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["source_size"], r["target"]][0] += r["taken"]
    assert all(abs(taken - t) <= 0.05 * t + 1 for (_, t), (taken, _) in by.items())
    again = {(r["doc_id"], r["copies"]) for r in mix(frame(spark, rows).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    out = mixed(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and out.count() == sum(r["copies"] for r in got)
    odd = [(7, "a b", "s"), (7, "c", "s"), (7, "a b", "s"), (None, "d", "s"), (None, None, None), (8, "w " * 100_000, "t")]
    twice = {(r["doc_id"], r["size"]): r["copies"] for r in mix(frame(spark, odd)).collect()}
    assert twice[7, 2] == twice[7, 1] and twice[8, 100_000] <= 2 and twice[None, 0] in (0, 1, 2)  # one id, one draw
    assert len(mix(frame(spark, odd)).collect()) == 6
    assert mix(frame(spark, rows).limit(0)).count() == 0 and mixed(frame(spark, rows).limit(0)).count() == 0
