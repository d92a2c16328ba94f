import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from docgraph.llm.cnn_quality import scores, train  # noqa: E402

from .test_jaccard_join import brute as near_brute  # noqa: E402
from .test_native import reshared  # noqa: E402


def documents():
    rng = random.Random(9)
    vocab = ["tree", "river", "stone", "light", "quiet", "morning", "glass", "paper", "winter", "garden", "music", "window"]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(12, 60))]
        rows.append((i, " ".join(w), "en", rng.choice(["a", "b", None]), 0))
    for i in range(120, 150):
        w = rows[i - 120][1].split()
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, "  ".join(w), "en", "c", 0))
    rows += [(i, " ".join(rng.choice(vocab) + "###" for _ in range(30)), "en", "a", 0) for i in range(150, 190)]
    # Ids on several texts, repeated rows, null ids.
    rows += [(5, rows[7][1], "en", "a", 0), (5, rows[5][1], "en", "a", 0), (9, rows[8][1] + " more", "en", "b", 0), (9, rows[9][1], "en", "b", 0), (None, rows[11][1] + " more", "en", "a", 0)]
    rows += [(None, " ".join(rng.choice(vocab) for _ in range(40)), "en", "a", 0), (None, " ".join(rng.choice(vocab) for _ in range(40)), "en", "b", 0)]
    return [*rows, (190, "", "en", "a", 0), (191, None, "en", "b", 0), (192, "tree river " * 3000, "fr", "b", 0)]


def test_run_equals_brute_force(spark, tmp_path):
    rows = documents()
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(sorted({(i, int("###" not in (t or "")), 0) for i, t, *_ in rows if i is not None and i < 190}), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = corpus_pipeline.run(spark, path).collect()
    assert all(hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in out)
    got = Counter(tuple(r)[:4] for r in out)

    model = train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    good = scores(model, [(r[1] or "").encode() for r in rows]) >= 0.7
    kept = [r for r, g in zip(rows, good, strict=True) if g]
    assert {r[0] for r in kept} >= {r[0] for r in rows if r[0] is None or r[0] < 150}  # clean documents stay
    assert not {r[0] for r in kept} & set(range(150, 190))
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for r in by_id:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    kept = list(first.values())
    places = near_brute(list(enumerate(r[1] for r in kept)))  # numbered by the order of ids
    kept = [kept[i] for i, _, c in places if i == c]
    sizes = defaultdict(int)
    for r in kept:
        sizes[r[3]] += len((r[1] or "").split())
    target = reshared(sizes)
    theirs, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in kept:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        draw = int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate + 1e-12) + (draw < rate - math.floor(rate + 1e-12))
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        if copies:
            want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += copies
    assert got == want


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
