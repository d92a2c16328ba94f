import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from docgraph.llm.chat_format import format_conversations, parse, read_back, unescape
from docgraph.llm.token_files import load, read_selected, read_tokens, with_crc, write_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
NASTY = ["", "plain", r"\### Assistant: </turn> ok", "### User:", "</turn>", "a\n</turn>\nb", "\\\\### x\n\\</turn>", "\n", "\n\n### Role: user\n", "é\U0001f600", "</turn>\n", "\\"]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem\\n", None]), rng.choice([*NASTY, None]), "x") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(100, 1, "assistant", "tie b", "x"), (100, 1, "assistant", "tie a", "x"), (100, None, "user", "first", "x"), (None, 0, "user", "null id", "x"), (101, 0, "user", "long " * 50000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = format_conversations(df)
    convs = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    for row in formatted.collect():
        text = row["formatted"].encode()
        assert [(r.decode(), x.decode()) for r, x in parse(text)] == convs[row["conv_id"]]
        spans = [unescape(text[a:b]).decode() for a, b in zip(row["loss_spans"][::2], row["loss_spans"][1::2], strict=True)]
        assert spans == [x for r, x in convs[row["conv_id"]] if r == "assistant"]
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(loss))
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert format_conversations(df.limit(0)).count() == 0


def in_file(row):
    h = xxhash.xxh64((row[1] or "").encode(), seed=42).intdigest()
    return (row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h, row[1] or "")


def test_token_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["Hello", "wörld,", "x9", "don't", "<|endoftext|>", "東京"]) for _ in range(rng.choice([0, 1, 30]))), 1) for i in rng.sample(range(-50, 5000), 200)]
    rows += [(None, "no id", 1), (None, None, 1), (6000, None, 1), (6001, "", 1), (6002, "tie b", 1), (6002, "tie a", 1), (6003, "long word " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int").repartition(5)
    path = f"file://{tmp_path}/tokens"
    write_tokens(df, path, WORDS)
    theirs, at, want = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text, _ in sorted(rows, key=in_file):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, with_crc(read_tokens(spark, path)).collect()), key=str) == sorted(want, key=str)
    some = [r[0] for r in rows[:5]] + [6002, 777_777]
    assert sorted(map(tuple, with_crc(read_selected(spark, path, some)).collect()), key=str) == sorted((w for w in want if w[0] in some), key=str)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)  # several files a task: starts do not hang on files or their names
    try:
        write_tokens(df, f"{path}-split", WORDS)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(map(tuple, with_crc(read_tokens(spark, f"{path}-split")).collect()), key=str) == sorted(want, key=str)
    empty = f"file://{tmp_path}/none"
    write_tokens(df.limit(0), empty, WORDS)
    assert read_tokens(spark, empty).count() == 0


def test_files_have_ascending_ids_page_indexes_and_compact_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(3000).selectExpr("3000 - id AS doc_id", "concat('word ', id % 7) AS text")
    write_tokens(df, f"file://{tmp_path}/t", WORDS)
    last = -1
    for f in sorted(glob.glob(f"{tmp_path}/t/part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_column_index and column.has_offset_index
                assert set(column.encodings) & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"}


def test_other_vocabularies_are_encoded_text_by_text(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert load(WORDS).by_words and not load(path).by_words
    df = spark.createDataFrame([(1, " Two  Words\n"), (2, "x")], "doc_id long, text string")
    write_tokens(df, f"file://{tmp_path}/t", path, end_id=7)
    theirs = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["tokens"] for r in read_tokens(spark, f"file://{tmp_path}/t").collect()} == {i: [*theirs.encode(t).ids, 7] for i, t in ((1, " Two  Words\n"), (2, "x"))}


def scanned(df):
    """Rows that the scan with a filter gave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan

    def walk(p):
        if p.getClass().getSimpleName() == "FileSourceScanExec" and p.dataFilters().size():
            found.append(p.metrics().apply("numOutputRows").value())
        for c in ([p.plan()] if hasattr(p, "plan") and "QueryStage" in p.getClass().getSimpleName() else [p.children().apply(i) for i in range(p.children().size())]):
            walk(c)

    walk(plan)
    return found[0]


def test_a_read_of_some_ids_leaves_other_pages_out(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id AS doc_id", "concat('word ', id % 7) AS text")
    write_tokens(df, f"file://{tmp_path}/t", WORDS)
    chosen = read_selected(spark, f"file://{tmp_path}/t", [5, 40_000])
    assert chosen.count() == 2 and scanned(chosen) < 45_000  # pages of 20,000 rows at most
