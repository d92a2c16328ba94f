import random
import re

from pyspark.sql import functions as F

from docgraph.config import EngineConfig
from docgraph.operators import chunking


def greedy(units, budget, joiner=" ", oversized=None, overlap=0):
    """An independent restatement of the packing rule."""
    done, buf = [], ""
    for u in units:
        if oversized and len(u) > budget:
            done += [buf] * bool(buf) + oversized(u)
            buf = ""
        elif not buf:
            buf = u
        elif len(buf) + len(joiner) + len(u) <= budget:
            buf += joiner + u
        else:
            done.append(buf)
            buf = (buf[-overlap:] + joiner + u).strip() if overlap else u
    return done + [buf] * bool(buf)


def sentences(t):
    return re.split(r"(?<=[.!?])\s+", t)


def texts():
    rng = random.Random(1)
    out = ["", " ", "One.", "a b. c! d? e", "word " * 500, "x" * 700 + " y. z", "A.\n---\nB b.\n---\n\n---\n" + "w " * 200, "p one.\n\n \n\np two.\n\n\n" + "long. " * 500 + "\n\nend", "😀 smile. " * 60]
    for _ in range(40):
        out.append("".join(rng.choice(["alpha ", "be. ", "ga! ", "\n\n", "\n", "dddddddddd ", "e" * rng.randint(1, 320) + " ", "\n---\n"]) for _ in range(rng.randint(1, 120))))
    return out


def collect(spark, column):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {r[0]: r[1] for r in df.select("id", column(F.col("text")).alias("p")).collect()}
    return [(t, got[i]) for i, t in enumerate(rows)]


def test_sentences_packed(spark):
    for t, got in collect(spark, lambda c: chunking.split_long(c, 200)):
        assert got == greedy(sentences(t), 200)


def test_words_packed(spark):
    for t, got in collect(spark, lambda c: chunking.hard_split(c, 60)):
        assert got == greedy(t.split(), 60)


def test_paragraphs_with_overlap(spark):
    for t, got in collect(spark, lambda c: chunking.pack_paragraphs(c, 400, 50)):
        paras = [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
        assert got == greedy(paras, 400, "\n\n", lambda p: greedy(sentences(p), 400), 50)


def test_paragraphs_without_overlap(spark):
    for t, got in collect(spark, lambda c: chunking.pack_paragraphs(c, 400, 0)):
        paras = [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
        assert got == greedy(paras, 400, "\n\n", lambda p: greedy(sentences(p), 400))


def test_children(spark):
    for t, got in collect(spark, lambda c: chunking.make_children(c, 300)):
        units = t.split("\n---\n") if "\n---\n" in t else sentences(t)
        units = [u.strip() for u in units if u.strip()]
        assert got == greedy(units, 300, oversized=lambda u: greedy(u.split(), 300))
        assert all(len(c) <= 300 or " " not in c for c in got)


def test_records(spark):
    records = ["a" * 10, "  ", "b" * 30, "c" * 90, "", "d" * 20, "e"]
    df = spark.createDataFrame([(records,)], "r array<string>")
    got = df.select(chunking.pack_records(F.col("r"), 60)).first()[0]
    assert got == ["a" * 10 + "\n---\n" + "b" * 30, "c" * 90, "d" * 20 + "\n---\ne"]


def test_chunks_are_numbered_densely_after_the_filter(spark):
    df = spark.createDataFrame([("d", ["short", "  long enough ", "x", "also long"])], "doc_id string, p array<string>")
    rows = chunking.make_chunks(df, F.col("p"), F.lit(6)).orderBy("seq").collect()
    assert [(r["chunk_id"], r["text"]) for r in rows] == [("d:0", "long enough"), ("d:1", "also long")]


def test_contextualized(spark):
    df = spark.createDataFrame([("kid", "a  b\nc" + " z" * 100, "src")], "c string, p string, s string")
    assert df.select(chunking.contextualized(F.col("c"), F.col("p"), F.col("s"), 8)).first()[0] == "src | a b c z\nkid"


def test_defaults_and_environment():
    assert EngineConfig.from_env({}).max_chunk_chars == 2000
    assert EngineConfig.from_env({"KG_MAX_CHUNK_CHARS": "50"}).max_chunk_chars == 50
