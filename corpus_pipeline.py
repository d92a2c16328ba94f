"""A training corpus from ``documents``: quality filter, exact and near dedup, source mix, token ids.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``; the last
gives the token ids themselves, beside their digests. Rows with a null text count as empty; every row is judged on its
own, whatever its id: of rows that repeat an id and a text one stays, null ids come last; rows that repeat an id share
their draw in the mix; an empty table passes through every stage; columns beyond those named ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgraph.llm.bpe import encode_documents
from docgraph.llm.cnn_quality import keep_good, train
from docgraph.llm.common import table, written
from docgraph.llm.exact_dedup import keep_first
from docgraph.llm.jaccard_join import keep_one
from docgraph.llm.mixing import mixed
from docgraph.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True, with_decoded=False)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

#: The classifier and the tokenizer have no SQL form; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
