"""Triples from chunks: model answers to normalised, identified rows, with counters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize
from ..functions.text import strip
from ..providers import Extractor

FIELDS = ("subject", "subject_type", "predicate", "object", "object_type")
ANSWERS = "chunk_id string, answer string, error string, input_tokens long, cache_read_tokens long, output_tokens long"
RAW = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def ask(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """One answer per chunk; a failing chunk is a row with an error, never a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk_id, text in zip(batch["chunk_id"], batch["text"], strict=True):
                try:
                    answer, used = extractor.extract(text)
                    rows.append((chunk_id, answer, None, *(int(used.get(k, 0)) for k in ("input_tokens", "cache_read_tokens", "output_tokens"))))
                except Exception as e:  # a provider may raise anything
                    rows.append((chunk_id, None, f"{type(e).__name__}: {e}", 0, 0, 0))
            yield pd.DataFrame(rows, columns=["chunk_id", "answer", "error", "input_tokens", "cache_read_tokens", "output_tokens"])

    return chunks.select("chunk_id", "text").mapInPandas(run, ANSWERS)


def strict_triples(answer: str | None) -> str | None:
    """The triples of a well-formed answer as JSON, or null: one triple of wrong form voids the answer."""
    try:
        triples = json.loads(answer or "")["triples"]
        rows = [[t[f] for f in FIELDS] for t in triples]
    except (ValueError, TypeError, KeyError):
        return None
    if not isinstance(triples, list) or any(not isinstance(v, str) for r in rows for v in r):
        return None
    return json.dumps([dict(zip(FIELDS, r, strict=True)) for r in rows])


@F.pandas_udf(T.StringType())
def _strict(answers: pd.Series) -> pd.Series:
    return answers.map(strict_triples)


def parse(answers: DataFrame) -> DataFrame:
    """answers + raw (array of the five strings), parse_error."""
    valid = answers.withColumn("json", _strict(F.col("answer")))
    raw = F.coalesce(F.from_json("json", RAW), F.array().cast(RAW))
    bad = F.col("json").isNull() & F.col("answer").isNotNull() & (F.col("answer") != "")
    return valid.withColumn("raw", raw).withColumn("parse_error", bad).drop("json")


def triples(parsed: DataFrame) -> DataFrame:
    """One row per kept triple, in the order of its answer (seq); blank names are dropped."""
    t = parsed.select("chunk_id", F.posexplode("raw").alias("seq", "t")).select(
        "chunk_id",
        "seq",
        strip(F.col("t.subject")).alias("subject_name"),
        normalize.label(F.col("t.subject_type")).alias("subject_type"),
        normalize.predicate(F.col("t.predicate")).alias("predicate"),
        strip(F.col("t.object")).alias("object_name"),
        normalize.label(F.col("t.object_type")).alias("object_type"),
    )
    return identified(t.where((F.col("subject_name") != "") & (F.col("object_name") != "")))


def identified(named: DataFrame) -> DataFrame:
    """Adds subject_id and object_id. Names are folded once each: there are far fewer of them than triples.

    Only names that are not ASCII pass through Python.
    """
    ends = F.array(*[F.struct(F.col(f"{s}_type").alias("type"), F.col(f"{s}_name").alias("name")) for s in ("subject", "object")])
    names = named.select(F.explode(ends).alias("e")).select("e.*").distinct()
    plain = ~F.col("name").rlike(r"[^\x00-\x7F]")
    ident = lambda folded: normalize.entity_id(F.col("type"), F.col("name"), folded).alias("id")
    ids = names.where(plain).select("type", "name", ident(True)).unionAll(names.where(~plain).select("type", "name", ident(False)))
    out = named
    for s in ("subject", "object"):
        of = ids.select(F.col("type").alias(f"{s}_type"), F.col("name").alias(f"{s}_name"), F.col("id").alias(f"{s}_id"))
        out = out.join(of, [f"{s}_type", f"{s}_name"])
    return out.select(*named.columns, "subject_id", "object_id")


def counters(parsed: DataFrame) -> DataFrame:
    """One row: chunks, triples returned, kept and dropped, parse errors, failed chunks, tokens."""
    blank = lambda t: (strip(t["subject"]) == "") | (strip(t["object"]) == "")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    dropped = F.size(F.filter("raw", blank))
    return parsed.agg(
        F.count("*").alias("chunks_seen"),
        F.count("*").alias("chunks_called"),
        total(F.size("raw"), "triples_returned"),
        total(F.size("raw") - dropped, "triples_kept"),
        total(dropped, "triples_dropped"),
        total(F.col("parse_error").cast("int"), "parse_errors"),
        total(F.col("error").isNotNull().cast("int"), "chunks_failed"),
        *[total(F.col(c), c) for c in ("input_tokens", "cache_read_tokens", "output_tokens")],
    )
