"""The engine's functions for SQL: the patterns and budgets of the expressions, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import EngineConfig
from .normalize import CASE_EDGE, LABEL_GAP, PREDICATE_GAP, SUFFIX, decomposed
from .text import EDGES, PARAGRAPH_GAP, SENTENCE_GAP, WS

FUNCTIONS = ["normalize_label", "normalize_predicate", "fold_name", "normalize_name", "entity_id", "cosine_score", "chunk_document", "make_children"]


def raw(pattern: str) -> str:
    return f'r"{pattern}"'


def strip(x: str) -> str:
    return f"regexp_replace({x}, {raw(EDGES)}, '')"


def words(x: str) -> str:
    return f"filter(split({x}, {raw(f'(?U){WS}+')}), t -> t <> '')"


def folded(units: str, budget: int, joiner: str = "' '", oversized: str = "", overlap: int = 0, s: str = "s", u: str = "u") -> str:
    """``operators.chunking.pack`` as SQL: ``oversized`` gives the pieces of a unit beyond the budget; ``s`` and ``u`` name state and unit."""
    state = lambda done, open_: f"CAST(named_struct('done', {done}, 'open', {open_}) AS struct<done:array<string>,open:string>)"
    fresh = strip(f"concat(right({s}.open, {overlap}), {joiner}, {u})") if overlap else u
    flushed = f"CASE WHEN {s}.open = '' THEN {s}.done ELSE array_append({s}.done, {s}.open) END"
    long = f"WHEN length({u}) > {budget} THEN {state(f'concat({flushed}, {oversized})', repr(''))}" if oversized else ""
    return f"""aggregate({units}, {state("array()", "''")}, ({s}, {u}) -> CASE {long} WHEN {s}.open = '' THEN {state(f"{s}.done", u)}
      WHEN length({s}.open) + length({joiner}) + length({u}) <= {budget} THEN {state(f"{s}.done", f"concat({s}.open, {joiner}, {u})")}
      ELSE {state(f"array_append({s}.done, {s}.open)", fresh)} END, {s} -> {flushed})"""


def register(spark: SparkSession, config: EngineConfig | None = None) -> None:
    """Temporary functions ``FUNCTIONS`` of this session; chunk sizes are those of ``config``."""
    c = config or EngineConfig()
    spark.udf.register("fold_name", decomposed)
    long = folded(f"split(u, {raw(SENTENCE_GAP)})", c.max_chunk_chars, s="i", u="v")
    paragraphs = f"filter(transform(split(x, {raw(PARAGRAPH_GAP)}), p -> {strip('p')}), p -> p <> '')"
    packed = folded(paragraphs, c.max_chunk_chars, "'\\n\\n'", long, c.chunk_overlap)
    units = f"filter(transform(CASE WHEN contains(x, '\\n---\\n') THEN split(x, '\\n---\\n') ELSE split(x, {raw(SENTENCE_GAP)}) END, p -> {strip('p')}), p -> p <> '')"
    pieces = folded(words("u"), c.child_chunk_chars, s="i", u="v")
    name = f"trim(regexp_replace(lower(fold_name(x)), '[^a-z0-9]+', ' '))"
    norm = lambda v: f"sqrt(aggregate({v}, 0D, (s, e) -> s + CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))"
    product = f"{norm('a')} * {norm('b')}"
    bodies = {
        "normalize_label(x STRING) RETURNS STRING": f"CASE WHEN {strip('x')} = '' THEN 'Entity' ELSE array_join(transform(filter(split({strip('x')}, {raw(LABEL_GAP)}), p -> p <> ''), p -> initcap(p)), '') END",
        "normalize_predicate(x STRING) RETURNS STRING": f"CASE WHEN {strip('x')} = '' THEN 'RELATED_TO' ELSE upper(regexp_replace(regexp_replace({strip('x')}, {raw(CASE_EDGE)}, '_'), {raw(PREDICATE_GAP)}, '_')) END",
        "normalize_name(x STRING) RETURNS STRING": rf"regexp_replace(trim(regexp_replace({name}, {raw(SUFFIX)}, '')), {raw(chr(92) + 's+')}, ' ')",
        "entity_id(type STRING, name STRING) RETURNS STRING": "left(sha1(concat(type, '|', normalize_name(name))), 24)",
        "cosine_score(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": f"CASE WHEN size(a) = size(b) AND {product} > 0 THEN (1 + aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, e) -> s + e) / ({product})) / 2 END",
        "chunk_document(x STRING) RETURNS ARRAY<STRING>": f"filter(transform({packed}, p -> {strip('p')}), p -> length(p) >= {c.min_chunk_chars})",
        "make_children(x STRING) RETURNS ARRAY<STRING>": folded(units, c.child_chunk_chars, oversized=pieces),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
