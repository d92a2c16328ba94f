"""The engine's registered queries over the driver tables, each with equivalent SQL where SQL can say it.

Stand-ins: ``embeddings`` are children (parent = vec_id div 4), ``documents`` are parents and prose sources, and a graph
of triples is derived from nation, region, customer, supplier, part and lineitem.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize
from ..functions.text import preview, sentences
from ..functions.vectors import cosine_score
from ..operators import chunking, extract, graph, search
from ..sources.readers import record_text
from ..shared import written
from ..store import TABLES, last_wins, upsert_children, upsert_edges, upsert_entities, upsert_mentions, upsert_provenance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL pieces ---------------------------------------------------------------

SENTENCES = r"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
WORDS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


def fold(units: str, budget: int, joiner: str = "' '", long: str | None = None, overlap: int = 0) -> str:
    """The greedy fold as a list_reduce over states {p: done, b: buffer}; ``long`` names the pieces of an oversized ``e.b``."""
    size = 2 if "chr(10)" in joiner else 1
    fresh = rf"regexp_replace(right(a.b, {overlap}) || {joiner} || e.b, '^\s+|\s+$', '', 'g')" if overlap else "e.b"
    first = f"WHEN length(e.b) > {budget} THEN {{'p': list_concat(CASE WHEN a.b = '' THEN a.p ELSE list_append(a.p, a.b) END, {long}), 'b': ''}}" if long else ""
    step = f"""CASE {first} WHEN a.b = '' THEN {{'p': a.p, 'b': e.b}}
      WHEN length(a.b) + {size} + length(e.b) <= {budget} THEN {{'p': a.p, 'b': a.b || {joiner} || e.b}}
      ELSE {{'p': list_append(a.p, a.b), 'b': {fresh}}} END"""
    states = f"list_concat([{{'p': []::VARCHAR[], 'b': ''}}], list_transform({units}, lambda u: {{'p': []::VARCHAR[], 'b': u}}))"
    return f"list_reduce({states}, lambda a, e: {step})"


CLOSED = "CASE WHEN s.b = '' THEN s.p ELSE list_append(s.p, s.b) END"

TRIPLES = """
  SELECT 'Nation' AS subject_type, n_name AS subject_name, 'LOCATED_IN' AS predicate, 'Region' AS object_type, r_name AS object_name,
         concat('nation:', n_nationkey) AS chunk_id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Customer', c_name, 'BASED_IN', 'Nation', n_name, concat('customer:', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier', s_name, 'BASED_IN', 'Nation', n_name, concat('supplier:', s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier', s_name, 'SUPPLIES', 'Part', p_name, concat('order:', l_orderkey)
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""
SUFFIX = r"\b(inc|llc|ltd|limited|corp|corporation|co|plc|gmbh|sa|nv|ag)\b"


def name_sql(c: str) -> str:
    plain = rf"trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    return rf"regexp_replace(trim(regexp_replace({plain}, '{SUFFIX}', '', 'g')), '\s+', ' ', 'g')"


def id_sql(type_: str, name: str) -> str:
    return f"left(sha1({type_} || '|' || {name_sql(name)}), 24)"


GRAPH = f"""
t AS (SELECT *, {id_sql("subject_type", "subject_name")} AS s_id, {id_sql("object_type", "object_name")} AS o_id FROM ({TRIPLES})),
ends AS (SELECT s_id AS entity_id, subject_name AS name, subject_type AS type, chunk_id, 0 AS side FROM t UNION ALL SELECT o_id, object_name, object_type, chunk_id, 1 FROM t),
entities AS (SELECT entity_id, arg_min(name, concat_ws('|', name)) AS name, arg_min(type, type) AS type FROM ends GROUP BY entity_id),
edges AS (SELECT s_id AS src_id, predicate, o_id AS dst_id, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM t GROUP BY ALL),
mentions AS (SELECT DISTINCT chunk_id, entity_id FROM ends),
both_ways AS (SELECT src_id AS entity_id, dst_id AS other_id, src_id, predicate, dst_id FROM edges UNION ALL SELECT dst_id, src_id, src_id, predicate, dst_id FROM edges WHERE src_id <> dst_id),
facts AS (SELECT s.name AS source, e.predicate AS relationship, o.name AS target FROM edges e JOIN entities s ON s.entity_id = e.src_id JOIN entities o ON o.entity_id = e.dst_id)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived triples with ids; the tables are named in the SQL, so no session view is touched."""
    sql = TRIPLES
    for t in ("nation", "region", "customer", "supplier", "lineitem", "part"):
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t} ", f"{word} parquet.`{sf_dir}/{t}.parquet` ")
        if sql.endswith(f" {t}"):
            sql += " "
    return extract.identified(spark.sql(sql).withColumn("seq", F.lit(0)))


class Graph:
    """The derived graph, through the store's own upsert policies; the triples are made once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._none = lambda s: spark.createDataFrame([], TABLES[s])
        self._clock = F.lit("2020-01-01").cast("timestamp")
        self.triples = written(triples(spark, sf_dir), "triples")

    @cached_property
    def entities(self) -> DataFrame:
        return upsert_entities(self._none("entities"), self.triples, self._clock).drop("created_at")

    @cached_property
    def edges(self) -> DataFrame:
        return upsert_edges(self._none("edges"), self.triples, self._clock).drop("created_at")

    @cached_property
    def provenance(self) -> DataFrame:
        return upsert_provenance(self._none("provenance"), self.triples)

    @cached_property
    def mentions(self) -> DataFrame:
        return upsert_mentions(self._none("mentions"), self.triples, self.triples.select("chunk_id").distinct())


# --- search -------------------------------------------------------------------


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def children_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("child_id"), F.expr("vec_id div 4").alias("chunk_id"), "embedding")


HITS = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
h AS (SELECT vec_id AS child_id, vec_id // 4 AS chunk_id, (1 + list_cosine_similarity(embedding::DOUBLE[], q.v)) / 2 AS score FROM embeddings, q ORDER BY score DESC, child_id LIMIT 30),
p AS (SELECT chunk_id, max(score) AS score, count(*) AS matched_children, max(score) + 0.02 * (count(*) - 1) AS rank FROM h GROUP BY chunk_id ORDER BY rank DESC, chunk_id LIMIT 5)"""


@query(f"WITH {HITS} SELECT child_id, chunk_id, round(score, 6) AS score FROM h")
def vector_topk_children(spark, sf_dir):
    hits = search.top_children(children_table(spark, sf_dir), query_vector(spark, sf_dir), 30)
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {HITS} SELECT chunk_id, round(score, 6) AS score, matched_children, round(rank, 6) AS rank FROM p")
def search_parents(spark, sf_dir):
    hits = search.top_children(children_table(spark, sf_dir), query_vector(spark, sf_dir), 30)
    return search.top_parents(hits, 5).select("chunk_id", F.round("score", 6).alias("score"), "matched_children", F.round("rank", 6).alias("rank"))


@query(f"""WITH {HITS} SELECT p.chunk_id, d.text, s.source, round(p.score, 6) AS score, p.matched_children FROM p JOIN documents d ON d.doc_id = p.chunk_id
  LEFT JOIN documents s ON s.doc_id = p.chunk_id""")
def search_with_source(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    sources = docs.select("doc_id", F.col("source").alias("source_uri"))
    found = search.passages(children_table(spark, sf_dir), chunks, sources, query_vector(spark, sf_dir), 30, 5)
    return found.select("chunk_id", "text", "source", F.round("score", 6).alias("score"), "matched_children")


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    b = e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("v"))
    return e.join(b, F.col("right_id") == F.col("vec_id") + 1).select(F.col("vec_id").alias("left_id"), "right_id", F.round(cosine_score(F.col("embedding"), F.col("v")), 6).alias("score"))


# --- chunking -----------------------------------------------------------------


def rows_of(docs: DataFrame, pieces, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key), F.posexplode(pieces).alias("seq", "text")).select(key, "seq", F.length("text").alias("chars"), F.sha1(F.col("text").cast("binary")).alias("content_hash"))


def rows_sql(state: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"""WITH f AS (SELECT {key}, {state} AS s FROM {source}), l AS (SELECT {key}, {CLOSED} AS parts FROM f),
u AS (SELECT {key}, unnest(parts) AS text, unnest(range(len(parts)))::INTEGER AS seq FROM l)
SELECT {key}, seq, length(text)::INTEGER AS chars, sha1(text) AS content_hash FROM u"""


@query(f"WITH s AS (SELECT doc_id, {SENTENCES.format(t='text')} AS parts FROM documents) SELECT doc_id, len(parts)::INTEGER AS sentences, sha1(array_to_string(parts, '|')) AS hash FROM s")
def sentence_split(spark, sf_dir):
    parts = sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("sentences"), F.sha1(F.array_join(parts, "|").cast("binary")).alias("hash"))


@query(rows_sql(fold(SENTENCES.format(t="text"), 2000)))
def split_long_chunks(spark, sf_dir):
    return rows_of(read(spark, sf_dir, "documents"), chunking.split_long(F.col("text"), 2000))


@query(rows_sql(fold(WORDS.format(t="text"), 300)))
def hard_split_words(spark, sf_dir):
    return rows_of(read(spark, sf_dir, "documents"), chunking.hard_split(F.col("text"), 300))




def _inner(units: str, budget: int) -> str:
    """A nested fold over an oversized unit ``e.b``, with names of its own."""
    states = f"list_concat([{{'p': []::VARCHAR[], 'b': ''}}], list_transform({units}, lambda v: {{'p': []::VARCHAR[], 'b': v}}))"
    step = f"CASE WHEN x.b = '' THEN {{'p': x.p, 'b': y.b}} WHEN length(x.b) + 1 + length(y.b) <= {budget} THEN {{'p': x.p, 'b': x.b || ' ' || y.b}} ELSE {{'p': list_append(x.p, x.b), 'b': y.b}} END"
    return f"list_transform([list_reduce({states}, lambda x, y: {step})], lambda s: {CLOSED})[1]"


_PARAGRAPHS = r"list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda g: regexp_replace(g, '^\s+|\s+$', '', 'g')), lambda g: g <> '')"


@query(rows_sql(fold(_PARAGRAPHS, 2000, "chr(10) || chr(10)", _inner(SENTENCES.format(t="e.b"), 2000), 200)))
def pack_paragraphs(spark, sf_dir):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return rows_of(read(spark, sf_dir, "documents"), chunking.pack_paragraphs(text, 2000, 200))


_UNITS = rf"list_filter(list_transform(CASE WHEN contains(text, chr(10) || '---' || chr(10)) THEN string_split(text, chr(10) || '---' || chr(10)) ELSE {SENTENCES.format(t='text')} END, lambda g: regexp_replace(g, '^\s+|\s+$', '', 'g')), lambda g: g <> '')"


@query(rows_sql(fold(_UNITS, 300, long=_inner(WORDS.format(t="e.b"), 300))))
def make_children(spark, sf_dir):
    return rows_of(read(spark, sf_dir, "documents"), chunking.make_children(F.col("text"), 300))


@query(r"""
WITH r AS (SELECT conv_id, list(regexp_replace('role: ' || role || CASE WHEN text = '' THEN '' ELSE chr(10) || 'text: ' || text END, '^\s+|\s+$', '', 'g') ORDER BY turn) AS units FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_concat([{'p': []::VARCHAR[], 'o': []::VARCHAR[], 'n': 0}], list_transform(units, lambda u: {'p': []::VARCHAR[], 'o': [u], 'n': length(u)::INTEGER + 5})), lambda a, e:
  CASE WHEN len(a.o) > 0 AND a.n + e.n > 2000 THEN {'p': list_append(a.p, array_to_string(a.o, chr(10) || '---' || chr(10))), 'o': e.o, 'n': e.n} ELSE {'p': a.p, 'o': list_concat(a.o, e.o), 'n': a.n + e.n} END) AS s FROM r),
l AS (SELECT conv_id, CASE WHEN len(s.o) = 0 THEN s.p ELSE list_append(s.p, array_to_string(s.o, chr(10) || '---' || chr(10))) END AS parts FROM f),
u AS (SELECT conv_id, unnest(parts) AS text, unnest(range(len(parts)))::INTEGER AS seq FROM l)
SELECT conv_id, seq, length(text)::INTEGER AS chars, sha1(text) AS content_hash FROM u""")
def pack_records(spark, sf_dir):
    record = F.concat(F.lit("role: "), F.col("role"), F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("\ntext: "), F.col("text"))))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))), lambda x: x["r"])
    convs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("records"))
    return rows_of(convs, chunking.pack_records(F.col("records"), 2000), "conv_id")


def _chunks(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.make_chunks(docs, chunking.pack_paragraphs(F.col("text"), 2000, 200), F.lit(120))


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""
WITH f AS (SELECT doc_id, CASE WHEN length({_STRIPPED}) > 2000 THEN {{'p': {_inner(SENTENCES.format(t="e.b"), 2000).replace("e.b", "(" + _STRIPPED + ")")}, 'b': ''}} ELSE {{'p': []::VARCHAR[], 'b': {_STRIPPED}}} END AS s FROM documents),
l AS (SELECT doc_id, list_filter(list_transform({CLOSED}, lambda g: regexp_replace(g, '^\s+|\s+$', '', 'g')), lambda g: length(g) >= 120) AS parts FROM f)
SELECT doc_id::VARCHAR AS doc_id, len(parts) AS chunks, list_sum(list_transform(parts, lambda g: length(g)))::BIGINT AS chars, sha1(array_to_string(list_transform(parts, lambda g: sha1(g)), '')) AS content_hash FROM l WHERE len(parts) > 0""")
def chunk_stats(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content_hash"))), lambda x: x["content_hash"])
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.sha1(F.array_join(ordered, "").cast("binary")).alias("content_hash"))


_CHILDREN = fold(_UNITS, 300, long=_inner(WORDS.format(t="e.b"), 300))


@query(rf"""WITH f AS (SELECT doc_id, text, source, {_CHILDREN} AS s FROM documents), l AS (SELECT doc_id, text, source, {CLOSED} AS parts FROM f),
u AS (SELECT doc_id, source, text, unnest(parts) AS child, unnest(range(len(parts)))::INTEGER AS seq FROM l)
SELECT doc_id, seq, sha1(source || ' | ' || array_to_string(list_filter(regexp_split_to_array(left(text, 160), '\s+'), lambda w: w <> ''), ' ') || chr(10) || child) AS asked FROM u""")
def contextualize_child(spark, sf_dir):
    kids = read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.posexplode(chunking.make_children(F.col("text"), 300)).alias("seq", "child"))
    return kids.select("doc_id", "seq", F.sha1(chunking.contextualized(F.col("child"), F.col("text"), F.col("source"), 160).cast("binary")).alias("asked"))


@query("SELECT doc_id, left(replace(text, chr(10), ' '), 110) AS preview FROM documents")
def passage_preview(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), 110).alias("preview"))


# --- normalisation and extraction -----------------------------------------------


@query(f"""
WITH n AS (SELECT 'Part' AS type, p_name AS name FROM part UNION SELECT 'Customer', c_name FROM customer UNION SELECT 'Supplier', s_name FROM supplier
  UNION SELECT 'Word', unnest(string_split(regexp_replace(text, '[^\\S ]', ' ', 'g'), ' ')) FROM documents)
SELECT type, name, {id_sql("type", "name")} AS entity_id FROM n WHERE name <> ''""")
def entity_ids(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.lit("Word").alias("type"), F.explode(F.split(F.regexp_replace("text", r"[^\S ]", " "), " ")).alias("name"))
    named = [(t, f"{t[0].lower()}_name") for t in ("Part", "Customer", "Supplier")]
    all_ = words
    for t, c in named:
        all_ = all_.unionAll(read(spark, sf_dir, t.lower()).select(F.lit(t), c))
    n = all_.where(F.col("name") != "").select("type", "name").distinct()
    plain = ~F.col("name").rlike(r"[^\x00-\x7F]")  # the others alone pass through Python
    ident = lambda folded: normalize.entity_id(F.col("type"), F.col("name"), folded).alias("entity_id")
    return n.where(plain).select("type", "name", ident(True)).unionAll(n.where(~plain).select("type", "name", ident(False)))


@query("""
WITH v AS (SELECT DISTINCT p_type AS value FROM part UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT event_type FROM events)
SELECT value, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(value), '[\\s_]+'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(p[2:])), '') AS label FROM v""")
def normalize_labels(spark, sf_dir):
    return _values(spark, sf_dir).select("value", normalize.label(F.col("value")).alias("label"))


@query("""
WITH v AS (SELECT DISTINCT p_type AS value FROM part UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT event_type FROM events)
SELECT value, upper(regexp_replace(regexp_replace(trim(value), '([a-z])([A-Z])', '\\1_\\2', 'g'), '[\\s\\-]+', '_', 'g')) AS predicate FROM v""")
def normalize_predicates(spark, sf_dir):
    return _values(spark, sf_dir).select("value", normalize.predicate(F.col("value")).alias("predicate"))


def _values(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_type").alias("value")).union(read(spark, sf_dir, "orders").select("o_orderpriority")).union(read(spark, sf_dir, "events").select("event_type")).distinct()


for _n in ("normalize_labels", "normalize_predicates"):
    ORACLE[_n] = ORACLE[_n].replace("\\\\", "\\")

#: Answers of a model, one per nation: well-formed, empty, of wrong form, not JSON, with a blank name.
_ANSWER = """CASE n_nationkey % 6
  WHEN 0 THEN concat('{"triples": [{"subject": "', n_name, '", "subject_type": "nation state", "predicate": "locatedIn", "object": "', r_name, '", "object_type": "world region"}]}')
  WHEN 1 THEN '{"triples": []}'
  WHEN 2 THEN concat('{"triples": [{"subject": "', n_name, '", "subject_type": "nation", "predicate": 7, "object": "x", "object_type": "y"}]}')
  WHEN 3 THEN concat('{"triples": [{"subject": "', n_name)
  WHEN 4 THEN concat('{"triples": [{"subject": " ", "subject_type": "", "predicate": "", "object": "x", "object_type": "y"}, {"subject": "', n_name, '", "subject_type": "", "predicate": "", "object": "x", "object_type": "y_z"}]}')
  ELSE concat('{"triples": [{"subject": "', n_name, '", "subject_type": "nation", "predicate": "a - b", "object": "x"}]}') END"""


def _parsed(spark, sf_dir) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("nation:"), "n_nationkey").alias("chunk_id"), F.expr(_ANSWER).alias("answer"))
    return extract.parse(rows.withColumn("error", F.lit(None).cast("string")).select("*", *[F.lit(0).cast("long").alias(c) for c in ("input_tokens", "cache_read_tokens", "output_tokens")]))


_PARSED = f"""
a AS (SELECT n_nationkey % 6 AS kind, concat('nation:', n_nationkey) AS chunk_id, {_ANSWER} AS answer FROM nation JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT chunk_id, kind, CASE WHEN json_valid(answer) THEN answer::JSON END AS doc FROM a),
ok AS (SELECT chunk_id, from_json(doc->'$.triples', '["JSON"]') AS ts FROM j WHERE doc IS NOT NULL),
x AS (SELECT chunk_id, unnest(ts) AS t, unnest(range(len(ts)))::INTEGER AS seq FROM ok WHERE len(list_filter(ts, lambda t: NOT coalesce(
  json_type(t, '$.subject') = 'VARCHAR' AND json_type(t, '$.subject_type') = 'VARCHAR' AND json_type(t, '$.predicate') = 'VARCHAR' AND json_type(t, '$.object') = 'VARCHAR' AND json_type(t, '$.object_type') = 'VARCHAR', false))) = 0),
k AS (SELECT chunk_id, seq, trim(t->>'$.subject') AS subject_name, trim(t->>'$.subject_type') AS st, trim(t->>'$.predicate') AS p, trim(t->>'$.object') AS object_name, trim(t->>'$.object_type') AS ot FROM x)"""
_LABEL = r"CASE WHEN {c} = '' THEN 'Entity' ELSE array_to_string(list_transform(list_filter(regexp_split_to_array({c}, '[\s_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '') END"


@query(
    rf"""WITH {_PARSED}, m AS (SELECT chunk_id, seq, subject_name, {_LABEL.format(c="st")} AS subject_type,
  CASE WHEN p = '' THEN 'RELATED_TO' ELSE upper(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\1_\2', 'g'), '[\s\-]+', '_', 'g')) END AS predicate, object_name, {_LABEL.format(c="ot")} AS object_type
  FROM k WHERE subject_name <> '' AND object_name <> '')
SELECT *, {id_sql("subject_type", "subject_name")} AS subject_id, {id_sql("object_type", "object_name")} AS object_id FROM m"""
)
def parse_extractions(spark, sf_dir):
    return extract.triples(_parsed(spark, sf_dir))


@query(f"""WITH {_PARSED} SELECT (SELECT count(*) FROM a) AS chunks_seen, (SELECT count(*) FROM k) AS triples_returned, (SELECT count(*) FROM k WHERE subject_name <> '' AND object_name <> '') AS triples_kept,
  (SELECT count(*) FROM k WHERE subject_name = '' OR object_name = '') AS triples_dropped, (SELECT count(*) FROM a WHERE kind IN (2, 3, 5)) AS parse_errors""")
def extraction_stats(spark, sf_dir):
    return extract.counters(_parsed(spark, sf_dir)).select("chunks_seen", "triples_returned", "triples_kept", "triples_dropped", "parse_errors")


# --- upserts ------------------------------------------------------------------


@query(f"WITH {GRAPH} SELECT entity_id, name, type FROM entities")
def upsert_entities_first_wins(spark, sf_dir):
    g = Graph(spark, sf_dir)
    again = upsert_entities(g.entities.withColumn("created_at", F.lit(None).cast("timestamp")), g.triples.withColumn("subject_name", F.upper("subject_name")), F.lit(None).cast("timestamp"))
    return again.select("entity_id", "name", "type")


@query(f"WITH {GRAPH} SELECT src_id, predicate, dst_id, len(chunk_ids)::INTEGER AS chunks, sha1(array_to_string(chunk_ids, ',')) AS provenance FROM edges")
def upsert_edges_provenance(spark, sf_dir):
    g = Graph(spark, sf_dir)
    again = upsert_provenance(g.provenance, g.triples)  # twice is once
    lists = again.groupBy("src_id", "predicate", "dst_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return lists.select("src_id", "predicate", "dst_id", F.size("chunk_ids").alias("chunks"), F.sha1(F.array_join("chunk_ids", ",").cast("binary")).alias("provenance"))


@query("""
WITH b AS (SELECT doc_id, source AS source_uri, sha1(text) AS content_hash, 0 AS ord FROM documents UNION ALL SELECT doc_id, upper(source), sha1(lower(text)), 1 FROM documents)
SELECT doc_id, arg_max(source_uri, ord) AS source_uri, arg_max(content_hash, ord) AS content_hash FROM b GROUP BY doc_id""")
def upsert_documents_last_wins(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    first = d.select("doc_id", F.col("source").alias("source_uri"), F.sha1(F.col("text").cast("binary")).alias("content_hash"))
    second = d.select("doc_id", F.upper("source").alias("source_uri"), F.sha1(F.lower("text").cast("binary")).alias("content_hash"))
    return last_wins(first, second, ["doc_id"])


@query("SELECT vec_id AS child_id, vec_id // 4 AS chunk_id, len(embedding)::INTEGER AS width FROM embeddings WHERE vec_id // 4 IN (SELECT doc_id FROM labels)")
def upsert_children_of_known_chunks(spark, sf_dir):
    kids = children_table(spark, sf_dir)
    chunks = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))  # only some documents have labels
    return upsert_children(kids.limit(0), kids, chunks).select("child_id", "chunk_id", F.size("embedding").alias("width"))


@query(f"WITH {GRAPH} SELECT chunk_id, entity_id FROM mentions WHERE chunk_id <> 'nation:0'")
def mentions_distinct(spark, sf_dir):
    t = triples(spark, sf_dir)
    chunks = t.select("chunk_id").distinct().where("chunk_id <> 'nation:0'")
    return upsert_mentions(spark.createDataFrame([], "chunk_id string, entity_id string"), t, chunks)


# --- graph --------------------------------------------------------------------


@query(f"""WITH {GRAPH} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT chunk_id) FROM t) AS chunks, (SELECT count(*) FROM embeddings) AS children,
  (SELECT count(embedding) FROM embeddings) AS embedded, (SELECT count(*) FROM entities) + 2 AS entities, (SELECT count(*) FROM edges) AS relationships, 2 AS orphans""")
def stats_summary(spark, sf_dir):
    g = Graph(spark, sf_dir)
    lone = spark.createDataFrame([("lone-1", "Lone One", "Entity"), ("lone-2", "Lone Two", "Entity")], "entity_id string, name string, type string")
    return graph.stats(read(spark, sf_dir, "documents"), g.triples.select("chunk_id").distinct(), children_table(spark, sf_dir), g.entities.unionByName(lone), g.edges, g.mentions)


@query(f"WITH {GRAPH} SELECT predicate AS relationship, count(*) AS count FROM edges GROUP BY predicate")
def edges_by_type(spark, sf_dir):
    return graph.by_type(Graph(spark, sf_dir).edges)


@query(f"WITH {GRAPH}, few AS (SELECT * FROM edges WHERE predicate = 'LOCATED_IN') SELECT entity_id, name FROM entities WHERE entity_id NOT IN (SELECT src_id FROM few UNION SELECT dst_id FROM few)")
def orphans(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.orphans(g.entities, g.edges.where("predicate = 'LOCATED_IN'"), g.mentions.limit(0)).select("entity_id", "name")


@query("""SELECT d.doc_id AS chunk_id, left(d.text, 40) AS head, s.source AS source FROM documents d LEFT JOIN documents s USING (doc_id)
  WHERE d.doc_id NOT IN (SELECT vec_id // 4 FROM embeddings)""")
def chunks_without_children(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    sources = d.select("doc_id", F.col("source").alias("source_uri"))
    return graph.chunks_without_children(chunks, children_table(spark, sf_dir), sources).select("chunk_id", F.left("text", F.lit(40)).alias("head"), "source")


_PAGE = """SELECT e.src_id, s.name AS source_name, s.type AS source_type, e.predicate, e.dst_id, o.name AS target_name, o.type AS target_type, len(e.chunk_ids)::INTEGER AS chunks
  FROM (SELECT * FROM edges {where} ORDER BY src_id, predicate, dst_id LIMIT {limit} OFFSET {skip}) e JOIN entities s ON s.entity_id = e.src_id JOIN entities o ON o.entity_id = e.dst_id"""


def _page(rows: DataFrame, g: Graph) -> DataFrame:
    return graph.with_chunks(rows, g.provenance).select("src_id", "source_name", "source_type", "predicate", "dst_id", "target_name", "target_type", F.size("chunk_ids").alias("chunks"))


@query(f"WITH {GRAPH} " + _PAGE.format(where="", limit=100, skip=50))
def graph_page(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _page(graph.page(g.edges, g.entities, 100, 50), g)


@query(f"WITH {GRAPH} " + _PAGE.format(where="WHERE src_id IN (SELECT entity_id FROM entities WHERE type = 'Supplier')", limit=60, skip=5))
def graph_page_by_type(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _page(graph.page(g.edges, g.entities, 60, 5, "Supplier"), g)


@query(f"WITH {GRAPH}, p AS ({_PAGE.format(where='', limit=100, skip=0)}) SELECT src_id AS id, source_name AS name, source_type AS type FROM p UNION SELECT dst_id, target_name, target_type FROM p")
def browse_nodes(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.nodes_of(graph.page(g.edges, g.entities))


@query(f"""WITH {GRAPH}, m AS (SELECT DISTINCT entity_id FROM mentions WHERE chunk_id IN ('nation:1', 'supplier:3', 'customer:7'))
SELECT DISTINCT s.name AS source, b.predicate AS relationship, o.name AS target FROM m JOIN both_ways b USING (entity_id) JOIN entities s ON s.entity_id = b.src_id JOIN entities o ON o.entity_id = b.dst_id ORDER BY 1, 2, 3 LIMIT 40""")
def expand_facts(spark, sf_dir):
    g = Graph(spark, sf_dir)
    ids = spark.createDataFrame([("nation:1",), ("supplier:3",), ("customer:7",)], "chunk_id string")
    return graph.expand(ids, g.mentions, g.edges, g.entities)




@query(f"""WITH {GRAPH}, named AS (SELECT entity_id, name FROM entities WHERE name IN (SELECT n_name FROM nation WHERE n_nationkey < 4)),
r AS (SELECT n.name, s.name AS source, b.predicate AS relationship, o.name AS target, row_number() OVER (PARTITION BY n.name ORDER BY s.name, b.predicate, o.name, b.src_id, b.dst_id) AS k
  FROM named n JOIN both_ways b USING (entity_id) JOIN entities s ON s.entity_id = b.src_id JOIN entities o ON o.entity_id = b.dst_id)
SELECT name, source, relationship, target FROM r WHERE k <= 15""")
def neighbors_of_name(spark, sf_dir):
    g = Graph(spark, sf_dir)
    names = [r[0] for r in read(spark, sf_dir, "nation").where("n_nationkey < 4").select("n_name").collect()]
    return graph.neighbours(g.edges, g.entities, names)


QUESTION = "Which Supplier#000000 parts are based in EUROPE, or in the nation of customer#00?"


@query(f"""WITH {GRAPH}, w AS (SELECT unnest({graph.question_terms(QUESTION)}) AS term, unnest(range({len(graph.question_terms(QUESTION))}))::INTEGER AS position),
r AS (SELECT w.term, w.position, e.name, e.type, row_number() OVER (PARTITION BY w.position ORDER BY e.name, e.entity_id) AS k FROM w JOIN entities e ON contains(lower(e.name), w.term))
SELECT term, position, name, type FROM r WHERE k <= 5""")
def entity_match_terms(spark, sf_dir):
    return graph.match_entities(Graph(spark, sf_dir).entities, graph.question_terms(QUESTION)).select("term", "position", "name", "type")


@query(f"""WITH {GRAPH}, a AS (SELECT entity_id FROM entities WHERE name = (SELECT n_name FROM nation WHERE n_nationkey = 1)), c AS (SELECT entity_id, name FROM entities WHERE contains(lower(name), 'a'))
SELECT b.name AS middle, r1.predicate AS first_relationship, r2.predicate AS second_relationship, c.name AS last FROM a JOIN edges r1 ON r1.dst_id = a.entity_id JOIN edges r2 ON r2.src_id = r1.src_id
  JOIN c ON c.entity_id = r2.dst_id JOIN entities b ON b.entity_id = r1.src_id WHERE NOT (r1.dst_id = r2.dst_id AND r1.predicate = r2.predicate)""")
def two_hop(spark, sf_dir):
    g = Graph(spark, sf_dir)
    name = read(spark, sf_dir, "nation").where("n_nationkey = 1").first()["n_name"]
    return graph.two_hop(g.edges, g.entities, name, "a")


@query(f"WITH {GRAPH} SELECT s.name AS source, e.predicate AS relationship, o.name AS target FROM edges e JOIN entities s ON s.entity_id = e.src_id JOIN entities o ON o.entity_id = e.dst_id WHERE e.predicate IN ('LOCATED_IN', 'BASED_IN')")
def typed_alternation(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.facts(g.edges.where(F.col("predicate").isin("LOCATED_IN", "BASED_IN")), g.entities)


@query(f"""WITH RECURSIVE {GRAPH}, few AS (SELECT * FROM both_ways),
walk AS (SELECT e.entity_id AS start_id, e.entity_id AS at_id, 0 AS hops, []::VARCHAR[] AS trail FROM entities e WHERE e.type = 'Region'
  UNION ALL SELECT w.start_id, f.other_id, w.hops + 1, list_append(w.trail, f.src_id || f.predicate || f.dst_id) FROM walk w JOIN few f ON f.entity_id = w.at_id WHERE w.hops < 3 AND NOT list_contains(w.trail, f.src_id || f.predicate || f.dst_id))
SELECT start_id, at_id AS end_id, hops FROM walk WHERE hops > 0""")
def var_length_paths(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.paths(g.edges, g.entities.where("type = 'Region'"), 3)


@query(f"WITH {GRAPH} SELECT DISTINCT type AS name FROM entities UNION SELECT unnest(['Document', 'Chunk', 'ChildChunk', '__Entity__'])")
def catalog_labels(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.catalog(g.entities, g.edges).where("kind = 'label'").select("name")


@query(f"WITH {GRAPH} SELECT DISTINCT predicate AS name FROM edges UNION SELECT unnest(['HAS_CHUNK', 'HAS_CHILD', 'MENTIONS'])")
def catalog_predicates(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.catalog(g.entities, g.edges).where("kind = 'relationship'").select("name")


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM documents) + (SELECT count(DISTINCT chunk_id) FROM t) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM entities) AS deleted")
def wipe_counts(spark, sf_dir):
    g = Graph(spark, sf_dir)
    tiers = [read(spark, sf_dir, "documents"), g.triples.select("chunk_id").distinct(), read(spark, sf_dir, "embeddings"), g.entities]
    one = tiers[0].select(F.lit(1))
    for t in tiers[1:]:
        one = one.unionAll(t.select(F.lit(1)))
    return one.agg(F.count("*").alias("deleted"))


#: Flat JSON of ASCII in the form that Python writes: such values are shown as they are.
_FLAT = r'^[{]("[^"\\\\\x00-\x1F\x7F-\uFFFF]*": (-?(0|[1-9][0-9]*)|true|false|null|"[^"\\\\\x00-\x1F\x7F-\uFFFF]*")(, (?=")|(?=[}])))*[}]$'


@query("SELECT event_id, concat('event: ', event_id, CASE WHEN props IS NULL OR props = '' THEN '' ELSE chr(10) || 'props: ' || props END) AS text FROM events")
def records_to_text(spark, sf_dir):
    """Nested records as text (events' props): only values that are not yet in the form of the text pass through Python."""
    @F.pandas_udf(T.StringType())
    def shown(ids: pd.Series, props: pd.Series) -> pd.Series:
        return pd.Series([record_text({"event": i, "props": json.loads(p) if p else None}) for i, p in zip(ids, props, strict=True)])

    events = read(spark, sf_dir, "events").select("event_id", "props")
    flat = F.coalesce(F.col("props").rlike(_FLAT), F.lit(True))
    lines = F.concat_ws("\n", F.concat(F.lit("event: "), "event_id"), F.concat(F.lit("props: "), "props"))
    return events.where(flat).select("event_id", lines.alias("text")).unionAll(events.where(~flat).select("event_id", shown("event_id", "props").alias("text")))
