"""Graph patterns as joins over (entity_id, name, type) and (src_id, predicate, dst_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import TABLES

#: Words that entity matching ignores.
STOP_WORDS = ["the", "and", "for", "are", "was", "were", "what", "who", "which", "how", "does", "did", "has", "have", "been", "that", "this", "with", "from", "they"]


def endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends' names and types."""
    s = entities.select(F.col("entity_id").alias("src_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    o = entities.select(F.col("entity_id").alias("dst_id"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return edges.join(s, "src_id").join(o, "dst_id")


def facts(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return endpoints(edges, entities).select(F.col("source_name").alias("source"), F.col("predicate").alias("relationship"), F.col("target_name").alias("target"))


def undirected(edges: DataFrame) -> DataFrame:
    """(entity_id, other_id, src_id, predicate, dst_id): each edge from both ends, a loop once."""
    ends = F.when(F.col("src_id") == F.col("dst_id"), F.array(F.struct(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("other_id")))).otherwise(
        F.array(F.struct(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("other_id")), F.struct(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("other_id")))
    )
    return edges.select("src_id", "predicate", "dst_id", F.explode(ends).alias("e")).select("e.entity_id", "e.other_id", "src_id", "predicate", "dst_id")


def expand(chunk_ids: DataFrame, mentions: DataFrame, edges: DataFrame, entities: DataFrame, limit: int | None = 40) -> DataFrame:
    """Distinct facts (by names) around the entities that the chunks mention."""
    seen = mentions.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("entity_id").distinct()
    near = undirected(edges).join(seen, "entity_id", "left_semi").select("src_id", "predicate", "dst_id").distinct()
    out = facts(near, entities).distinct()
    return out if limit is None else out.orderBy("source", "relationship", "target").limit(limit)


def page(edges: DataFrame, entities: DataFrame, limit: int = 100, skip: int = 0, node_type: str | None = None) -> DataFrame:
    """Edges with ends, in a total order; ``node_type`` filters the source."""
    if node_type is not None:
        edges = edges.join(entities.where(F.col("type") == F.lit(node_type)).select(F.col("entity_id").alias("src_id")), "src_id", "left_semi")
    chosen = edges.orderBy("src_id", "predicate", "dst_id").offset(skip).limit(limit)
    return endpoints(chosen, entities)


def with_chunks(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """A page's edges with the sorted ids of the chunks that state them; only a page's lists are ever built."""
    key = ["src_id", "predicate", "dst_id"]
    lists = provenance.join(rows.select(key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return rows.join(lists, key, "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """The distinct ends of a page."""
    ends = F.array(F.struct(F.col("src_id").alias("id"), F.col("source_name").alias("name"), F.col("source_type").alias("type")), F.struct(F.col("dst_id").alias("id"), F.col("target_name").alias("name"), F.col("target_type").alias("type")))
    return rows.select(F.explode(ends).alias("n")).select("n.*").dropDuplicates(["id"])


def stats(documents: DataFrame, chunks: DataFrame, children: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row of counts, zeros on an empty store: tagged partial counts in a single aggregate."""
    tagged = lambda df, tag: df.select(F.lit(tag).alias("t"))
    counts = [
        tagged(documents, "documents"),
        tagged(chunks, "chunks"),
        tagged(children, "children"),
        tagged(children.where(F.col("embedding").isNotNull()), "embedded"),
        tagged(entities, "entities"),
        tagged(edges, "relationships"),
        tagged(orphans(entities, edges, mentions), "orphans"),
    ]
    names = ["documents", "chunks", "children", "embedded", "entities", "relationships", "orphans"]
    return reduce(DataFrame.unionAll, counts).agg(*[F.count_if(F.col("t") == n).alias(n) for n in names])


def by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("predicate").alias("relationship")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "relationship")


def orphans(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities without any relationship, mentions included."""
    used = edges.select(F.explode(F.array("src_id", "dst_id")).alias("entity_id")).unionAll(mentions.select("entity_id"))
    return entities.join(used, "entity_id", "left_anti")


def chunks_without_children(chunks: DataFrame, children: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, text, source) of chunks that vector search cannot find."""
    bare = chunks.join(children.select("chunk_id"), "chunk_id", "left_anti")
    return bare.join(documents.select("doc_id", F.col("source_uri").alias("source")), "doc_id", "left").select("chunk_id", "text", "source")


def question_terms(question: str) -> list[str]:
    """Words of three letters and more that are no stop words as they stand, without punctuation at their ends."""
    words = [w for w in question.split() if len(w) >= 3 and w.lower() not in STOP_WORDS]
    terms = [w.strip("?,.'\"!").lower() for w in words]
    return list(dict.fromkeys(t for t in terms if t))


def match_entities(entities: DataFrame, terms: list[str], each: int = 5) -> DataFrame:
    """(term, position, name, type): up to ``each`` entities whose name contains a term. Terms come from one question."""
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(x).alias("term")) for i, x in enumerate(terms)]).cast("array<struct<position:int,term:string>>"))
    hits = entities.select("name", "type", "entity_id", t.alias("t")).where(F.contains(F.lower("name"), F.col("t.term"))).select("t.term", "t.position", "name", "type", "entity_id")
    rank = F.row_number().over(Window.partitionBy("position").orderBy("name", "entity_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= each).drop("rank")


def neighbours(edges: DataFrame, entities: DataFrame, names: list[str], each: int = 15) -> DataFrame:
    """(name, source, relationship, target): up to ``each`` facts of each named entity, as directed."""
    named = entities.where(F.col("name").isin(names)).select("entity_id", F.col("name").alias("of"))
    near = undirected(edges).join(named, "entity_id")
    rows = near.join(entities.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other")), "other_id")
    out = F.col("src_id") == F.col("entity_id")
    rows = rows.select(F.col("of").alias("name"), F.when(out, F.col("of")).otherwise(F.col("other")).alias("source"), F.col("predicate").alias("relationship"), F.when(out, F.col("other")).otherwise(F.col("of")).alias("target"), "src_id", "dst_id")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("source", "relationship", "target", "src_id", "dst_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= each).select("name", "source", "relationship", "target")


def two_hop(edges: DataFrame, entities: DataFrame, first_name: str, last_contains: str) -> DataFrame:
    """(a)<-[r1]-(b)-[r2]->(c) with different edges: b, c and both relationships."""
    a = entities.where(F.col("name") == first_name).select(F.col("entity_id").alias("a_id"))
    c = entities.where(F.contains(F.lower("name"), F.lit(last_contains.lower()))).select(F.col("entity_id").alias("c_id"), F.col("name").alias("last"))
    b = entities.select(F.col("entity_id").alias("b_id"), F.col("name").alias("middle"))
    r1 = edges.select(F.col("src_id").alias("b_id"), F.col("predicate").alias("first_relationship"), F.col("dst_id").alias("a_id")).join(a, "a_id", "left_semi")
    r2 = edges.select(F.col("src_id").alias("b_id"), F.col("predicate").alias("second_relationship"), F.col("dst_id").alias("c_id")).join(c, "c_id")
    same = (F.col("a_id") == F.col("c_id")) & (F.col("first_relationship") == F.col("second_relationship"))
    return r1.join(r2, "b_id").where(~same).join(b, "b_id").select("middle", "first_relationship", "second_relationship", "last")


def paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(start_id, end_id, hops) of every undirected trail of up to ``most`` edges, none used twice: joins, one per hop."""
    steps = undirected(edges).select(F.col("entity_id").alias("at"), "other_id", F.struct("src_id", "predicate", "dst_id").alias("edge"))
    front = start.select(F.col("entity_id").alias("start_id"), F.col("entity_id").alias("at"), F.array().cast("array<struct<src_id:string,predicate:string,dst_id:string>>").alias("trail"))
    found = []
    for hop in range(1, most + 1):
        front = front.join(steps, "at").where(~F.array_contains("trail", F.col("edge"))).select("start_id", F.col("other_id").alias("at"), F.array_append("trail", F.col("edge")).alias("trail"))
        found.append(front.select("start_id", F.col("at").alias("end_id"), F.lit(hop).alias("hops")))
    return reduce(DataFrame.unionAll, found)


def catalog(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name): labels, relationship types and property keys of the whole graph, the provenance tiers included."""
    spark = entities.sparkSession
    keys = sorted({c.split()[0] for n in ("documents", "chunks", "children", "entities", "edges") for c in TABLES[n].split(", ")} | {"chunk_ids"})
    fixed = [("label", n) for n in ("Document", "Chunk", "ChildChunk", "__Entity__")] + [("relationship", n) for n in ("HAS_CHUNK", "HAS_CHILD", "MENTIONS")]
    fixed = spark.createDataFrame(fixed + [("property", k) for k in keys], "kind string, name string")
    own = entities.select(F.lit("label").alias("kind"), F.col("type").alias("name")).distinct()
    return fixed.unionAll(own).unionAll(edges.select(F.lit("relationship"), "predicate").distinct()).distinct()
