"""The graph store: partitioned parquet tables behind numbered manifests, and their upsert policies.

Rows lie in ``parts`` partitions of each table by a hash of what they belong to: documents, chunks, children and mentions by
their document, entities by id, edges and their provenance by the source entity. An upsert reads and writes only the
partitions that its rows touch. Their new files go to ``root/<table>/v=<version>/p=<partition>``, and a manifest
``root/_manifests/<n>.json`` names the version of every partition of every table: readers see all of a job's tables or none.

A commit adds the manifest after the one it was based on, by a rename that fails where that number is taken. The loser
looks at what the winner changed: other partitions, and it only adds its own versions to the new manifest; one of its
own, and it merges anew. ``vacuum`` removes old manifests and files that none of the kept ones names. Paths go through
Hadoop's file systems, so the root may lie in any store that Spark writes.

Policies: documents, chunks and children take the last row of a key; entities and edges keep their first row; mentions and
provenance (which chunk states which edge, one row each) are distinct. Rows without their parent chunk (children,
mentions) are left out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Unavailable
from .shared import file_system

TABLES = {
    "documents": "doc_id string, source_uri string, content_hash string, ingested_at timestamp",
    "chunks": "chunk_id string, doc_id string, text string, seq int, content_hash string",
    "children": "child_id string, chunk_id string, text string, seq int, embedding array<float>",
    "entities": "entity_id string, name string, type string, created_at timestamp",
    "edges": "src_id string, predicate string, dst_id string, created_at timestamp",
    "provenance": "src_id string, predicate string, dst_id string, chunk_id string",
    "mentions": "chunk_id string, entity_id string",
    "jobs": "job_id string, status string, filename string, info string, updated_at timestamp",
}
KEYS = {
    "documents": ["doc_id"], "chunks": ["chunk_id"], "children": ["child_id"], "jobs": ["job_id"], "entities": ["entity_id"], "edges": ["src_id", "predicate", "dst_id"],
    "provenance": ["src_id", "predicate", "dst_id", "chunk_id"], "mentions": ["chunk_id", "entity_id"],
}
GRAPH = tuple(n for n in TABLES if n != "jobs")
EDGE = KEYS["edges"]


def owner(name: str) -> Column:
    """What a row's partition is a hash of; a chunk's id is its document's and a number."""
    if name in ("children", "mentions"):
        return F.regexp_replace("chunk_id", ":[0-9]+$", "")
    return F.col({"documents": "doc_id", "chunks": "doc_id", "entities": "entity_id", "jobs": "job_id"}.get(name, "src_id"))


def last_wins(current: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the incoming one with the greatest ``order``, else the current one."""
    columns = current.columns
    rest = [c for c in columns if c not in keys]
    rank = F.col(order).cast("long") if order else F.lit(1).cast("long")
    both = current.withColumn("__ord", F.lit(-1).cast("long")).unionByName(incoming.select(*columns, F.coalesce(rank, F.lit(0)).alias("__ord")))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__ord", *[c for c in rest if c != "embedding"])).alias("r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in columns])


def named_entities(triples: DataFrame) -> DataFrame:
    """(entity_id, name, type): the first by chunk and place in its answer, subjects before objects."""
    side = lambda s, k: F.struct(F.col(f"{s}_id").alias("entity_id"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_type").alias("type"), F.struct("chunk_id", "seq", F.lit(k).alias("side")).alias("at"))
    t = triples.select(F.explode(F.array(side("subject", 0), side("object", 1))).alias("e")).select("e.*")
    return t.groupBy("entity_id").agg(F.min_by(F.struct("name", "type"), "at").alias("r")).select("entity_id", "r.name", "r.type")


def upsert_entities(current: DataFrame, triples: DataFrame, clock: Column) -> DataFrame:
    """First name wins: the store's, then that of ``named_entities``."""
    fresh = named_entities(triples).join(current.select("entity_id"), "entity_id", "left_anti").withColumn("created_at", clock)
    return current.unionByName(fresh)


def edge_rows(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("subject_id").alias("src_id"), "predicate", F.col("object_id").alias("dst_id"), "chunk_id").distinct()


def upsert_edges(current: DataFrame, triples: DataFrame, clock: Column) -> DataFrame:
    fresh = edge_rows(triples).select(EDGE).distinct().join(current.select(EDGE), EDGE, "left_anti").withColumn("created_at", clock)
    return current.unionByName(fresh)


def upsert_provenance(current: DataFrame, triples: DataFrame) -> DataFrame:
    return current.unionByName(edge_rows(triples)).distinct()


def mention_rows(triples: DataFrame) -> DataFrame:
    return triples.select("chunk_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"))


def upsert_mentions(current: DataFrame, triples: DataFrame, chunks: DataFrame) -> DataFrame:
    return current.unionByName(mention_rows(triples).join(chunks.select("chunk_id"), "chunk_id", "left_semi")).distinct()


def upsert_children(current: DataFrame, incoming: DataFrame, chunks: DataFrame) -> DataFrame:
    return last_wins(current, incoming.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), KEYS["children"])


@dataclass(frozen=True)
class Snapshot:
    """The tables of one manifest."""

    store: GraphStore
    number: int
    parts: int
    tables: dict[str, dict[str, str]]  # table -> partition -> version

    def table(self, name: str, places: set[int] | None = None) -> DataFrame:
        """All rows, or those of some partitions."""
        have = self.tables.get(name, {})
        paths = [f"{self.store.root}/{name}/v={v}/p={p}" for p, v in sorted(have.items()) if places is None or int(p) in places]
        if not paths:
            return self.store.spark.createDataFrame([], TABLES[name])
        return self.store.spark.read.schema(TABLES[name]).parquet(*paths)

    def place(self, name: str) -> Column:
        return F.pmod(F.xxhash64(owner(name)), F.lit(self.parts)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> set[int]:
        """The partitions of ``rows``: at most ``parts`` numbers."""
        return {r[0] for r in rows.select(self.place(name).alias("p")).distinct().collect()}


#: What a commit writes: the rows of some partitions of a table, in whole.
Change = dict[str, tuple[DataFrame, set[int]]]


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, parts: int = 64) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._jvm = spark._jvm

    def _list(self, path: str) -> list[tuple[str, int]]:
        """(name, time of change) of what lies in a folder."""
        fs, p = file_system(self.spark, path)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = file_system(self.spark, path)
        fs.delete(p, True)

    # --- manifests ----------------------------------------------------------

    def _manifests(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n, _ in self._list(f"{self.root}/_manifests") if n[0].isdigit())

    def _read(self, number: int) -> Snapshot:
        fs, p = file_system(self.spark, f"{self.root}/_manifests/{number:020d}.json")
        stream = fs.open(p)
        try:
            found = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return Snapshot(self, number, found["parts"], found["tables"])

    def snapshot(self) -> Snapshot:
        numbers = self._manifests()
        return self._read(numbers[-1]) if numbers else Snapshot(self, 0, self.parts, {})

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def _publish(self, number: int, parts: int, tables: dict) -> bool:
        """Add a manifest; false if the number is taken."""
        fs, tmp = file_system(self.spark, f"{self.root}/_manifests/_{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({"parts": parts, "tables": tables}).encode()))
        out.close()
        _, p = file_system(self.spark, f"{self.root}/_manifests/{number:020d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(p), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def commit(self, change: Callable[[Snapshot], Change], attempts: int = 20) -> None:
        """Write what ``change`` makes of the current snapshot, and publish it; anew if another commit got in between."""
        for _ in range(attempts):
            base = self.snapshot()
            version = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"
            mine: dict[str, dict[int, bool]] = {}
            for name, (rows, places) in change(base).items():
                path = f"{self.root}/{name}/v={version}"
                rows.withColumn("p", base.place(name)).repartition("p").write.partitionBy("p").parquet(path)
                there = {int(n[2:]) for n, _ in self._list(path) if n.startswith("p=")}
                mine[name] = {p: p in there for p in places | there}
            while True:
                head = self.snapshot()
                same = all(head.tables.get(n, {}).get(str(p)) == base.tables.get(n, {}).get(str(p)) for n, ps in mine.items() for p in ps)
                if not same:
                    for name in mine:
                        self._delete(f"{self.root}/{name}/v={version}")
                    break
                tables = {n: dict(head.tables.get(n, {})) for n in TABLES}
                for name, places in mine.items():
                    for p, there in places.items():
                        tables[name].pop(str(p), None)
                        if there:
                            tables[name][str(p)] = version
                if self._publish(head.number + 1, base.parts, tables):
                    return
        raise Unavailable(f"other commits got in between {attempts} times")

    def vacuum(self, keep: int = 3, older_than: float = 3600.0, names: tuple[str, ...] = tuple(TABLES)) -> int:
        """Remove all but the last ``keep`` manifests, and files that none of those names and that are old enough to belong to no running commit."""
        numbers, gone = self._manifests(), 0
        named = {(n, v) for k in numbers[-keep:] for n, ps in self._read(k).tables.items() for v in ps.values()}
        for k in numbers[:-keep]:
            self._delete(f"{self.root}/_manifests/{k:020d}.json")
        for name in names:
            for folder, changed in self._list(f"{self.root}/{name}"):
                if folder.startswith("v=") and (name, folder[2:]) not in named and changed < (time.time() - older_than) * 1000:
                    self._delete(f"{self.root}/{name}/{folder}")
                    gone += 1
        return gone

    # --- writing ------------------------------------------------------------

    def setup(self) -> None:
        """Create what is missing; safe to repeat."""
        if not self._manifests():
            self._publish(1, self.parts, {n: {} for n in TABLES})

    def duplicates(self, name: str) -> DataFrame:
        """Keys that break uniqueness: none."""
        return self.table(name).groupBy(*KEYS[name]).count().where("count > 1")

    def write_documents(self, docs: DataFrame, chunks: DataFrame, prune: bool = False) -> None:
        """Upsert documents and chunks together. ``prune`` drops chunks that a document no longer has, and all that hangs on them."""

        def change(now: Snapshot) -> Change:
            at = now.touched("documents", docs)
            current, out = now.table("chunks", at), {"documents": (last_wins(now.table("documents", at), docs, KEYS["documents"], "ingested_at"), at)}
            if prune:
                stale = current.join(docs.select("doc_id"), "doc_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
                current = current.join(stale, "chunk_id", "left_anti").select(current.columns)
                for name in ("children", "mentions"):
                    rows = now.table(name, at)
                    out[name] = (rows.join(stale, "chunk_id", "left_anti").select(rows.columns), at)
                said = now.table("provenance")
                hit = now.touched("provenance", said.join(stale, "chunk_id", "left_semi"))
                if hit:
                    rows = now.table("provenance", hit)
                    out["provenance"] = (rows.join(stale, "chunk_id", "left_anti").select(rows.columns), hit)
            out["chunks"] = (last_wins(current, chunks, KEYS["chunks"]), at)
            return out

        self.commit(change)

    def write_children(self, rows: DataFrame) -> None:
        def change(now: Snapshot) -> Change:
            at = now.touched("children", rows)
            return {"children": (upsert_children(now.table("children", at), rows, now.table("chunks", at)), at)}

        self.commit(change)

    def write_triples(self, triples: DataFrame, clock: Column | None = None) -> None:
        clock = F.current_timestamp() if clock is None else clock

        def change(now: Snapshot) -> Change:
            ends, edges = now.touched("entities", mention_rows(triples)), now.touched("edges", edge_rows(triples))
            chunks = now.touched("mentions", triples)
            return {
                "entities": (upsert_entities(now.table("entities", ends), triples, clock), ends),
                "edges": (upsert_edges(now.table("edges", edges), triples, clock), edges),
                "provenance": (upsert_provenance(now.table("provenance", edges), triples), edges),
                "mentions": (upsert_mentions(now.table("mentions", chunks), triples, now.table("chunks", chunks)), chunks),
            }

        self.commit(change)

    def write_job(self, row: DataFrame) -> None:
        def change(now: Snapshot) -> Change:
            at = now.touched("jobs", row)
            return {"jobs": (last_wins(now.table("jobs", at), row, KEYS["jobs"]), at)}

        self.commit(change)

    def wipe(self) -> int:
        """Swap to empty tables; returns the nodes that were there."""
        now = self.snapshot()
        total = sum(now.table(n).count() for n in ("documents", "chunks", "children", "entities"))
        while not self._publish(now.number + 1, now.parts, {n: now.tables.get(n, {}) if n == "jobs" else {} for n in TABLES}):
            now = self.snapshot()
        return total

    def views(self) -> None:
        """Temporary views kg_<table> for queries, and kg_facts with names in place of ids."""
        from .operators.graph import facts

        now = self.snapshot()
        for n in GRAPH:
            now.table(n).createOrReplaceTempView(f"kg_{n}")
        facts(now.table("edges"), now.table("entities")).createOrReplaceTempView("kg_facts")
