"""The engine's surface: ingest, status, setup, backfill, index, stats, graph, chat, search, reset; and an HTTP adapter."""

from __future__ import annotations

import json
import threading
import time
import uuid
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .errors import DocgraphError, NotFound, RequestError, SourceError, Unavailable
from .functions.sql import FUNCTIONS, register
from .operators import chat, chunking, embed, extract, graph, search
from .operators.vector_index import VectorIndex
from .providers import Answerer, EchoAnswerer, Embedder, Extractor, HashEmbedder, NeighbourWriter, PatternExtractor, QueryWriter
from .sources.readers import check_suffix, read_files, read_uploads
from .shared import release
from .store import TABLES, GraphStore, Snapshot

PROMPT = """Use what follows and nothing else. Where a passage and a fact differ, go by the passage.

QUESTION
{question}

PASSAGES
{passages}

FACTS OF THE GRAPH
{facts}
"""


def basename(uri):
    return F.element_at(F.split(uri, "/"), -1)


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, config: EngineConfig | None = None, extractor: Extractor | None = None, embedder: Embedder | None = None, answerer: Answerer | None = None, writer: QueryWriter | None = None
    ) -> None:
        self.spark, self.config = spark, config or EngineConfig.from_env()
        self.store = GraphStore(spark, root, self.config.store_partitions)
        self.extractor, self.answerer, self.writer = extractor or PatternExtractor(), answerer or EchoAnswerer(), writer or NeighbourWriter()
        self.embedder = embedder or HashEmbedder(self.config.embedding_dimensions)
        self.vectors = VectorIndex(self.store, self.embedder.dimensions)
        self._lock = threading.Lock()
        self._jobs: dict[str, dict] = {}
        register(spark)

    # --- staging ----------------------------------------------------------

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once beside the store: whatever reads it later neither parses a file nor asks a model again."""
        path = f"{self.store.root}/_staging/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._written_to = path
        return back

    def unstage(self, *tables: DataFrame) -> None:
        release(*(t for t in tables if hasattr(t, "_written_to")))

    # --- ingest -----------------------------------------------------------

    def load(self, units: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks) of staged sources, chunks staged; raises for a file that cannot be read or holds nothing usable."""
        if units.isEmpty():  # Spark reads no rows from files without bytes
            raise SourceError("No usable text extracted: nothing to read")
        failed = units.where(F.col("error").isNotNull()).select("source_uri", "error").limit(5).collect()
        if failed:
            raise SourceError("; ".join(f"{r['source_uri']}: {r['error']}" for r in failed))
        chunks = self.staged(chunking.chunk_documents(units, self.config), "chunks")
        empty = units.join(chunks.select("doc_id"), "doc_id", "left_anti").select("source_uri").limit(5).collect()
        if empty:
            self.unstage(chunks)
            raise SourceError(f"No usable text extracted from {', '.join(r[0] for r in empty)}")
        docs = units.select("doc_id", "source_uri").join(chunking.content_hashes(chunks), "doc_id").withColumn("ingested_at", F.lit(datetime.now(UTC)))
        return docs, chunks

    def dry_run(self, units: DataFrame) -> dict:
        """The first chunks and children; nothing is kept and no model asked."""
        units = self.staged(units, "units")
        _, chunks = self.load(units)
        children = chunking.children_of(chunks, self.config.child_chunk_chars)
        first = chunks.orderBy("doc_id", "seq").limit(3)
        shown = first.select("chunk_id", "seq", F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(300)).alias("preview")).collect()
        kids = children.join(F.broadcast(first.select("chunk_id")), "chunk_id").where("seq < 3").orderBy("chunk_id", "seq").collect()
        out = {
            "chunks": chunks.count(),
            "children": children.count(),
            "preview": [{"chunk_id": c["chunk_id"], "seq": c["seq"], "text": c["preview"], "children": [{"seq": k["seq"], "chars": len(k["text"]), "text": k["text"][:70]} for k in kids if k["chunk_id"] == c["chunk_id"]]} for c in shown],
        }
        self.unstage(units, chunks)
        return out

    def ingest(self, units: DataFrame, with_embeddings: bool = True, skip_unchanged: bool = False, prune: bool = False) -> dict:
        """Documents and chunks, then children with vectors, then triples; each step is one atomic commit.

        Sources are parsed once and models asked once for each chunk and child; failures of models are counted and listed.
        """
        self.store.setup()
        units = units if hasattr(units, "_written_to") else self.staged(units, "units")
        used = [units]
        try:
            docs, chunks = self.load(units)
            used.append(chunks)
            if skip_unchanged:
                new = docs.join(self.store.table("documents").select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti").select("doc_id")
                docs = self.staged(docs.join(new, "doc_id", "left_semi"), "documents")
                chunks = self.staged(chunks.join(docs.select("doc_id"), "doc_id", "left_semi"), "chunks")
                used += [docs, chunks]
            self.store.write_documents(docs, chunks, prune)
            children = self.staged(chunking.children_of(chunks, self.config.child_chunk_chars), "children")
            used.append(children)
            embedded, errors = 0, []
            if with_embeddings:
                parents = chunks.join(docs.select("doc_id", basename(F.col("source_uri")).alias("source")), "doc_id").select("chunk_id", "text", "source")
                embedded, errors = self._embed(children, parents)
            answers = self.staged(extract.parse(extract.ask(chunks, self.extractor)), "answers")
            kept = self.staged(extract.triples(answers), "triples")
            used += [answers, kept]
            self.store.write_triples(kept)
            stats = extract.counters(answers).first().asDict()
            errors += [f"chunk {r['chunk_id']}: {r['error']}" for r in answers.where(F.col("error").isNotNull()).orderBy("chunk_id").limit(50).collect()]
            out = {"chunks": chunks.count(), "children": children.count(), "children_embedded": embedded, "triples_written": stats["triples_kept"], "stats": stats, "errors": errors}
        finally:
            self.unstage(*used)
        self.store.vacuum()
        return out

    def _embed(self, children: DataFrame, parents: DataFrame) -> tuple[int, list[str]]:
        """(children that got vectors, what failed); those that failed are kept without one."""
        rows = self.staged(embed.embed_children(children, parents, self.embedder, self.config), "vectors")
        try:
            self.store.write_children(rows.drop("error"))
            errors = [f"child {r['child_id']}: {r['error']}" for r in rows.where(F.col("error").isNotNull()).orderBy("child_id").limit(50).collect()]
            return rows.where(F.col("embedding").isNotNull()).count(), errors
        finally:
            self.unstage(rows)

    def ingest_paths(self, paths: str | list[str], **options) -> dict:
        return self.ingest(read_files(self.spark, paths), **options)

    def submit(self, name: str, content: bytes, wait: bool = False) -> dict:
        """Queue an upload; poll ``status``. Every state is written to the store's jobs table, so a job outlives its process."""
        check_suffix(name)
        job_id = uuid.uuid4().hex[:8]
        self.store.setup()
        self._job(job_id, status="pending", filename=name, started_at=time.time())

        def work() -> None:
            self._job(job_id, status="running")
            try:
                with self._lock:
                    done = self.ingest(read_uploads(self.spark, [(name, content)]))
                self._job(job_id, status="done", finished_at=time.time(), **done)
            except Exception as e:
                self._job(job_id, status="failed", error=f"{type(e).__name__}: {e}")

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        if wait:
            thread.join()
        return {"job_id": job_id, "status": "pending", "message": f"Queued. GET /status/{job_id} tells how far it is."}

    def _job(self, job_id: str, **fields) -> None:
        j = self._jobs.setdefault(job_id, {"job_id": job_id})
        j.update(fields)
        row = self.spark.createDataFrame([(job_id, j["status"], j.get("filename"), json.dumps(j, default=str), datetime.now(UTC))], TABLES["jobs"])
        self.store.write_job(row.coalesce(1))

    def status(self, job_id: str) -> dict:
        """A job's last written state: one whose process ended in between stays pending or running."""
        if job_id in self._jobs:
            return self._jobs[job_id]
        row = self.store.table("jobs").where(F.col("job_id") == F.lit(job_id)).first()
        if row is None:
            raise NotFound("Job not found")
        return json.loads(row["info"])

    def setup(self) -> dict:
        try:
            have = {r[0] for r in self.spark.sql("SHOW USER FUNCTIONS").collect()}
            lost = [f for f in FUNCTIONS if f not in {x.rsplit(".", 1)[-1] for x in have}]
            if lost:
                raise Unavailable(f"SQL functions are missing: {', '.join(lost)}")
            self.store.setup()
        except Exception as e:
            raise Unavailable(str(e)) from e
        return {"message": "Tables created."}

    def backfill(self) -> dict:
        """Children for chunks that have none, or some without a vector, from the stored texts."""
        now = self.store.snapshot()
        kids = now.table("children")
        whole = kids.join(kids.where(F.col("embedding").isNull()).select("chunk_id"), "chunk_id", "left_anti")
        pending = self.staged(graph.chunks_without_children(now.table("chunks"), whole, now.table("documents")), "pending")
        try:
            count = pending.count()
            if not count:
                return {"message": "Every chunk already has children.", "children": 0}
            _, errors = self._embed(children := chunking.children_of(pending, self.config.child_chunk_chars), pending.withColumn("source", basename(F.col("source"))))
            return {"message": f"Backfilled {count} chunk(s).", "chunks": count, "children": children.count(), "errors": errors}
        finally:
            self.unstage(pending)

    def index(self, rebuild: bool = False) -> dict:
        """Index the vectors for ``search``; later calls index what changed since."""
        done = self.vectors.refresh(rebuild)
        return {"message": f"{done['indexed']} partition(s) indexed.", **done}

    # --- reading ----------------------------------------------------------

    def nearest(self, now: Snapshot, query: list[float], k: int) -> DataFrame:
        """The k nearest children: from the index where there is one, and from all where its cells hold fewer than k."""
        near = self.vectors.candidates(now, query)
        if near is not None:
            hits = search.top_children(near, query, k).collect()
            if len(hits) == k:
                return self.spark.createDataFrame(hits, "child_id string, chunk_id string, score double")
        return search.top_children(now.table("children"), query, k)

    def stats(self) -> dict:
        t = self.store.snapshot().table
        row = graph.stats(*[t(n) for n in ("documents", "chunks", "children", "entities", "edges", "mentions")]).first().asDict()
        return row | {"missing_embeddings": row["children"] - row["embedded"], "by_type": [r.asDict() for r in graph.by_type(t("edges")).collect()]}

    def graph(self, limit: int = 100, skip: int = 0, node_type: str | None = None) -> dict:
        if not 1 <= limit <= 1000 or skip < 0:
            raise RequestError("limit is 1 to 1000, skip 0 or more")
        now = self.store.snapshot()
        found = graph.with_chunks(graph.page(now.table("edges"), now.table("entities"), limit, skip, node_type), now.table("provenance"))
        rows = found.orderBy("src_id", "predicate", "dst_id").collect()
        nodes: dict[str, dict] = {}
        for r in rows:
            nodes.setdefault(r["src_id"], {"id": r["src_id"], "name": r["source_name"], "labels": [r["source_type"]]})
            nodes.setdefault(r["dst_id"], {"id": r["dst_id"], "name": r["target_name"], "labels": [r["target_type"]]})
        edges = [{"source": r["src_id"], "target": r["dst_id"], "relationship": r["predicate"], "chunk_ids": r["chunk_ids"]} for r in rows]
        return {"nodes": list(nodes.values()), "edges": edges, "count": len(edges)}

    def search(self, question: str, k_child: int | None = None, k_parent: int | None = None, include_facts: bool = True, with_answer: bool = True) -> dict:
        """Passages, facts and an answer; without ``with_answer`` no model is asked."""
        question = _asked(question)
        if k_child is not None and not 1 <= k_child <= 200 or k_parent is not None and not 1 <= k_parent <= 25:
            raise RequestError("k_child is 1 to 200, k_parent 1 to 25")
        now = self.store.snapshot()
        t = now.table
        try:
            query = embed.checked(self.embedder, [question])[0]
            hits = self.nearest(now, query, k_child or self.config.search_child_k)
            found = search.passages_of(hits, t("chunks"), t("documents"), k_parent or self.config.search_parent_k).collect()
        except Exception as e:
            raise Unavailable(f"Vector search failed ({e})") from e
        if not found:
            return {"question": question, "answer": None, "passages": [], "facts": [], "message": "Nothing retrieved. Check GET /stats for embedded children."}
        facts = []
        if include_facts:
            ids = self.spark.createDataFrame([(r["chunk_id"],) for r in found], "chunk_id string")
            facts = [r.asDict() for r in graph.expand(ids, t("mentions"), t("edges"), t("entities"), self.config.fact_limit).collect()]
        shown = "\n\n".join(f"{i}. from {r['source'] or 'unknown'} ({r['chunk_id']}):\n{r['text']}" for i, r in enumerate(found, 1))
        known = "\n".join(f"- {f['source']} | {f['relationship']} | {f['target']}" for f in facts) or "(no facts)"
        answer = self.answerer.answer(PROMPT.format(question=question, passages=shown, facts=known)) if with_answer else None
        return {"question": question, "answer": answer, "passages": [{k: r[k] for k in ("chunk_id", "source", "text", "score", "matched_children")} for r in found], "facts": facts}

    def chat(self, question: str) -> dict:
        question = _asked(question)
        self.store.views()
        now = self.store.snapshot()
        return chat.ask(self.spark, question, now.table("entities"), now.table("edges"), self.writer, self.answerer)

    def reset(self) -> dict:
        return {"message": f"Graph cleared. {self.store.wipe():,} nodes deleted."}


def _asked(question: str) -> str:
    if not (question or "").strip():
        raise RequestError("Missing 'question' field")
    return question.strip()


def dispatch(engine: Engine, method: str, target: str, body: bytes = b"", filename: str = "") -> tuple[int, dict]:
    """One request: (status, payload)."""
    url = urlparse(target)
    args = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        data = json.loads(body) if body and method == "POST" and url.path in ("/chat", "/search") else {}
        match method, url.path.strip("/").split("/"):
            case "POST", ["ingest"]:
                return 200, engine.submit(filename or args.get("filename", "upload.txt"), body)
            case "GET", ["status", job_id]:
                return 200, engine.status(job_id)
            case "POST", ["setup"]:
                return 200, engine.setup()
            case "POST", ["backfill"]:
                return 200, engine.backfill()
            case "POST", ["index"]:
                return 200, engine.index(args.get("rebuild") == "true")
            case "GET", ["stats"]:
                return 200, engine.stats()
            case "GET", ["graph"]:
                return 200, engine.graph(int(args.get("limit", 100)), int(args.get("skip", 0)), args.get("node_type"))
            case "POST", ["chat"]:
                return 200, engine.chat(data.get("question", ""))
            case "POST", ["search"]:
                return 200, engine.search(data.get("question", ""), data.get("k_child"), data.get("k_parent"), data.get("include_facts", True), data.get("with_answer", True))
            case "DELETE", ["reset"]:
                return 200, engine.reset()
        return 404, {"detail": "Not found"}
    except DocgraphError as e:
        return e.status, {"detail": str(e)}
    except (ValueError, TypeError) as e:
        return 400, {"detail": str(e)}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000, allow_reset: bool = False) -> ThreadingHTTPServer:
    """A server on the loopback interface; DELETE /reset only if it is allowed."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.command == "DELETE" and not allow_reset:
                code, payload = 403, {"detail": "reset is not allowed here"}
            else:
                code, payload = dispatch(engine, self.command, self.path, body, self.headers.get("X-Filename", ""))
            out = json.dumps(payload, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_DELETE = _answer

    return ThreadingHTTPServer((host, port), Handler)
