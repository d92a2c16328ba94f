import json
import sys
import threading

import pytest
from pyspark import cloudpickle

from docgraph.config import EngineConfig
from docgraph.errors import ConfigError, RequestError, SourceError, UnsafeQuery
from docgraph.http_provider import HttpEmbedder, Refused, providers_from_env
from docgraph.operators import chat, extract, graph
from docgraph.operators.embed import checked
from docgraph.providers import HashEmbedder
from docgraph.service import Engine, dispatch
from docgraph.sources.readers import read_files, read_uploads
from docgraph.store import GRAPH, GraphStore
from docgraph.streaming.ingest import watch

TEXT = "TechCorp acquired CyberShield. The deal was large and it closed in the spring of that year after long talks between both boards. Alan founded CyberShield. Jane leads TechCorp."
CONFIG = EngineConfig(min_chunk_chars=20, embedding_dimensions=64)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky:
    """Fails on one chunk, answers badly on another."""

    def extract(self, text):
        if "boom" in text:
            raise RuntimeError("no answer")
        if "mistyped" in text:
            return json.dumps({"triples": [{"subject": 1}]}), {}
        triple = {"subject": "Acme Corp", "subject_type": "organization", "predicate": "locatedIn", "object": "Paris", "object_type": "city"}
        return json.dumps({"triples": [triple, {**triple, "object": " "}]}), {"input_tokens": 3}


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", CONFIG)


def tables(engine):
    return {n: sorted(map(str, engine.store.table(n).drop("ingested_at", "created_at").collect())) for n in GRAPH}


def test_ingest_search_chat_and_reset(engine):
    assert engine.stats()["documents"] == 0 and engine.stats()["by_type"] == []
    done = engine.ingest(read_uploads(engine.spark, [("a.txt", TEXT.encode())]))
    assert done["chunks"] == 1 and done["triples_written"] == 3 and done["errors"] == []
    first = tables(engine)
    engine.ingest(read_uploads(engine.spark, [("a.txt", TEXT.encode())]))
    assert tables(engine) == first  # twice is once
    s = engine.stats()
    assert (s["documents"], s["entities"], s["relationships"], s["orphans"], s["missing_embeddings"]) == (1, 4, 3, 0, 0)
    assert {r["relationship"]: r["count"] for r in s["by_type"]} == {"ACQUIRED": 1, "FOUNDED": 1, "LEADS": 1}
    found = engine.search("who acquired CyberShield?")
    assert found["passages"][0]["source"] == "a.txt" and found["passages"][0]["score"] <= 1
    assert {"source": "TechCorp", "relationship": "ACQUIRED", "target": "CyberShield"} in found["facts"]
    assert engine.search("x y", include_facts=False)["facts"] == []
    talk = engine.chat("Who founded CyberShield?")
    assert {"source": "Alan", "relationship": "FOUNDED", "target": "CyberShield"} in talk["results"]
    page = engine.graph(limit=2)
    assert page["count"] == 2 and len(page["nodes"]) >= 2
    assert engine.graph(node_type="x` OR true")["count"] == 0
    for n in GRAPH:
        assert engine.store.duplicates(n).count() == 0
    assert engine.reset()["message"].startswith("Graph cleared.")
    assert engine.search("anything")["answer"] is None


def test_bad_chunks_are_isolated_and_counted(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", EngineConfig(max_chunk_chars=60, chunk_overlap=0, min_chunk_chars=5, embedding_dimensions=8), extractor=Picky())
    text = "A good paragraph stands here alone for now.\n\nThis one goes boom at once and is long enough.\n\nA mistyped answer comes from this paragraph."
    done = engine.ingest(read_uploads(spark, [("b.md", text.encode())]), with_embeddings=False)
    st = done["stats"]
    assert (st["chunks_seen"], st["triples_returned"], st["triples_kept"], st["triples_dropped"], st["parse_errors"], st["chunks_failed"], st["input_tokens"]) == (3, 2, 1, 1, 1, 1, 3)
    assert "no answer" in done["errors"][0]
    assert engine.stats()["children"] == 0
    assert engine.backfill()["chunks"] == 3 and engine.backfill()["children"] == 0
    row = engine.store.table("entities").where("name = 'Acme Corp'").first()
    assert row["type"] == "Organization"


def test_unusable_sources_fail(engine):
    with pytest.raises(SourceError, match="No usable text"):
        engine.ingest(read_uploads(engine.spark, [("a.txt", b"short")]))
    with pytest.raises(SourceError, match="nothing to read"):
        engine.ingest(read_uploads(engine.spark, [("a.txt", TEXT.encode())]).limit(0))
    with pytest.raises(SourceError, match="pypdf|PDF|Pdf|EOF|Stream"):
        engine.ingest(read_uploads(engine.spark, [("a.pdf", b"none")]))
    assert engine.dry_run(read_uploads(engine.spark, [("a.txt", TEXT.encode())]))["chunks"] == 1


def test_http_surface(engine):
    assert dispatch(engine, "POST", "/setup")[0] == 200
    assert dispatch(engine, "POST", "/ingest", b"x", "a.exe")[0] == 400
    assert dispatch(engine, "GET", "/status/none")[0] == 404
    assert dispatch(engine, "POST", "/search", b'{"question": " "}')[0] == 400
    assert dispatch(engine, "GET", "/graph?limit=0")[0] == 400
    job = engine.submit("a.txt", TEXT.encode(), wait=True)["job_id"]
    assert engine.status(job)["status"] == "done"
    bad = engine.submit("b.txt", b"tiny", wait=True)["job_id"]
    assert engine.status(bad)["status"] == "failed"
    fresh = Engine(engine.spark, engine.store.root, CONFIG)
    assert fresh.status(job)["status"] == "done"  # jobs outlive the process
    with pytest.raises(RequestError):
        engine.search("q", k_child=500)


def test_only_single_reads_of_graph_views_pass_the_guard(engine):
    engine.setup()
    engine.store.views()
    spark = engine.spark
    for ok in ("SELECT name FROM kg_entities", "WITH x AS (SELECT * FROM kg_facts) SELECT source FROM x WHERE target IN (SELECT name FROM kg_entities) ORDER BY 1 LIMIT 3", "SELECT type, count(*) FROM kg_entities GROUP BY type HAVING count(*) > 1"):
        chat.guard(spark, ok)
    spark.range(3).createOrReplaceTempView("secret")
    hidden = (
        "WITH a AS (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) SELECT * FROM secret",
        "WITH x AS (SELECT * FROM secret), secret AS (SELECT 1 AS id) SELECT * FROM x",
        "WITH `parquet./p` AS (SELECT 1) SELECT * FROM parquet.`/p`",
        "SELECT (SELECT max(id) FROM secret) FROM kg_entities",
        "SELECT name FROM kg_entities WHERE EXISTS (SELECT * FROM secret)",
    )
    for ok in ("WITH secret AS (SELECT name FROM kg_entities) SELECT * FROM secret", "WITH a AS (SELECT name FROM kg_entities), b AS (WITH a AS (SELECT type AS t FROM kg_entities) SELECT t FROM a) SELECT * FROM a JOIN b ON a.name = b.t"):
        chat.guard(spark, ok)
    spark.range(3).createOrReplaceTempView("kg_alias")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW kg_alias AS SELECT * FROM secret")
    chat.guard(spark, "SELECT * FROM kg_alias")  # a view of that name is what the caller made of it
    spark.catalog.dropTempView("kg_alias")
    for bad in (*hidden, "DROP TABLE kg_entities", "SELECT 1; SELECT 2", "INSERT INTO kg_entities SELECT * FROM kg_entities", "SELECT * FROM parquet.`/etc`", "SELECT * FROM kg_entities WHERE name IN (SELECT x FROM other)", "SELECT reflect('java.lang.System', 'exit', 1) FROM kg_entities", "SET a = b", "SELECT * FROM range(5)", "CACHE TABLE kg_entities"):
        with pytest.raises(UnsafeQuery):
            chat.guard(spark, bad)
    assert chat.unfenced("```sql\nSELECT 1\n```") == "SELECT 1"


def test_catalog_and_empty_terms(engine):
    engine.ingest(read_uploads(engine.spark, [("a.txt", TEXT.encode())]))
    t = engine.store.table
    kinds = {(r["kind"], r["name"]) for r in graph.catalog(t("entities"), t("edges")).collect()}
    assert {("property", "chunk_ids"), ("property", "embedding"), ("label", "__Entity__"), ("relationship", "ACQUIRED")} <= kinds
    assert graph.match_entities(t("entities"), []).count() == 0
    assert "cypher" in engine.chat("Who founded CyberShield?")


class Flaky(HashEmbedder):
    broken = True

    def embed(self, texts):
        if Flaky.broken and any("boom" in t for t in texts):
            raise RuntimeError("no vectors")
        return super().embed(texts)


def test_children_without_vectors_are_listed_and_filled_in(spark, tmp_path):
    config = EngineConfig(max_chunk_chars=60, chunk_overlap=0, min_chunk_chars=5, embed_batch_size=1, embedding_dimensions=8)
    text = "A good paragraph stands here alone for now.\n\nThis one goes boom at once and is long enough."
    done = Engine(spark, f"file://{tmp_path}/s", config, embedder=Flaky(8)).ingest(read_uploads(spark, [("b.md", text.encode())]))
    assert done["children_embedded"] == 1 and len(done["errors"]) == 1 and "no vectors" in done["errors"][0]
    engine = Engine(spark, f"file://{tmp_path}/s", config)
    assert engine.stats()["missing_embeddings"] == 1
    assert engine.backfill()["chunks"] == 1 and engine.stats()["missing_embeddings"] == 0 and engine.backfill()["children"] == 0


def test_concurrent_commits_lose_nothing(spark, tmp_path):
    """A commit that lands between another's reading and publishing: on other partitions, and on the same one."""
    a, b = GraphStore(spark, f"file://{tmp_path}/s", parts=4), GraphStore(spark, f"file://{tmp_path}/s", parts=4)
    a.setup()

    def job(i, state):
        return spark.createDataFrame([(f"j{i}", state, None, None, None)], "job_id string, status string, filename string, info string, updated_at timestamp")

    calls = []
    commit = a.commit

    def slow(change, **options):
        def late(now):
            out = change(now)
            if not calls:
                for i in range(12):  # all four partitions
                    b.write_job(job(i, "other"))
            calls.append(now.number)
            return out

        commit(late, **options)

    a.commit = slow
    a.write_job(job(100, "mine"))
    assert len(calls) == 2 and calls[1] > calls[0]  # merged anew
    assert {r["job_id"] for r in a.table("jobs").collect()} == {f"j{i}" for i in (*range(12), 100)}
    threads = [threading.Thread(target=lambda s=s, i=i: s.write_job(job(i, "both"))) for i, s in ((200, b), (201, GraphStore(spark, b.root)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {"j200", "j201"} <= {r["job_id"] for r in b.table("jobs").collect()}
    assert b.vacuum(keep=1, older_than=-60) > 0 and b.table("jobs").count() == 15


def test_an_upsert_touches_its_own_partitions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s", CONFIG)
    engine.ingest(read_uploads(spark, [(f"{i}.txt", f"{TEXT} Number {i}.".encode()) for i in range(20)]))
    before = engine.store.snapshot().tables
    engine.ingest(read_uploads(spark, [("0.txt", f"{TEXT} Number 0.".encode())]))
    after = engine.store.snapshot().tables
    changed = {n: sum(before[n].get(p) != v for p, v in after[n].items()) for n in GRAPH}
    assert changed["documents"] == changed["chunks"] == changed["children"] == changed["mentions"] == 1 and len(before["documents"]) > 5
    assert engine.stats()["documents"] == 20


def test_pruned_chunks_take_what_hangs_on_them_along(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s", EngineConfig(max_chunk_chars=80, chunk_overlap=0, min_chunk_chars=5, embedding_dimensions=8))
    (tmp_path / "in").mkdir()
    f = tmp_path / "in" / "a.txt"
    f.write_text("TechCorp acquired CyberShield in the spring of a year.\n\nAlan founded SmallCorp in the autumn of that year, as told.")
    engine.ingest_paths(str(f))
    f.write_text("TechCorp acquired CyberShield in the spring of a year.")
    engine.ingest_paths(str(f), prune=True)
    counts = {n: engine.store.table(n).count() for n in ("chunks", "children", "provenance", "mentions")}
    assert counts == {"chunks": 1, "children": 1, "provenance": 1, "mentions": 2}
    assert engine.ingest_paths(str(f), skip_unchanged=True)["chunks"] == 0


def test_sources_are_parsed_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def counted(batches):
        import uuid

        for b in batches:
            (log / uuid.uuid4().hex).write_text(str(b.num_rows))
            yield b

    engine = Engine(spark, f"file://{tmp_path}/s", CONFIG)
    units = read_uploads(spark, [("a.txt", TEXT.encode())])
    engine.ingest(units.mapInArrow(counted, units.schema))
    assert sum(int(f.read_text()) for f in log.iterdir()) == 1
    assert not list((tmp_path / "s" / "_staging").iterdir())


def test_a_file_is_one_document_in_stream_and_batch(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", CONFIG)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b+c.txt").write_text(TEXT)
    watch(engine, f"file://{tmp_path}/in", f"file://{tmp_path}/ck", available_now=True).awaitTermination()
    engine.ingest(read_files(spark, str(tmp_path / "in" / "a b+c.txt")))
    assert engine.stats()["documents"] == 1


def test_dimensions_are_negotiated_once():
    class Client:
        asked = []

        def post(self, path, body):
            self.asked.append("dimensions" in body)
            if "dimensions" in body:
                raise Refused("unknown argument: dimensions")
            return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    e = HttpEmbedder(Client(), "m", 1)
    assert e.embed(["a", "b"]) == e.embed(["a", "b"]) == [[1.0], [2.0]] and Client.asked == [True, False, False]
    assert providers_from_env({}) == {}
    with pytest.raises(ConfigError):
        providers_from_env({"KG_API_BASE": "http://x", "KG_API_KEY": "change-me"})


def test_jobs_are_durable_in_every_state(engine):
    engine.store.setup()
    engine._job("x1", status="pending", filename="a")
    assert Engine(engine.spark, engine.store.root, CONFIG).status("x1")["status"] == "pending"
    assert engine.setup()["message"] == "Tables created."


def test_strict_triples_and_terms():
    good = {"subject": "a", "subject_type": "b", "predicate": "c", "object": "d", "object_type": "e"}
    assert json.loads(extract.strict_triples(json.dumps({"triples": [good]}))) == [good]
    for bad in ("", "x", "[]", '{"triples": [{"subject": "a"}]}', json.dumps({"triples": [good, {**good, "object": 1}]})):
        assert extract.strict_triples(bad) is None
    assert graph.question_terms("what? is The Acme, of 'Rome' an") == ["what", "acme", "rome"]


def test_embedder_widths():
    class Bad(HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:1]

    with pytest.raises(ValueError, match="vectors for"):
        checked(Bad(4), ["a", "b"])


def test_streamed_files_are_ingested_once(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", CONFIG)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    (tmp_path / "in" / "tiny.txt").write_text("tiny")
    (tmp_path / "in" / "bad.jsonl").write_text("{")
    for _ in range(2):
        q = watch(engine, f"file://{tmp_path}/in", f"file://{tmp_path}/ck", available_now=True)
        q.awaitTermination()
    (tmp_path / "in" / "b.json").write_text('{"fact": "Bob joined TechCorp", "kind": "hire"}')
    watch(engine, f"file://{tmp_path}/in", f"file://{tmp_path}/ck", available_now=True).awaitTermination()
    assert engine.stats()["documents"] == 2
    rejected = spark.read.parquet(f"file://{tmp_path}/store/_rejected")
    assert sorted(r["source_uri"].rsplit("/", 1)[1] for r in rejected.collect()) == ["bad.jsonl", "tiny.txt"]
