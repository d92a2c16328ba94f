import hashlib

import pytest
from pyspark.sql import functions as F

from docgraph.functions import normalize
from docgraph.functions.sql import register
from docgraph.functions.text import strip
from docgraph.functions.vectors import cosine_score
from docgraph.operators import chunking
from docgraph.plans import catalog

IDS = [
    ("Organization", "Acme Corp", "be5dad929cfb79cb8e6d1e6f"),
    ("Organization", "Acme Corporation", "be5dad929cfb79cb8e6d1e6f"),
    ("Organization", "ACME CORP", "be5dad929cfb79cb8e6d1e6f"),
    ("Organization", "Acme Corp Inc", "be5dad929cfb79cb8e6d1e6f"),
    ("Organization", "Acme Systems", "f524d22d4b42f9a183e43af2"),
    ("Organization", "TechCorp Inc.", "7ab49a98500e58c0fefb365a"),
    ("Person", "José Ñuñez", "e21e53776832b26c7c5a7074"),
    ("Person", "Straße", "e40f3aacf9c840c069b892fd"),
    ("City", "東京", "fbbd761561fcefe0fd348a48"),
    ("City", "北京", "fbbd761561fcefe0fd348a48"),
    ("Organization", "Sa Co", "8e4241c46a904e7009dccd35"),
    ("Organization", "Corp of Engineers", "586da048a10e7319c7b2643f"),
]


def test_entity_ids(spark):
    df = spark.createDataFrame(IDS, "t string, n string, want string")
    rows = df.select("want", normalize.entity_id(F.col("t"), F.col("n")).alias("got"), "n", normalize.name(F.col("n")).alias("name")).collect()
    assert [(r["n"], r["got"]) for r in rows] == [(r["n"], r["want"]) for r in rows]
    assert all(r["name"] == normalize.py_name(r["n"]) for r in rows)


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (normalize.label, {"PharmaceuticalCompany": "Pharmaceuticalcompany", "drug product": "DrugProduct", "REAL_estate": "RealEstate", "  ": "Entity", "_": "", "a b": "AB", "o'brien x-ray": "O'brienX-ray"}),
        (normalize.predicate, {"worksAt": "WORKS_AT", "located in": "LOCATED_IN", "co-founded by": "CO_FOUNDED_BY", "HTTPServer": "HTTPSERVER", "a  -  b": "A_B", "": "RELATED_TO"}),
    ],
)
def test_labels_and_predicates(spark, function, pairs):
    df = spark.createDataFrame(list(pairs), "string")
    assert {r[0]: r[1] for r in df.select("value", function(F.col("value"))).collect()} == pairs


NASTY = ["", "  ", "\n works at \n", "\u00a0drug\u2003product\x1c", "_a_", "worksAt", "x - y", "José Ñuñez Inc", None, "A. b! c? d.  E", "p one.\n\nq two. " + "r " * 1500 + "\n \n" + "s" * 400, "a: 1\n---\nb: 2 " + "t " * 300, "word " * 700]


def test_sql_functions_equal_the_expressions(spark):
    register(spark)
    df = spark.createDataFrame([(x,) for x in NASTY], "x string")
    pairs = {
        "normalize_label(x)": normalize.label(F.col("x")), "normalize_predicate(x)": normalize.predicate(F.col("x")), "normalize_name(x)": normalize.name(F.col("x")),
        "entity_id('City', x)": normalize.entity_id(F.lit("City"), F.col("x")), "make_children(x)": chunking.make_children(F.col("x"), 300),
        "chunk_document(x)": F.filter(F.transform(chunking.pack_paragraphs(F.col("x"), 2000, 200), strip), lambda p: F.length(p) >= 120),
    }
    for sql, column in pairs.items():
        rows = df.select("x", F.expr(sql).alias("got"), column.alias("want")).collect()
        assert [(r["x"], r["got"]) for r in rows] == [(r["x"], r["want"]) for r in rows], sql
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([1.0, None], [1.0, 1.0]), (None, [1.0]), ([1.0, 2.0], [-2.0, 1.0])], "a array<float>, b array<float>")
    rows = vectors.select(F.expr("cosine_score(a, b)").alias("got"), cosine_score(F.col("a"), F.col("b")).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and rows[0]["got"] == 1.0 and rows[1]["got"] is None


def test_every_name_gets_an_id(spark, tmp_path):
    for t, c, name in (("documents", "text", "Straße weiß\tx"), ("part", "p_name", "ßpart"), ("customer", "c_name", "c"), ("supplier", "s_name", "s")):
        spark.createDataFrame([(name,)], f"{c} string").write.parquet(f"{tmp_path}/{t}.parquet")
    got = {(r["type"], r["name"]): r["entity_id"] for r in catalog.entity_ids(spark, str(tmp_path)).collect()}
    names = [("Word", "Straße"), ("Word", "weiß"), ("Word", "x"), ("Part", "ßpart"), ("Customer", "c"), ("Supplier", "s")]
    assert got == {(t, n): hashlib.sha1(f"{t}|{normalize.py_name(n)}".encode()).hexdigest()[:24] for t, n in names}
