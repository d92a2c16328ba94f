import json

import pytest

from docgraph.errors import SourceError
from docgraph.sources.readers import SUPPORTED, check_suffix, object_records, read_files, read_uploads, record_text, table_records


def test_records():
    assert record_text({"a": 1, "b": None, "c": "", "d": False, "e": 0, "f": {"x": [1, "é"]}}) == 'a: 1\nd: False\ne: 0\nf: {"x": [1, "é"]}'
    assert record_text("plain") == "plain"
    assert table_records('a,b\n1,"x, ""y""\nz"\n\n2\n3,4,5\n', ",") == ['a: 1\nb: x, "y"\nz', "a: 2", 'a: 3\nb: 4\nNone: ["5"]']
    assert table_records("a\ta\n1\t2\n", "\t") == ["a: 2"]
    assert object_records('[{"a": 1}, 2]', False) == ["a: 1", "2"]
    assert object_records('{"a": {"b": null}}', False) == ['a: {"b": null}']
    assert object_records('{"a": 1}\n\n{"a": 2}\n', True) == ["a: 1", "a: 2"]
    with pytest.raises(json.JSONDecodeError):
        object_records('{"a": 1}\n{bad\n', True)


def test_suffixes():
    assert check_suffix("A/B.MD") == ".md"
    with pytest.raises(SourceError, match="Unsupported file type '.exe'"):
        check_suffix("x.exe")
    assert SUPPORTED == [".csv", ".json", ".jsonl", ".md", ".pdf", ".tsv", ".txt"]


def test_files(spark, tmp_path):
    (tmp_path / "a b+c.txt").write_bytes(b"caf\xe9\r\nnext")
    (tmp_path / "t.csv").write_text("x,y\n1,2\n")
    (tmp_path / "bad.jsonl").write_text("{")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "n.bin").write_bytes(b"x")
    (tmp_path / "empty.txt").write_bytes(b"")  # files without bytes give no row
    rows = {r["source_uri"].rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert rows["a b+c.txt"]["text"] == "caf�\nnext" and rows["a b+c.txt"]["kind"] == "prose"
    assert rows["t.csv"]["records"] == ["x: 1\ny: 2"]
    assert "JSONDecodeError" in rows["bad.jsonl"]["error"] and rows["p.pdf"]["error"] and "Unsupported" in rows["n.bin"]["error"]
    again = {r["source_uri"]: r["doc_id"] for r in read_files(spark, [str(tmp_path / "t.csv")]).collect()}
    assert again == {rows["t.csv"]["source_uri"]: rows["t.csv"]["doc_id"]}
    with pytest.raises(SourceError, match="not found"):
        read_files(spark, str(tmp_path / "none.txt"))


def test_uploads_are_known_by_name_and_content(spark):
    one = read_uploads(spark, [("a.txt", b"x")]).first()["doc_id"]
    assert one == read_uploads(spark, [("a.txt", b"x")]).first()["doc_id"] != read_uploads(spark, [("a.txt", b"y")]).first()["doc_id"]
