"""File sources: any number of paths to one row per document (doc_id, source_uri, kind, text, records).

Files are read by Spark (``binaryFile``), so paths may lie in any store; a document stays one row and its
records one array, which keeps their order. Parsing that Spark's readers cannot do exactly (ragged CSV rows,
nested JSON values, PDF) runs in one Arrow-batched pass over whole files.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError

PROSE, TABLES, OBJECTS = (".pdf", ".txt", ".md"), (".csv", ".tsv"), (".json", ".jsonl")
SUPPORTED = sorted((*PROSE, *TABLES, *OBJECTS))
#: Bytes of files whose rows a worker holds before it passes them on.
HELD = 32 << 20
UNITS = "doc_id string, source_uri string, kind string, text string, records array<string>, error string"


def suffix_of(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return "." + base.rsplit(".", 1)[1].lower() if "." in base else ""


def check_suffix(name: str) -> str:
    suffix = suffix_of(name)
    if suffix not in SUPPORTED:
        raise SourceError(f"Unsupported file type '{suffix}'. Supported: {', '.join(SUPPORTED)}")
    return suffix


def record_text(record: object) -> str:
    """``key: value`` lines; missing and empty values are left out, nested ones are JSON."""
    if not isinstance(record, dict):
        return str(record)
    shown = ((k, json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else v) for k, v in record.items() if v is not None and v != "")
    return "\n".join(f"{k}: {v}" for k, v in shown)


def table_records(raw: str, delimiter: str) -> list[str]:
    """Rows under a header; short rows lack their last fields, surplus fields are kept under no name."""
    return [record_text(row) for row in csv.DictReader(io.StringIO(raw, newline=""), delimiter=delimiter)]


def object_records(raw: str, lines: bool) -> list[str]:
    """A JSON list's elements, any other value as one record, or one value per line; one bad line fails the file."""
    if lines:
        return [record_text(json.loads(line)) for line in raw.splitlines() if line.strip()]
    data = json.loads(raw)
    return [record_text(r) for r in (data if isinstance(data, list) else [data])]


def pdf_text(content: bytes, name: str) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise SourceError("PDF support needs pypdf") from None
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    if not any(p.strip() for p in pages):
        raise SourceError(f"No text found in {name}: a scanned PDF needs OCR first")
    return "\n\n".join(p for p in pages if p.strip())


def parse(name: str, content: bytes) -> tuple[str, str | None, list[str] | None]:
    """(kind, text, records) of one file."""
    suffix = check_suffix(name)
    if suffix == ".pdf":
        return "prose", pdf_text(content, name), None
    raw = content.decode("utf-8", "replace")
    if suffix in PROSE:
        return "prose", raw.replace("\r\n", "\n").replace("\r", "\n"), None
    if suffix in TABLES:
        return "records", None, table_records(raw, "\t" if suffix == ".tsv" else ",")
    return "records", None, object_records(raw.replace("\r\n", "\n").replace("\r", "\n"), suffix == ".jsonl")


def parsed(files: DataFrame) -> DataFrame:
    """(doc_id, source_uri, content) to UNITS; a file that cannot be read becomes a row with an error.

    Rows go out whenever those held pass ``HELD`` bytes, so a worker's memory follows its largest file, not their number.
    """
    types = pa.schema([("doc_id", pa.string()), ("source_uri", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("records", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                doc_id, uri, content = (batch.column(k)[i].as_py() for k in range(3))
                try:
                    rows.append((doc_id, uri, *parse(uri, content), None))
                except (SourceError, ValueError, csv.Error) as e:
                    rows.append((doc_id, uri, None, None, None, f"{type(e).__name__}: {e}"))
                held += len(content)
                if held > HELD or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                    rows, held = [], 0

    return files.select("doc_id", "source_uri", "content").mapInArrow(run, UNITS)


def identified(files: DataFrame) -> DataFrame:
    """(path, content) to (doc_id, source_uri, content): a local file's URI becomes its plain path, whose hash is the id."""
    decoded = F.when(F.startswith("path", F.lit("file:")), F.concat(F.lit("/"), F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", ""))).otherwise(F.col("path"))
    uri = files.select(decoded.alias("source_uri"), "content")
    return uri.select(F.left(F.sha1(F.col("source_uri").cast("binary")), F.lit(24)).alias("doc_id"), "source_uri", "content")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of files, globs or folders; ids are made of the paths, so a file read again is the same document."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        files = files.select("path", "content")
    except Exception as e:
        raise SourceError(f"File not found: {', '.join(paths)}") from e
    return parsed(identified(files))


def read_uploads(spark: SparkSession, uploads: list[tuple[str, bytes]]) -> DataFrame:
    """Documents of uploaded files: ids are made of name and content, so an upload repeated is the same document."""
    for name, _ in uploads:
        check_suffix(name)
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in uploads], "source_uri string, content binary")
    ident = F.left(F.sha1(F.concat(F.col("source_uri").cast("binary"), F.lit(b"\0"), F.col("content"))), F.lit(24))
    return parsed(files.select(ident.alias("doc_id"), "source_uri", "content"))
