"""Helpers shared by the training-data operators.

``words`` throughout means maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``: exactly what
``bytes.split()`` yields, so the Python operators and the SQL class ``WORD_SQL`` agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import release, scratch, written  # noqa: F401

WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(text: Column) -> Column:
    """``text`` (null: empty) with each run of white space as one blank; plain replaces first, as most runs are single."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def words_in(text: Column) -> Column:
    """The number of words of a text (null: 0): blanks between words, and one."""
    t = F.trim(normalised(text))
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


#: Bytes of input files that one bucket of a packed shuffle stands for at most.
BUCKET = 16 << 20


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the bytes of ``df``; 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else 0


def n_buckets(df: DataFrame) -> int:
    """Buckets for packed shuffles of ``df``: a worker holds one at a time, so their number follows the input's bytes."""
    return max(8 * n_tasks(df.sparkSession), -(-input_bytes(df) // BUCKET))


def n_tasks(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def docs_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encoded(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding them."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text, so that a worker's memory does not follow the longest texts."""
    for batch in batches:
        size = max(1, batch.nbytes // limit)
        step = max(1, batch.num_rows // size)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit identities of words; two of V distinct words share one with probability below V*V/2**65."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack(buckets: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of (bucket, blob): the columns' bytes of each bucket, one column after another.

    One row per bucket instead of one per item keeps the shuffle's per-row cost out of the JVM.
    """
    order = np.argsort(buckets, kind="stable")
    buckets, columns = buckets[order], [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.empty(0, np.int64)
    ids = buckets[first]
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(first, np.append(first, len(buckets))[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def unpack(blobs: Iterable[bytes], dtypes: list[str]) -> list[np.ndarray]:
    """The inverse of ``pack`` over the blobs of one bucket."""
    width = sum(np.dtype(t).itemsize for t in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        rows, at = len(blob) // width, 0
        for part, t in zip(parts, dtypes, strict=True):
            part.append(np.frombuffer(blob, t, rows, at))
            at += rows * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, dtypes, strict=True)]


PACKED = "bucket int, blob binary"
