"""Token-id files: Parquet list columns with dictionary or delta encoding, sized row groups and page indexes.

Documents are range-partitioned by id (and a hash of the text, which splits an id that many rows repeat) before they
are encoded, so each task writes a contiguous range of ids in ascending order and the encoder runs once per text.
A row keeps (doc_id, n_tokens, part, start_in_part, tokens): metadata reads touch only the small columns, and with
the page index a read of some ids (``read_selected``) touches only their pages. ``start`` of a document is the tokens
of all parts before plus its start in the part; parts are numbers, so neither file names nor how many files a task
writes matter.

With the vocabulary's known normaliser and pre-tokeniser, which never look across white space, words between ASCII
white space are encoded one by one and cached; a vocabulary of another form is encoded text by text by the library.

Defined results: a null or empty text holds the end id alone; special-token strings in a text become their
ids; rows that repeat an id are ordered by a hash of their text, then the text; a null id comes first; an empty table
writes no rows and reads as none; other columns are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import docs_only, n_tasks, small_batches

#: Words of one generation of a worker's cache.
CACHE = 300_000
SCHEMA = "doc_id long, n_tokens long, part int, start_in_part long, tokens array<int>"
#: Row groups of 16 MB keep a writer's buffer and a selective read small; format v2 falls back from dictionary to delta encoding.
PARQUET = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.size": 256 << 10, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20}
#: Fixed value: the vocabulary's pre-token pattern, for lower-case words of ASCII and Latin-1 letters.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]{1,48}").fullmatch
#: The normaliser and the pre-token pattern for which encoding word by word is right.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a vocabulary file has the form that the word cache and its patterns assume."""
    normaliser, before = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, level = before[0], before[-1]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) or not t["content"].startswith("<|") for t in spec["added_tokens"])
    return (
        plain
        and normaliser == NORMALISER
        and len(before) == 2
        and (split["type"], split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": PATTERN}, "Removed", True)
        and (level["type"], level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


class WordEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self.model = self.full.model
        self.symbol = {b: c for c, b in byte_symbols().items()}
        self.code = "H" if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.type = np.uint16 if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        # Two generations: words that come again move to the younger, and only the older is dropped.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        got = self.older.get(word) or self._ids(word)
        if len(word) <= 48:
            if len(self.known) >= CACHE:
                self.known, self.older = {}, self.known
            self.known[word] = got
        return got

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone
            return self._piece(word.lower().decode())
        text = word.decode("utf-8", "replace")
        if PLAIN(text) and "<|" not in text:  # a piece of a word is a word itself, often one that is known
            known, older, piece = self.known.get, self.older.get, self._piece
            if word.isascii():
                return b"".join([known(p) or older(p) or piece(p.decode()) for p in ASCII_PIECES(word.lower())])
            return b"".join([piece(p) for p in PIECES.findall(text.lower())])
        return array(self.code, self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.symbol)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_many(pa.array([text.decode("utf-8", "replace")], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, how many each has): a batch's distinct words are looked up once."""
        if not self.by_words:
            got = [e.ids for e in self.full.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], self.type), np.array([len(x) for x in got], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().cast(pa.large_binary()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        got = list(map(self.known.get, distinct))
        got = [g if g is not None else self.word(w) if w else b"" for g, w in zip(got, distinct, strict=True)]
        flat = np.frombuffer(b"".join(got), self.type)
        size = np.fromiter(map(len, got), np.int64, len(got)) // flat.itemsize
        of = words.indices.to_numpy()
        n = size[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        shift = (np.cumsum(size) - size)[of] - ends[:-1]
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        return flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(shift.astype(np.int32), n)], np.diff(ends[cuts])  # a batch is small


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = load(vocabulary), 0, TaskContext.get().partitionId()
        for batch in small_batches(batches, 8 << 20):
            ids, n = encoder.encode_many(batch.column(1))
            flat = np.full(len(ids) + len(n), end_id, np.int32)
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            n = n + 1
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), tokens], ["doc_id", "n_tokens", "part", "start_in_part", "tokens"])

    d = docs_only(docs, id_col, text_col).withColumn("at", F.xxhash64("text"))
    ordered = d.repartitionByRange(n_tasks(docs.sparkSession), "doc_id", "at").sortWithinPartitions("doc_id", "at", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**PARQUET).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens); ``start`` counts the ids of all documents before."""
    return started(spark.read.schema(SCHEMA).parquet(path), spark.read.schema(SCHEMA).parquet(path))


def read_selected(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """``read_tokens`` for some ids: the filter reaches the files, whose indexes leave out other row groups and pages."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return started(files.where(F.col("doc_id").isin([int(i) for i in ids])), files)


def started(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row per part is summed up; only ``part`` and ``n_tokens`` are read for that."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, F.col("part") == F.col("of")).select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")


def with_crc(tokens: DataFrame) -> DataFrame:
    """``tokens`` replaced by the unsigned crc32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, cuts = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
