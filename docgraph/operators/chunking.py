"""Parent chunks and children, packed by greedy folds over arrays: expressions only, one row per document.

Fold state is a struct of the finished pieces and an open buffer; a document's pieces never leave its row until
they are exploded with their positions, so no order is ever taken from partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import paragraphs, sentences, strip, tokens

RECORD_SEPARATOR = "\n---\n"
_STATE = "struct<done:array<string>,open:string>"


def pack(units: Column, budget: int, joiner: str = " ", oversized: Callable[[Column], Column] | None = None, overlap: int = 0) -> Column:
    """Greedy packing: a unit joins the buffer while both fit the budget, else the buffer is done.

    ``oversized`` splits units beyond the budget; their pieces stand alone and nothing is packed onto them. With
    ``overlap``, a new buffer starts with the last characters of the one before (and so may pass the budget).
    """

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open")).cast(_STATE)

    def flushed(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))

    def step(s: Column, u: Column) -> Column:
        fits = F.length(s["open"]) + len(joiner) + F.length(u) <= budget
        fresh = strip(F.concat(F.right(s["open"], F.lit(overlap)), F.lit(joiner), u)) if overlap else u
        out = (
            F.when(s["open"] == "", state(s["done"], u))
            .when(fits, state(s["done"], F.concat(s["open"], F.lit(joiner), u)))
            .otherwise(state(F.array_append(s["done"], s["open"]), fresh))
        )
        if oversized is None:
            return out
        return F.when(F.length(u) > budget, state(F.concat(flushed(s), oversized(u)), F.lit(""))).otherwise(out)

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(units, start, step, flushed)


def split_long(text: Column, budget: int) -> Column:
    """Sentences packed to the budget; a longer sentence stays whole."""
    return pack(sentences(text), budget)


def hard_split(text: Column, budget: int) -> Column:
    """Words packed to the budget; a longer word stands alone."""
    return pack(tokens(text), budget)


def pack_paragraphs(text: Column, budget: int, overlap: int) -> Column:
    return pack(paragraphs(text), budget, "\n\n", lambda p: split_long(p, budget), overlap)


def pack_records(records: Column, budget: int) -> Column:
    """Whole records joined by a rule; each costs its length and the rule's."""
    kept = F.filter(F.transform(records, strip), lambda r: r != "")
    cost = len(RECORD_SEPARATOR)
    kind = "struct<done:array<string>,open:array<string>,size:int>"

    def state(done: Column, open_: Column, size: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), size.alias("size")).cast(kind)

    def step(s: Column, r: Column) -> Column:
        more = F.length(r) + cost
        full = (F.size(s["open"]) > 0) & (s["size"] + more > budget)
        closed = F.array_append(s["done"], F.array_join(s["open"], RECORD_SEPARATOR))
        return F.when(full, state(closed, F.array(r), more)).otherwise(state(s["done"], F.array_append(s["open"], r), s["size"] + more))

    none = F.array().cast("array<string>")
    done = lambda s: F.when(F.size(s["open"]) == 0, s["done"]).otherwise(F.array_append(s["done"], F.array_join(s["open"], RECORD_SEPARATOR)))
    return F.aggregate(kept, state(none, none, F.lit(0)), step, done)


def split_units(text: Column) -> Column:
    """Records where a rule stands in the text, sentences elsewhere."""
    records = F.split(text, "\n---\n")
    units = F.when(F.contains(text, F.lit(RECORD_SEPARATOR)), records).otherwise(sentences(text))
    return F.filter(F.transform(units, strip), lambda u: u != "")


def make_children(text: Column, budget: int) -> Column:
    return pack(split_units(text), budget, oversized=lambda u: hard_split(u, budget))


def make_chunks(docs: DataFrame, pieces: Column, min_chars: Column, doc_id: str = "doc_id") -> DataFrame:
    """(chunk_id, doc_id, text, seq, content_hash): stripped pieces long enough, numbered densely."""
    kept = F.filter(F.transform(pieces, strip), lambda t: F.length(t) >= min_chars)
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.posexplode(kept).alias("seq", "text"))
    return rows.select(F.concat("doc_id", F.lit(":"), F.col("seq")).alias("chunk_id"), "doc_id", "text", "seq", F.sha1(F.col("text").cast("binary")).alias("content_hash"))


def children_of(chunks: DataFrame, budget: int) -> DataFrame:
    """(child_id, chunk_id, text, seq)."""
    rows = chunks.select("chunk_id", F.posexplode(make_children(F.col("text"), budget)).alias("seq", "text"))
    return rows.select(F.concat("chunk_id", F.lit("#"), F.col("seq")).alias("child_id"), "chunk_id", "text", "seq")


def content_hashes(chunks: DataFrame) -> DataFrame:
    """(doc_id, content_hash): a hash of the chunks' hashes in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content_hash"))), lambda x: x["content_hash"])
    return chunks.groupBy("doc_id").agg(F.sha1(F.array_join(ordered, "").cast("binary")).alias("content_hash"))


def chunk_documents(units: DataFrame, config: EngineConfig) -> DataFrame:
    """Chunks of read sources (doc_id, kind, text, records): prose by paragraphs, records by whole records."""
    prose = F.col("kind") == "prose"
    pieces = F.when(prose, pack_paragraphs(F.col("text"), config.max_chunk_chars, config.chunk_overlap)).otherwise(pack_records(F.col("records"), config.max_chunk_chars))
    return make_chunks(units, pieces, F.when(prose, config.min_chunk_chars).otherwise(config.min_record_chars))


def contextualized(child: Column, parent: Column, source: Column, prefix: int) -> Column:
    """What is embedded for a child: its source, the head of its parent, and itself."""
    head = F.array_join(tokens(F.left(parent, F.lit(prefix))), " ")
    return F.concat(source, F.lit(" | "), head, F.lit("\n"), child)
