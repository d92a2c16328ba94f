"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text, its white space normalised, is cut where its own bytes say so; each distinct chunk gets an identifier that is
verified against the chunk's bytes; a document becomes the ordered list of its identifiers (its recipe), and only
recipes are compared. Chunk bytes move once, after a partial distinct that has already merged the copies of each
task; recipes are written once (32 bytes a chunk) and whole documents never move to be compared.

A cut lies after one of a fixed set of byte pairs, about one in a hundred of all pairs and some in any script, so that it
depends on neither language nor punctuation; an insertion moves only cuts near it.

Defined results: null counts as empty, and all empty texts form one group; rows that repeat a text and an id share
their row's verdict (kept), while ``keep_first`` keeps one of them; a null id stays only where no other row has the
text; texts of any length are read whole; an empty table gives an empty result; columns other than id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import normalised, written

#: Shortest and longest chunk in bytes.
MIN_CHUNK, MAX_CHUNK = 512, 8192


def byte_class(keep) -> str:
    return "[" + "".join(f"\\x{b:02X}" for b in range(256) if keep(b)) + "]"


def cut_pattern(groups: int = 32, branches: int = 8) -> str:
    """Two bytes that end a chunk: the first one's group (all bytes are dealt into groups) names low bits of the second.

    Each value of these bits belongs to one group, so that letters of ASCII, lead and continuation bytes, and with them
    all scripts, meet cuts: about one in 64 second bytes. Groups hang on ``branches``, which spares most of their tests.
    """
    group = lambda b: b * 167 % 257 % groups
    low = lambda g: (g * 37 + 11) % 64
    pair = lambda g: byte_class(lambda b: group(b) == g) + byte_class(lambda b: (b % 64 == low(g)) if b < 128 else (b % 32 == low(g) % 32))
    branch = lambda k: f"(?={byte_class(lambda b: group(b) % branches == k)})(?:" + "|".join(map(pair, range(k, groups, branches))) + ")"
    return "(?:" + "|".join(map(branch, range(branches))) + ")"


#: What ends a chunk.
CUT = cut_pattern()


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK, cut: str = CUT) -> Column:
    """Content-defined chunks of the text's bytes, one character a byte; their concatenation is the text."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(f"(?s).{{{least - 2},{most - 2}}}?{cut}|.{{1,{most}}}"), F.lit(0))


def raw(chunk: Column) -> Column:
    """A chunk's bytes; ASCII alone, the most frequent case, needs no conversion."""
    return F.when(F.octet_length(chunk) == F.length(chunk), chunk.cast("binary")).otherwise(F.encode(chunk, "ISO-8859-1"))


def ident(chunk: Column) -> Column:
    return F.unhex(F.sha2(raw(chunk), 256))


def recipes(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """``columns`` and recipe: the ordered chunk identifiers of each row. ``t`` in them is the normalised text."""
    d = docs.withColumn("t", normalised(F.col(text_col)))
    return d.select(*columns, F.transform(chunks(F.col("t")), ident).alias("recipe"))


def verify(docs: DataFrame, text_col: str = "text") -> None:
    """Raises if an identifier stands for more than one chunk.

    The bytes are compared by grouping on them; the partial distinct runs before the shuffle.
    """
    c = docs.select(F.explode(chunks(normalised(F.col(text_col)))).alias("chunk")).select(ident(F.col("chunk")).alias("ident"), raw(F.col("chunk")).alias("chunk"))
    if not c.distinct().groupBy("ident").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise RuntimeError("two different chunks share an identifier")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    verify(docs, text_col)
    r = written(recipes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", F.col("doc_id"), F.sha2("t", 256).alias("text_sha256")), "recipes")
    # Written, so that the join deals a large group's rows over tasks: only an exchange can be split.
    groups = written(r.groupBy(F.col("recipe").alias("of")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = r.join(groups, F.col("recipe") == F.col("of"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, all columns as they came: the one with the smallest id, null last.

    Rows are told apart by a number of their own, so repeated and null ids are judged row by row.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    verify(rows, text_col)
    numbered = rows.select(F.col("__row").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = recipes(numbered, "text", F.struct(F.col("id").isNull(), F.col("id"), F.col("row")).alias("at")).groupBy("recipe").agg(F.min("at").alias("at"))
    kept = first.select(F.col("at.row").alias("__kept"))
    return rows.join(kept, rows["__row"] == kept["__kept"], "left_semi").select(docs.columns)
