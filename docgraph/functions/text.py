"""Text expressions with Python's notion of white space (Unicode's, and U+001C to U+001F)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1C-\x1F]"
#: Patterns that the expressions here and the SQL functions share.
EDGES, SENTENCE_GAP, PARAGRAPH_GAP = rf"(?U)^{WS}+|{WS}+$", rf"(?U)(?<=[.!?]){WS}+", rf"(?U)\n{WS}*\n"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def tokens(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, rf"(?U){WS}+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_GAP)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, PARAGRAPH_GAP), strip), lambda p: p != "")


def preview(c: Column, n: int) -> Column:
    return F.left(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(n))
