"""Normalised labels, predicates and names, and deterministic entity ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, strip

#: Company suffixes that names lose, as whole words.
SUFFIXES = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "plc", "gmbh", "sa", "nv", "ag"]
SUFFIX = r"\b(" + "|".join(SUFFIXES) + r")\b"
#: Patterns that the expressions here and the SQL functions share.
LABEL_GAP, PREDICATE_GAP, CASE_EDGE = rf"(?U)(?:{WS}|_)+", rf"(?U)(?:{WS}|-)+", "(?<=[a-z])(?=[A-Z])"


def label(c: Column) -> Column:
    """Parts between blanks and underscores, each capitalised, joined; blank gives Entity."""
    parts = F.filter(F.split(strip(c), LABEL_GAP), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")
    return F.when(strip(c) == "", F.lit("Entity")).otherwise(joined)


def predicate(c: Column) -> Column:
    """UPPER_SNAKE_CASE; blank gives RELATED_TO."""
    snake = F.regexp_replace(F.regexp_replace(strip(c), CASE_EDGE, "_"), PREDICATE_GAP, "_")
    return F.when(strip(c) == "", F.lit("RELATED_TO")).otherwise(F.upper(snake))


@F.pandas_udf(T.StringType())
def decomposed(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII; equal names of a batch are folded once."""
    distinct = {n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names.unique()}
    return names.map(distinct)


def ascii_folded(c: Column) -> Column:
    """ASCII names, by far the most, stay in the JVM."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(plain, c).otherwise(decomposed(F.when(plain, F.lit(None)).otherwise(c)))


def name(c: Column, folded: bool = False) -> Column:
    """The form of a name that ids are made of. ``folded``: it holds ASCII only."""
    words = F.trim(F.regexp_replace(F.lower(c if folded else ascii_folded(c)), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.trim(F.regexp_replace(words, SUFFIX, "")), r"\s+", " ")


def entity_id(type_: Column, name_: Column, folded: bool = False) -> Column:
    return F.left(F.sha1(F.concat(type_, F.lit("|"), name(name_, folded)).cast("binary")), F.lit(24))


def py_name(value: str) -> str:
    """``name`` for a single value on the driver."""
    folded = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    words = re.sub(SUFFIX, "", re.sub("[^a-z0-9]+", " ", folded).strip()).strip()
    return re.sub(" +", " ", words)
