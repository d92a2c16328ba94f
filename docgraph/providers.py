"""Model interfaces, and deterministic offline stand-ins used by default and in tests."""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Protocol


class Extractor(Protocol):
    def extract(self, text: str) -> tuple[str, dict[str, int]]:
        """The raw JSON answer for a chunk, and token counts (input, cached, output)."""


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector per text, in order."""


class Answerer(Protocol):
    def answer(self, prompt: str) -> str: ...


class QueryWriter(Protocol):
    def write(self, question: str, schema: str, entities: str, hint: str = "") -> str:
        """A single SELECT over the kg_* views."""


class PatternExtractor:
    """Facts of the form ``<Name> <verb> <Name>`` between capitalised names: a stand-in without a model."""

    FACT = re.compile(r"\b([A-Z][\w&]*(?: [A-Z][\w&]*)*) (acquired|founded|employs|supplies|owns|joined|leads) ([A-Z][\w&]*(?: [A-Z][\w&]*)*)")

    def extract(self, text: str) -> tuple[str, dict[str, int]]:
        found = [{"subject": a, "subject_type": "Entity", "predicate": verb, "object": b, "object_type": "Entity"} for a, verb, b in self.FACT.findall(text)]
        return json.dumps({"triples": found}), {"input_tokens": len(text) // 4, "cache_read_tokens": 0, "output_tokens": 8 * len(found)}


class HashEmbedder:
    """Signed word hashing to unit vectors: texts that share words are near."""

    def __init__(self, dimensions: int = 1536) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


class EchoAnswerer:
    """Returns the part of the prompt that an answer would rest on."""

    def answer(self, prompt: str) -> str:
        return prompt.split("\nPASSAGES\n", 1)[-1].strip()[:500]


class NeighbourWriter:
    """All facts of the entities that the question names."""

    def write(self, question: str, schema: str, entities: str, hint: str = "") -> str:
        words = [w.strip("?,.'\"!").lower() for w in question.split() if len(w) >= 3]
        terms = " OR ".join(f"contains(lower(source), '{w}') OR contains(lower(target), '{w}')" for w in (re.sub(r"[^\w ]", "", w) for w in words) if w) or "true"
        return f"SELECT source, relationship, target FROM kg_facts WHERE {terms} ORDER BY source, relationship, target LIMIT 25"
