"""An optional provider over HTTP for services with the common chat-completions and embeddings interface (standard library only).

It is used where ``KG_API_BASE`` is set; without it the offline stand-ins serve. A service that refuses the ``dimensions``
argument is asked once more without it, and not again with it in this process.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from .config import required
from .errors import Unavailable

EXTRACT = "List the facts that the text states. Answer with JSON alone: {\"triples\": [{\"subject\": ..., \"subject_type\": ..., \"predicate\": ..., \"object\": ..., \"object_type\": ...}]}, every value a string."
WRITE = "Write one Spark SQL SELECT over the views described. Give the query alone."


class Refused(Exception):
    """An answer with status 400 and its text."""


@dataclass
class HttpClient:
    base: str
    key: str
    timeout: float = 60.0

    def post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base.rstrip('/')}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            raise Refused(text) if e.code == 400 else Unavailable(f"status {e.code}: {text[:200]}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise Unavailable(str(e)) from e

    def chat(self, model: str, system: str, user: str) -> tuple[str, dict]:
        got = self.post("chat/completions", {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]})
        return got["choices"][0]["message"]["content"], got.get("usage") or {}


@dataclass
class HttpEmbedder:
    client: HttpClient
    model: str
    dimensions: int
    _takes_dimensions: bool = field(default=True, repr=False)

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts}
        if self._takes_dimensions:
            try:
                return self._vectors(body | {"dimensions": self.dimensions})
            except Refused as e:
                if "dimensions" not in str(e):
                    raise
                self._takes_dimensions = False
        return self._vectors(body)

    def _vectors(self, body: dict) -> list[list[float]]:
        rows = sorted(self.client.post("embeddings", body)["data"], key=lambda r: r["index"])
        return [r["embedding"] for r in rows]


@dataclass
class HttpExtractor:
    client: HttpClient
    model: str

    def extract(self, text: str) -> tuple[str, dict[str, int]]:
        answer, used = self.client.chat(self.model, EXTRACT, text)
        cached = (used.get("prompt_tokens_details") or {}).get("cached_tokens", 0)
        return answer, {"input_tokens": used.get("prompt_tokens", 0), "cache_read_tokens": cached, "output_tokens": used.get("completion_tokens", 0)}


@dataclass
class HttpAnswerer:
    client: HttpClient
    model: str

    def answer(self, prompt: str) -> str:
        return self.client.chat(self.model, "Answer briefly and only from what is given.", prompt)[0]


@dataclass
class HttpWriter:
    client: HttpClient
    model: str

    def write(self, question: str, schema: str, entities: str, hint: str = "") -> str:
        return self.client.chat(self.model, f"{WRITE}\n\n{schema}\n\n{entities}", f"{question}\n{hint}".strip())[0]


def providers_from_env(env: dict[str, str] | None = None) -> dict:
    """The engine's provider arguments from KG_API_BASE, KG_API_KEY, KG_CHAT_MODEL, KG_EMBED_MODEL; none without the first."""
    env = dict(os.environ) if env is None else env
    if not env.get("KG_API_BASE", "").strip():
        return {}
    client, chat = HttpClient(required("KG_API_BASE", env), required("KG_API_KEY", env)), required("KG_CHAT_MODEL", env)
    embedder = HttpEmbedder(client, required("KG_EMBED_MODEL", env), int(env.get("KG_EMBEDDING_DIMENSIONS", "1536")))
    return {"extractor": HttpExtractor(client, chat), "embedder": embedder, "answerer": HttpAnswerer(client, chat), "writer": HttpWriter(client, chat)}
