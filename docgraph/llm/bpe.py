"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that no vocabulary token holds inside can never end up within one token, so every place where
such a pair meets is a certain cut: the fragments between certain cuts are encoded on their own and their ids
concatenated. A letter followed by a blank is such a pair for this family of vocabularies, which makes
words the unit that is cached; inside a word the pre-token pattern and the remaining certain cuts apply.

Decoding is a gather: each id's bytes are copied from one table by numpy.

Defined results: a null or empty text has no ids and decodes to an empty text; special-token strings in a
text become their id and back; rows that repeat an id are encoded one by one; an empty table gives an
empty result; other columns are not read. Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import docs_only, small_batches

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries that a worker caches before it starts anew: words after a blank, and other pre-tokens.
CACHE, PIECES = 500_000, 150_000


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sym = byte_symbols()
        raw = lambda s: bytes(sym[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        # Pairs that some token holds inside; all others are certain cuts.
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            t = np.frombuffer(token, np.uint8)
            inside[t[:-1], t[1:]] = True
        self.certain = ~inside
        self._cuts = {(int(a), int(b)) for a, b in np.argwhere(self.certain)}
        n = max([*self.ids.values(), *self.special.values()]) + 1
        table = [b""] * n
        for token, i in chain(self.ids.items(), ((s.encode(), i) for s, i in self.special.items())):
            table[i] = token
        self._len = np.array([len(t) for t in table], np.int64)
        self._start = np.cumsum(self._len) - self._len
        self._bytes = np.frombuffer(b"".join(table), np.uint8)
        self._pre = regex.compile(PRETOKENS)
        # A blank after anything but white space: a certain cut, also of the pre-token pattern.
        if not self.certain[[b for b in range(256) if b not in (0x20, *range(0x09, 0x0E), 0xA0)], 0x20].all():
            raise ValueError("this vocabulary has tokens with blanks inside")
        self._white = set(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._symbol = {b: c for c, b in sym.items()}
        self._pieces: dict[str, str] = {}
        self._model = Tokenizer.from_file(path).model
        self._units: dict[str, str] = {}

    def _piece(self, piece: str) -> str:
        """A pre-token: cut at its certain cuts, each fragment merged on its own by the library's BPE model."""
        raw, tokenize = piece.encode(), self._model.tokenize
        ids: list[str] = []
        start = 0
        for i, pair in enumerate(zip(raw, raw[1:]), 1):
            if pair in self._cuts:
                ids += [str(t.id) for t in tokenize(raw[start:i].decode("latin-1").translate(self._symbol))]
                start = i
        ids += [str(t.id) for t in tokenize(raw[start:].decode("latin-1").translate(self._symbol))]
        got = ",".join(ids)
        if len(piece) <= 48:  # a pre-token with its blank is a unit as well
            cache, key, most = (self._units, piece[1:], CACHE) if piece[0] == " " and not (piece[1:] or " ")[0].isspace() else (self._pieces, piece, PIECES)
            if len(cache) >= most:
                cache.clear()
            cache[key] = got
        return got

    def _unit(self, unit: str) -> str:
        pieces, units = self._pieces, self._units
        return ",".join([(units.get(p[1:]) if p[0] == " " else pieces.get(p)) or self._piece(p) for p in self._pre.findall(unit)])

    def _part(self, text: str) -> list[str]:
        """Units from one blank after a word to the next; those that end in white space go on with the next."""
        known, white = self._units, self._white
        first, *rest = text.split(" ")
        got: list[str | None] = list(map(known.get, rest))
        if not first or first[-1] in white:  # the first blank is no certain cut
            head = first
            for i, piece in enumerate(rest):
                head += " " + piece
                if piece and piece[-1] not in white:
                    break
            else:
                return [self._unit(head)] if head else []
            out, at = [self._unit(head)], i + 1
        else:
            out, at = [self._unit(first)], 0
        done = at
        while True:
            try:
                at = got.index(None, at)
            except ValueError:
                return out + got[done:]  # type: ignore[operator]
            out += got[done:at]  # type: ignore[arg-type]
            unit, piece, end = "", rest[at], at
            while not piece or piece[-1] in white:
                unit += " " + piece
                end += 1
                if end == len(rest):
                    return [*out, self._unit(unit)]
                piece = rest[end]
            decimal = self._unit(f"{unit} {piece}")
            if not unit and len(piece) <= 48:
                if len(known) >= CACHE:
                    known.clear()
                known[piece] = decimal
            out.append(decimal)
            at = done = end + 1

    def encode_decimal(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        if self._special is None or not any(s in text for s in self.special):
            return ",".join(self._part(text)) if text else ""
        out: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(str(self.special[part]))
            elif part:
                out += self._part(part)
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in s.split(",")] if (s := self.encode_decimal(text)) else []

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self._len[ids]
        ends = np.cumsum(size)
        return self._bytes[np.arange(ends[-1]) + np.repeat(self._start[ids] - ends + size, size)].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ids, and decoded unless ``with_decoded`` is false."""
    with_decoded = with_ids if with_decoded is None else with_decoded
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in small_batches(batches, 2 << 20):
            sizes, digests, texts, flat = [], [], [], []
            for text in batch.column(1).to_pylist():
                decimal = bpe.encode_decimal(text)
                ids = np.fromstring(decimal, np.int64, sep=",") if decimal else np.empty(0, np.int64)
                decoded = bpe.decode_bytes(ids).decode("utf-8", "replace").encode()
                sizes.append(len(ids))
                digests.append((hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                if with_ids:
                    flat.append(ids.astype(np.int32))
                if with_decoded:
                    texts.append(decoded.decode())
            columns = [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in (0, 1))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(flat))))
            if with_decoded:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs_only(docs, id_col, text_col).mapInArrow(run, schema)
