"""Substring dedup: windows of words that start earlier elsewhere, found with FM-indexes.

Blocks. The texts are cut into words once and written in compressed blocks, beside the values that route them.

Routing. Equal windows must meet in one index. Every window of ``window`` words is given the least hash of
the ``SEED``-word grams inside it, a function of its words alone; a run of windows with one such value is a
segment. A value that occurs once in the corpus cannot belong to a repeated window: each block sends its distinct values
with their counts (so a line in every document is one entry a block), and is told which of them repeat. Only segments
of those values move on. Values that occur in more than ``HOT`` segments are split: their windows are routed one by one
by a hash of the whole window. Copies of a segment merge in the mappers, which keep its first place.

Indexing. A shard of segments, in the order of their first places, becomes one text over word codes; its suffixes are
sorted by their first ``window`` symbols, and only compressed structures stay: the Burrows-Wheeler transform as a
wavelet matrix of packed bit vectors with rank counts, and one more bit vector that marks where the first ``window`` - 1
symbols change. Backward search computes the matching statistics of the streamed segments: one window's interval is
shortened by a symbol on the right and extended by one on the left to give the next. No suffix array is kept: segments
are streamed in the order of their places, so of the windows that report one interval the first to come is the first
place, and the others start earlier elsewhere.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows that
repeat an id have equal places, so neither is earlier than the other at an equal start; a null id comes first; an
empty table gives no rows; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_only, encoded, mix64, n_buckets, pack, release, small_batches, unpack, word_hashes, written

WINDOW, SEED, HOT = 20, 8, 2000
#: Symbols of one index: a shard larger than this is indexed in blocks of whole routes.
BLOCK = 1_000_000
NULL_ID = -(1 << 63)


def grams(h: np.ndarray, seed: int) -> np.ndarray:
    n = len(h) - seed + 1
    g = h[:n]
    for j in range(1, seed):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    return mix64(g)


def segments(h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, windows) of each run of windows with one least gram hash."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m, have, want = grams(h, seed), 1, window - seed + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    start = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    return m[start], start, np.diff(np.append(start, len(m)))


def seed_values(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """One value per segment, and a second for a segment that holds its gram twice: it may repeat a window itself."""
    value, start, count = segments(h, window, seed)
    if not len(value):
        return value
    g, span = grams(h, seed), count + window - seed
    first = np.cumsum(span) - span
    same = g[np.repeat(start - first, span) + np.arange(span.sum())] == np.repeat(value, span)
    return np.concatenate([value, value[np.add.reduceat(same, first, dtype=np.int64) > 1]])


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    n = len(h) - window + 1
    g = h[:n]
    for j in range(1, window):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[j : n + j]
    return mix64(g)


def pieces(h: np.ndarray, wanted: np.ndarray, hot: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, start, windows) of the segments whose value is wanted; hot ones as single windows."""
    value, start, count = segments(h, window, seed)
    keep, split = among(value, wanted), among(value, hot)
    route, at, n = value[keep & ~split], start[keep & ~split], count[keep & ~split]
    if (keep & split).any():
        s, c = start[keep & split], count[keep & split]
        single = np.repeat(s - (np.cumsum(c) - c), c) + np.arange(c.sum())
        route = np.concatenate([route, window_hashes(h, window)[single]])
        at, n = np.concatenate([at, single]), np.concatenate([n, np.ones(len(single), np.int64)])
    return route, at, n


class Bits:
    """A packed bit vector with counts per 64 bits: ones before a place, and the place of the k-th one."""

    def __init__(self, bit: np.ndarray) -> None:
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.counts = (np.cumsum(ones) - ones).astype(np.int32)
        self.ones, self.n = int(ones.sum()), len(bit)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 0; the length of the vector for k = ``ones``."""
        word = np.searchsorted(self.counts, k, side="right") - 1
        left, w, at = k - self.counts[word], self.words[word], word << 6
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(w & np.uint64((1 << half) - 1))
            up = left >= low
            left, at, w = np.where(up, left - low, left), np.where(up, at + half, at), np.where(up, w >> np.uint64(half), w)
        return np.where(k >= self.ones, self.n, at)


class WaveletMatrix:
    """Rank over a sequence of codes: one packed bit vector for each bit of a code."""

    def __init__(self, codes: np.ndarray, sigma: int) -> None:
        self.bits, self.zeros = [], []
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((codes >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(len(codes) - self.bits[-1].ones)
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
        self.base = self.walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            ones = bits.rank(at)
            at = np.where((symbol >> (len(self.bits) - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.walk(symbol, at) - self.base[symbol]


class FMIndex:
    """Intervals of patterns up to ``depth`` symbols of a text of codes, in packed bits alone."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        n = len(text)
        self.depth = depth
        rank, have = text.astype(np.int64), 1
        shorter = rank
        while True:  # ranks by the first ``have`` symbols; ``step`` more at a time
            step = min(have, depth - have)
            if not step:
                break
            key = rank * np.int64(n + sigma + 1)
            key[: n - step] += rank[step:] + 1
            if have + step == depth:
                shorter_key = rank * np.int64(n + sigma + 1)
                if step > 1:
                    shorter_key[: n - step + 1] += rank[step - 1 :] + 1
                shorter = shorter_key
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            have += step
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int64), sigma)
        # Where suffixes' first depth - 1 symbols change: what an interval becomes when its last symbol goes.
        s = shorter[order]
        self.heads = Bits(np.concatenate([[True], s[1:] != s[:-1]]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals of symbol + pattern."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        c = self.first[symbol]
        return c + both[: len(lo)], c + both[len(lo) :]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns of full depth without their last symbol."""
        r = self.heads.rank(lo + 1)
        return self.heads.select(r - 1), self.heads.select(r)


def matching_intervals(index: FMIndex, text: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lo, hi) of every window that starts at start .. start + count - 1, streamed in lockstep.

    The matching statistic of each of these places is the full depth, as their text is part of the index;
    hi - lo is the number of places where the window starts.
    """
    depth = index.depth
    per = -(-count // most)
    of = np.repeat(np.arange(len(start)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    begin, n = start[of] + k * most, np.minimum(count[of] - k * most, most)
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    out = ([], [], [])
    for a in range(0, len(begin), 65536):
        b, m = begin[a : a + 65536], n[a : a + 65536]
        last = b + m - 1
        lo, hi = np.zeros(len(b), np.int64), np.full(len(b), len(text), np.int64)
        for j in range(depth - 1, -1, -1):
            lo, hi = index.extend(text[last + j], lo, hi)
        for step in range(int(m.max())):
            if step:
                live = np.searchsorted(-m, -step, side="left")  # those with more than ``step`` windows
                last, lo = last[:live], lo[:live]
                lo, hi = index.shorten(lo)
                lo, hi = index.extend(text[last - step], lo, hi)
            for o, v in zip(out, (last - step, lo, hi), strict=True):
                o.append(v)
    return tuple(np.concatenate(o) for o in out)


def judge_block(texts: list[bytes], window: int) -> list[np.ndarray]:
    """For segments in the order of their first places: which windows start earlier, in another or the same one."""
    codes: dict[bytes, int] = {}
    words = [t.split(b" ") for t in texts]
    size = np.array([len(ws) + 1 for ws in words], np.int64)
    flat = np.zeros(int(size.sum()), np.int64)  # 0 ends each segment
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(size) - 1] = False
    flat[inside] = [codes.setdefault(w, len(codes) + 1) for ws in words for w in ws]
    start = np.cumsum(size) - size
    count = size - window
    index = FMIndex(flat, int(flat.max()) + 1, window)
    place, lo, _ = matching_intervals(index, flat, start, count)
    earlier = np.zeros(len(flat), bool)
    order = np.lexsort([place, lo])
    again = lo[order][1:] == lo[order][:-1]
    earlier[place[order][1:][again]] = True
    return [earlier[s : s + c] for s, c in zip(start, count, strict=True)]


def judge(route: np.ndarray, doc: np.ndarray, at: np.ndarray, many: np.ndarray, texts: list[bytes], window: int, block: int = BLOCK) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key, first document, first start, mask) of the distinct segments of a shard that have anything to remove."""
    order = np.lexsort([at, doc, route])
    size = np.array([len(t) // 2 + 1 for t in texts], np.int64)[order] if len(order) else np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(route[order])) + 1
    a = 0
    while a < len(order):
        reach = np.searchsorted(np.cumsum(size[a:]), block * 4) + a
        past = np.searchsorted(edge, reach, side="right")
        b = int(edge[past - 1]) if past and edge[past - 1] > a else int(edge[past]) if past < len(edge) else len(order)
        rows = order[a:b]
        rows = rows[np.lexsort([at[rows], doc[rows]])]
        for i, mask in zip(rows, judge_block([texts[i] for i in rows], window), strict=True):
            if many[i] or mask.any():
                yield xxhash.xxh3_128_digest(texts[i]), int(doc[i]), int(at[i]), np.packbits(mask).tobytes()
        a = b


def _sent(buckets: dict[int, dict[bytes, list]]) -> pa.RecordBatch:
    """Distinct segments of each bucket in one blob: five arrays and the texts."""
    ids, blobs = [], []
    for bucket, found in buckets.items():
        head = np.array([len(found)], np.int64).tobytes()
        columns = [np.array([v[k] for v in found.values()], t).tobytes() for k, t in enumerate(("u8", "i8", "i8", "i8"))]
        ids.append(bucket)
        blobs.append(b"".join([head, *columns, b"\n".join(found)]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


BLOCKS = ["block", "ids", "lengths", "words", "bucket", "blob"]


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row; with ``spans`` also kept (the words left) and removed_spans."""
    n = n_buckets(docs)
    d = docs_only(docs, id_col, text_col)

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row with the texts of each block, words joined by one blank, and rows of (bucket, values, their counts)."""
        part, k = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, 8 << 20):
            for i in range(0, batch.num_rows, 1 << 16):
                b = batch.slice(i, 1 << 16)
                split = [t.split() for t in encoded(b)]
                joined = [b" ".join(w) for w in split]
                value, times = np.unique(np.concatenate([seed_values(word_hashes(w), window, seed) for w in split]), return_counts=True)
                sent = pack((value % np.uint64(n)).astype(np.int32), [value, times.astype("u4")])
                block, text = (part << 24) + k, b"".join(joined)
                rows = [[block, ids_of(b).tobytes(), np.array([len(t) for t in joined], np.int64).tobytes(), pa.compress(text, "zstd", asbytes=True), None, None]]
                rows += [[block, None, None, None, bucket, blob] for bucket, blob in zip(*(c.to_pylist() for c in sent.columns), strict=True)]
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], BLOCKS)

    blocks = written(d.mapInArrow(make_blocks, "block long, ids binary, lengths binary, words binary, bucket int, blob binary"), "blocks")

    def repeats(table: pa.Table) -> pa.Table:
        """For each block, those of its values of this bucket that occur twice or more anywhere, and the frequent ones."""
        parts = [unpack([blob], ["u8", "u4"]) for blob in table["blob"].to_pylist()]
        value, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        every, of = np.unique(value, return_inverse=True)
        total = np.bincount(of, times)[of]
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        keep, often = np.split(total > 1, cuts), np.split(total > hot, cuts)
        return pa.table([table["block"], pa.array([p[0][k].tobytes() for p, k in zip(parts, keep, strict=True)], pa.binary()), pa.array([p[0][k].tobytes() for p, k in zip(parts, often, strict=True)], pa.binary())], ["block", "wanted", "hot"])

    answers = blocks.where("blob IS NOT NULL").select("bucket", "block", "blob").groupBy("bucket").applyInArrow(repeats, "block long, wanted binary, hot binary")

    work_schema = "row long, doc_id long, n_words long, kept_sha256 string, words binary, route binary, start binary, windows binary"

    def cut(block: pa.Table, told: pa.Table) -> pa.Table:
        wanted, hots = (np.sort(np.frombuffer(b"".join(told[c].to_pylist()), np.uint64)) for c in ("wanted", "hot"))
        (name, ids, lengths, packed) = block.to_pylist()[0].values()
        ids, lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        text = pa.decompress(packed, int(lengths.sum()), "zstd", asbytes=True)
        out: list[list] = [[] for _ in range(6)]
        for end, length in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
            joined = text[end - length : end]
            words = joined.split()
            row = [len(words), None, None, None, None, None]
            route, start, count = pieces(word_hashes(words), wanted, hots, window, seed)
            if len(route):
                row[2:] = [joined, route.tobytes(), start.astype("i8").tobytes(), count.astype("i8").tobytes()]
            else:
                row[1:3] = [hashlib.sha256(joined).hexdigest(), joined if spans else None]
            for column, v in zip(out, row, strict=True):
                column.append(v)
        types = [pa.int64(), pa.string(), *[pa.binary()] * 4]
        # A row's number: 2**16 rows a block at most.
        rows = [pa.array((name << 16) + np.arange(len(ids))), pa.array(ids, mask=ids == NULL_ID)]
        return pa.table([*rows, *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], [f.split()[0] for f in work_schema.split(", ")])

    texts = blocks.where("blob IS NULL").select("block", "ids", "lengths", "words")
    work = written(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, work_schema), "windows")
    release(blocks)
    cutted = work.where(F.col("route").isNotNull())

    def parts(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, bytes, int, int, int]]:
        """(id or row, words, route, start, windows) of each segment; ``first`` is the column to begin with."""
        head = ids_of(batch) if first == 0 else batch.column(first).to_numpy()
        for doc_id, text, route, start, count in zip(head, *(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            words = text.split(b" ")
            for r, s, c in zip(np.frombuffer(route, np.uint64).tolist(), np.frombuffer(start, "i8").tolist(), np.frombuffer(count, "i8").tolist(), strict=True):
                yield int(doc_id), b" ".join(words[s : s + c + window - 1]), r, s, c

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, dict[bytes, list]] = {}
        held = 0
        for batch in small_batches(batches, 4 << 20):
            for doc_id, text, r, s, _ in parts(batch, 0):
                mine = buckets.setdefault(r % n, {})
                have = mine.get(text)
                if have is None:
                    mine[text] = [r, doc_id, s, 0]
                    held += len(text) + 400
                else:
                    have[3] = 1
                    if (doc_id, s) < (have[1], have[2]):
                        have[1:3] = doc_id, s
            if held > 200 << 20:
                yield _sent(buckets)
                buckets, held = {}, 0
        if buckets:
            yield _sent(buckets)

    verdict_schema = "key binary, first_doc long, first_start long, mask binary"

    def shard(table: pa.Table) -> pa.Table:
        merged: dict[bytes, list] = {}
        for blob in table["blob"].to_pylist():
            rows = int(np.frombuffer(blob, np.int64, 1)[0])
            columns = [np.frombuffer(blob, t, rows, 8 + 8 * rows * k).tolist() for k, t in enumerate(("u8", "i8", "i8", "i8"))]
            for text, r, doc_id, s, many in zip(blob[8 + 32 * rows :].split(b"\n"), *columns, strict=True):
                have = merged.get(text)
                if have is None:
                    merged[text] = [r, doc_id, s, many]
                else:
                    have[3] = 1
                    if (doc_id, s) < (have[1], have[2]):
                        have[1:3] = doc_id, s
        values = list(merged.values())
        route, doc, at, many = (np.array([v[k] for v in values], t) for k, t in enumerate(("u8", "i8", "i8", "i8")))
        rows = list(zip(*judge(route, doc, at, many, list(merged), window), strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [f.split()[0] for f in verdict_schema.split(", ")])

    texts = cutted.select("doc_id", "words", "route", "start", "windows")
    verdicts = texts.mapInArrow(distinct, "bucket int, blob binary").groupBy("bucket").applyInArrow(shard, verdict_schema)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            own = dict(zip(batch.column(5).to_pylist(), ids_of(batch).tolist(), strict=True))
            got = [(xxhash.xxh3_128_digest(text), row, own[row], s, c) for row, text, _, s, c in parts(batch, 5)]
            columns = list(zip(*got, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["of", "row", "owner", "start", "windows"])

    # A copy loses all its windows; the first place of a segment loses those that start earlier elsewhere.
    placed = cutted.select("doc_id", "words", "route", "start", "windows", "row")
    seen = placed.mapInArrow(occurrences, "of binary, row long, owner long, start long, windows long").join(verdicts, F.col("of") == F.col("key"))
    own = (F.col("owner") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    gone = seen.select(F.col("row").alias("of_row"), F.struct("start", "windows", F.when(own, F.col("mask")).alias("mask")).alias("g")).groupBy("of_row").agg(F.collect_list("g").alias("gone"))
    final_schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept binary, removed_spans array<long>" if spans else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            out: list[list] = [[] for _ in range(4)]
            for text, gone_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split(b" ") if text else []
                change = np.zeros(len(words) + 1, np.int64)
                for g in gone_ or []:
                    s, c = g["start"], g["windows"]
                    hit = np.arange(c) if g["mask"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(g["mask"], np.uint8), count=c))
                    hit = hit[hit + s + window <= len(words)]
                    np.add.at(change, s + hit, 1)
                    np.add.at(change, s + hit + window, -1)
                off = np.cumsum(change[:-1]) > 0
                kept = b" ".join(w for w, x in zip(words, off.tolist(), strict=True) if not x)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], off.astype(np.int8), [0]])))
                for column, v in zip(out, (int(off.sum()), hashlib.sha256(kept).hexdigest(), kept, edges.tolist()), strict=True):
                    column.append(v)
            types = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            n_words = pa.array([len(t.split(b" ")) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            names = [f.split()[0] for f in final_schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, *arrays[: len(names) - 2]], names)

    touched = cutted.select("row", "doc_id", "words").join(gone, F.col("row") == F.col("of_row"), "left").select("doc_id", "words", "gone")
    rest = work.where(F.col("route").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.col("words").alias("kept"), F.array().cast("array<long>").alias("removed_spans")] if spans else []))
    return touched.mapInArrow(remove, final_schema).unionByName(rest)
