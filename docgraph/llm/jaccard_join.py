"""N-gram Jaccard join: an exact metric-space self-join of documents as sets of word shingles.

Distance is one less the Jaccard similarity, a metric; documents link within ``eps`` = 1 - 3/4.

1. Identical sets are one point (64-bit set hashes name the points).
2. First pivots are single shingles: a set is at distance below 1 from the pivots it holds. Under one global
   order (rare shingles first, then by hash), two linked sets of n and m shingles share at least
   need = 1 + min(n, m) // 16 of their first n - ceil(3n/4) + need shingles each, so a point is replicated to
   these pivots' regions and no other. Regions of up to ``PAIRS`` points propose their pairs, larger ones a
   star (of which a batch sends one point, where the counters show that the region is crowded); pairs whose
   sizes or ranks rule a link out, or that meet in too few regions, go.
3. What is left falls into blocks (connected candidates), none linked with another. In a block, documents
   become pivots: distances to them make Voronoi regions, a point is replicated to another region if the
   triangle inequality allows a link (its distance there is within 2 eps of its own), and regions are
   joined recursively; small ones compare what is not connected yet. Every link found is verified exactly.
   Blocks above ``LIMIT`` points are dealt over tasks by the same rule: their points meet ``PIVOTS`` pivots part by
   part; points linked to a pivot take its class; those outside the block's largest class visit the regions that the
   inequality leaves open to them, cell by cell, and only there are pairs compared. No task holds more than one
   cell (about ``LIMIT`` points and as many visitors), whatever the block's size.

How common a shingle is comes from one table of counters, of bounded size, to which every distinct set of a batch adds;
it only orders shingles, so any table gives the same result. Shingle and set hashes are 64 bits wide; all else is exact.
Texts are cut into shingles twice (points and counters, then regions), and a third time where they are candidates:
their shingles would take more room than the texts.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own
component; a text of fewer than five words is one shingle; rows that repeat an id get the same component if
their sets link, and each is reported; a null id is never a component's name unless it stands alone; an empty
table gives no rows; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, docs_only, encoded, input_bytes, mix64, n_buckets, pack, release, small_batches, unpack, word_hashes, written

SHINGLE = 5
#: Regions up to PAIRS points propose pairs.
PAIRS = 256
LEAF = 32
#: Points (and bytes of their sets) of a block that one task joins; larger blocks are dealt over tasks by so many pivots.
LIMIT, LIMIT_BYTES, PIVOTS = 512, 64 << 20, 8
#: Bits that name a counter, at least and at most: the table of counters takes 2**24 bytes where it is used.
COUNTERS = (16, 24)
SLICES = 16
#: The rank of a point that stands for others of a crowded region.
STAR = 0xFFFF_FFFF
#: Distances are at least 1 / (n + m) apart where they differ: this covers rounding.
SLACK = 1e-9


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    m = len(h) - width + 1
    g = h[:m] + np.uint64(width)
    for j in range(1, width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j]
    return np.unique(mix64(g))


def set_key(s: np.ndarray) -> int:
    """The point's name, as a signed 64-bit number."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), ">i8")[0])


def linked(both, n, m):
    """100 * intersection >= 75 * union, in integers."""
    return 7 * both >= 3 * (n + m)


def need(n):
    """Shingles that a set must share with a linked one among the first ``reach`` of both."""
    return 1 + n // 16


def reach(n):
    """With c = ceil(3n/4) shared at least, the need-th shared one has c - need shared ones after it."""
    return n - (3 * n + 3) // 4 + need(n)


class Sets:
    """Sorted sets in one array, with distances to any of them, and a union-find over them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.start = np.cumsum(self.n) - self.n
        self.parent = list(range(len(sets)))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def get(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.n[i]]

    def shared(self, pivot: int, ids: np.ndarray) -> np.ndarray:
        """The intersections of ``pivot`` with each of ``ids``."""
        p, n = self.get(pivot), self.n[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        values = self.flat[at]
        k = np.minimum(np.searchsorted(p, values), len(p) - 1)
        return np.add.reduceat((p[k] == values).astype(np.int64), np.cumsum(n) - n)


def join(s: Sets, ids: np.ndarray) -> None:
    """Unite all points of ``ids`` that links connect; a stack instead of recursion."""
    stack = [ids]
    while stack:
        ids = stack.pop()
        roots = {s.find(int(i)) for i in ids}
        if len(roots) < 2:
            continue
        if len(ids) <= LEAF:
            compare(s, ids, ids)
            continue
        # Pivots: a first point, then those farthest from all pivots so far.
        pivots, distance = [int(ids[0])], []
        while True:
            p = pivots[-1]
            both = s.shared(p, ids)
            for i in ids[linked(both, s.n[ids], s.n[p])]:
                s.union(p, int(i))
            distance.append(1 - both / (s.n[ids] + s.n[p] - both))
            nearest = np.min(distance, 0)
            if len(pivots) == 8 or nearest.max() < 0.25:
                break
            pivots.append(int(ids[np.argmax(nearest)]))
        if len({s.find(int(i)) for i in ids}) < 2:
            continue
        # A region's own points lie within 1/2 of its pivot, so partners lie within 3/4 of it and within 2 eps of
        # their own nearest; points of no region join those beyond 1/4 of all pivots. A billionth covers rounding.
        slack = 1e-9
        regions = [ids[(d <= nearest + 0.5 + slack) & (d <= 0.75 + slack)] for d in distance] + [ids[nearest > 0.25 - slack]]
        sizes = [len(r) for r in regions]
        if max(sizes) <= 0.7 * len(ids) and sum(sizes) <= 1.3 * len(ids):
            stack += regions
            continue
        # The regions overlap too much: bands of distance to the first pivot, a quarter wide at most.
        order = np.argsort(distance[0], kind="stable")
        x, far = ids[order], distance[0][order]
        for a in range(0, len(x), LEAF):
            b = min(a + LEAF, len(x))
            compare(s, x[a:b], x[a : np.searchsorted(far, far[b - 1] + 0.25 + 1e-9, side="right")])


def compare(s: Sets, left: np.ndarray, right: np.ndarray) -> None:
    """Every pair of left and right that is not connected yet and whose sizes allow a link."""
    for i in left:
        root, n = s.find(int(i)), s.n[i]
        fits = right[(4 * np.minimum(s.n[right], n) >= 3 * np.maximum(s.n[right], n)) & (right != i)]
        rest = np.array([j for j in fits if s.find(int(j)) != root], np.int64)
        if len(rest):
            both = s.shared(int(i), rest)
            for j in rest[linked(both, s.n[rest], n)]:
                s.union(int(i), int(j))


def components(edges: DataFrame) -> DataFrame:
    """(node, block): the least node that each node of (a, b) edges reaches; rounds of least neighbours and jumps."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("block")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("block").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("block").alias("old"), F.least("block", "near").alias("block"))
        jump = labels.select(F.col("node").alias("block"), F.col("block").alias("next"))
        new = written(nearer.join(jump, "block").select("node", "old", F.least("block", "next").alias("block")), "labels")
        release(labels)
        labels = new
        if new.where("block < old").isEmpty():
            release(both)
            out = new.select("node", "block")
            out._written_to = new._written_to
            return out


def counted(tallies: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """The counters' totals by powers of two, one byte each, and their mean; ``tallies`` has (slice, blob) rows of compressed counts."""
    each = (1 << bits) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(blob, 4 * each, "zstd", asbytes=True), "<u4")
                total[k] = total[k] + part if k in total else part.astype(np.int64)
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.frexp(t.astype(np.float64))[1].astype(np.uint8).tobytes()], pa.binary()), pa.array([int(t.sum())])], ["slice", "blob", "total"])

    out, total = np.zeros(1 << bits, np.uint8), 0
    for row in tallies.repartition(SLICES, "slice").mapInArrow(add, "slice int, blob binary, total long").collect():  # a byte a counter
        out[row["slice"] * each : (row["slice"] + 1) * each] = np.frombuffer(row["blob"], np.uint8)
        total += row["total"]
    return out, total / len(out)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    n = n_buckets(docs)
    d = docs_only(docs, id_col, text_col)
    bits = int(np.clip((input_bytes(docs) >> 7).bit_length(), *COUNTERS))
    shift = np.uint64(64 - bits)

    names = ["doc_id", "n_shingles", "key", "slice", "blob"]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's set size and key; at the end of a task its counters, as rows with a slice."""
        tally = np.zeros(1 << bits, np.uint32)
        for batch in small_batches(batches, 16 << 20):
            sets = [shingle_set(t) for t in encoded(batch)]
            keys = [set_key(s) if len(s) else None for s in sets]
            own = {k: s for k, s in zip(keys, sets, strict=True) if k is not None}
            if own:
                tally += np.bincount((np.concatenate(list(own.values())) >> shift).astype(np.int64), minlength=len(tally)).astype(np.uint32)
            none = [None] * len(sets)
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if tally.any():
            blobs = [pa.compress(t.tobytes(), "zstd", asbytes=True) for t in np.split(tally, SLICES)]
            none = pa.array([None] * SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names)

    first_pass = written(d.mapInArrow(points, "doc_id long, n_shingles long, key long, slice int, blob binary"), "points")
    point = first_pass.where("slice IS NULL").select("doc_id", "n_shingles", "key")
    often, mean = counted(first_pass.where("slice IS NOT NULL").select("slice", "blob"), bits)
    crowded = int(np.frexp(max(2 * PAIRS, 8 * mean))[1]) + 1

    def first_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # names of this task's points: copies are sent once, or again after so many others
        for batch in small_batches(batches, 16 << 20):
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for text in encoded(batch):
                s = shingle_set(text)
                if not len(s) or (key := set_key(s)) in told:
                    continue
                if len(told) >= 1 << 20:
                    told.clear()
                told.add(key)
                first = s[np.argsort(often[(s >> shift).astype(np.int64)], kind="stable")[: reach(len(s))]]
                for part, v in zip(parts, (first, np.full(len(first), key), np.full(len(first), len(s)), np.arange(len(first))), strict=True):
                    part.append(v)
            if parts[0]:
                value, key, size, rank = map(np.concatenate, parts)
                # A region that is crowded everywhere is a star already here: one of the batch's points goes there for all.
                hot = np.flatnonzero(often[(value >> shift).astype(np.int64)] >= crowded)
                hot = hot[np.argsort(value[hot], kind="stable")]
                again = np.concatenate([[False], value[hot][1:] == value[hot][:-1]]) if len(hot) else np.empty(0, bool)
                if again.any():
                    first = hot[~again][np.cumsum(~again) - 1]
                    a, b = np.minimum(key[first], key[hot])[again], np.maximum(key[first], key[hot])[again]
                    none = np.zeros(len(a), "i4")
                    yield pack((n + a % n).astype(np.int32), [a, b, none, none])
                    rank[first[again]] = STAR
                    keep = np.ones(len(value), bool)
                    keep[hot[again]] = False
                    value, key, size, rank = value[keep], key[keep], size[keep], rank[keep]
                yield pack((value % np.uint64(n)).astype(np.int32), [value, key.astype("i8"), size.astype("u4"), rank.astype("u4")])

    def met(a: np.ndarray, b: np.ndarray, least: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        """Each pair once, with the times it met; a pair of a star (times 0) needs no more."""
        order = np.lexsort([b, a])
        a, b, least, times = a[order], b[order], least[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return [a[first], b[first], np.minimum.reduceat(least, first), np.add.reduceat(times, first, dtype=times.dtype)]

    def propose(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= n:  # edges of stars
            columns = met(*unpack(table["blob"].to_pylist(), ["i8", "i8", "i4", "i4"]))
            return pa.Table.from_batches([pack((columns[0] % n).astype(np.int32), columns)])
        value, key, size, rank = unpack(table["blob"].to_pylist(), ["u8", "i8", "u4", "u4"])
        order = np.lexsort([key, value])
        value, key, size, rank = value[order], key[order], size[order].astype(np.int64), rank[order].astype(np.int64)
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (key[1:] != key[:-1])])
        value, key, size, rank = value[new], key[new], size[new], rank[new]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        count = np.diff(np.append(first, len(value)))
        found: list[list[np.ndarray]] = [[], [], [], []]

        def add(a, b, least, times) -> None:
            for column, v in zip(found, met(a, b, least.astype("i4"), times.astype("i4")), strict=True):
                column.append(v)

        star = np.maximum.reduceat(rank == STAR, first) if len(first) else np.empty(0, bool)
        for c, is_star in sorted(set(zip(count[count > 1].tolist(), (star | (count > PAIRS))[count > 1].tolist(), strict=True))):  # all regions of one size at once
            at = first[(count == c) & ((star | (count > PAIRS)) == is_star)]
            if not is_star:
                i, j = np.triu_indices(c, 1)
                step = max(1, 500_000 // len(i))
                for k in range(0, len(at), step):
                    base = at[k : k + step, None]
                    x, y = (base + i).ravel(), (base + j).ravel()
                    # No more can be shared than lies before this place and from it on, in either set.
                    most = np.minimum(size[x] - rank[x], size[y] - rank[y]) + np.minimum(rank[x], rank[y])
                    ok = (4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y])) & linked(most, size[x], size[y])
                    if ok.any():
                        x, y = x[ok], y[ok]
                        add(key[x], key[y], need(np.minimum(size[x], size[y])), np.ones(len(x)))
            else:
                for f in at:
                    add(np.full(c - 1, key[f]), key[f + 1 : f + c], np.zeros(c - 1), np.zeros(c - 1))
        if not found[0]:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "blob"])
        columns = met(*map(np.concatenate, found))
        return pa.Table.from_batches([pack((columns[0] % n).astype(np.int32), columns)])

    def enough(table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        a, b, least, times = met(*unpack(blobs, ["i8", "i8", "i4", "i4"])) if blobs else [np.empty(0, np.int64)] * 4
        keep = times >= least
        return pa.table([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    pairs = d.mapInArrow(first_regions, PACKED).groupBy("bucket").applyInArrow(propose, PACKED)
    edges = written(pairs.groupBy("bucket").applyInArrow(enough, "a long, b long"), "candidates")
    one = point.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    blocks = components(edges)
    release(edges)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingle_set(t) for t in encoded(batch)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["block", "key", "shingles"])
            # An id may stand on several rows: only the text that has the name's set speaks for it.
            yield rows.filter(pa.array([len(s) > 0 and set_key(s) == k for s, k in zip(sets, batch.column(1).to_pylist(), strict=True)]))

    # A null id is larger than any other here, so a copy with an id speaks for the set; sets that only null ids hold join by key.
    asked = blocks.join(one.select(F.col("key").alias("node"), "doc_id"), "node").select("doc_id", F.col("node").alias("key"), "block")
    texts = asked.join(d.select(F.col("doc_id").alias("owner"), "text"), F.col("doc_id").eqNullSafe(F.col("owner"))).select("block", "key", "text")
    held = written(texts.mapInArrow(members, "block long, key long, shingles binary"), "members")
    named = written(named_members(held, n), "named")
    release(held, blocks)
    rows = point.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("name", "key").alias("name"))
    # Written, so that the join below deals a large component's rows over tasks.
    least = written(rows.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("name", "of"), "components")
    return rows.join(least, F.col("name") == F.col("of"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def named_members(held: DataFrame, n: int) -> DataFrame:
    """(key, name): the least key that each member of a block reaches by links; ``held`` has (block, key, shingles)."""
    sizes = held.groupBy("block").agg(F.count("*").alias("members"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("members") / LIMIT, F.col("bytes") / LIMIT_BYTES)).cast("int").alias("parts")
    sizes = written(sizes.select(F.col("block").alias("of"), parts), "sizes")
    sized = held.join(sizes, F.col("block") == F.col("of")).drop("of")

    def join_blocks(table: pa.Table) -> pa.Table:
        _, one = np.unique(table["key"].to_numpy(), return_index=True)
        table = table.take(pa.array(one))
        block, key = table["block"].to_numpy(), table["key"].to_numpy()
        order = np.lexsort([key, block])
        blobs = table["shingles"]
        names = np.empty(len(key), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            s = Sets([np.frombuffer(blobs[int(r)].as_py(), np.uint64) for r in rows])
            join(s, np.arange(len(rows)))
            names[rows] = [key[rows[s.find(i)]] for i in range(len(rows))]
        return pa.table([pa.array(key), pa.array(names)], ["key", "name"])

    small = sized.where("parts = 1").withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    named = small.select("bucket", "block", "key", "shingles").groupBy("bucket").applyInArrow(join_blocks, "key long, name long")
    if sizes.where("parts > 1").isEmpty():
        return named
    return named.unionAll(dealt_blocks(sized.where("parts > 1")))


def distances(s: Sets, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, linked) of the other points of ``s`` from each of the first ``pivots``, as (pivots, points) arrays."""
    ids = np.arange(pivots, len(s.n))
    both = np.array([s.shared(p, ids) for p in range(pivots)]).reshape(pivots, len(ids))
    n, m = s.n[ids], s.n[:pivots, None]
    return 1 - both / (n + m - both), linked(both, n, m)


def dealt_blocks(big: DataFrame) -> DataFrame:
    """``named_members`` for large blocks (block, key, shingles, parts), each dealt over ``parts`` tasks and more."""
    chosen = big.groupBy("block", F.pmod(F.xxhash64("key"), F.lit(PIVOTS)).alias("slot")).agg(F.min_by("key", F.xxhash64("key", F.lit(1))).alias("pivot"))
    chosen = written(chosen.groupBy("block").agg(F.array_sort(F.collect_set("pivot")).alias("pivots")), "pivots")
    lone = chosen.select(F.col("block").alias("b"), F.explode("pivots").alias("k"))
    pivots = big.join(lone, (F.col("block") == F.col("b")) & (F.col("key") == F.col("k")), "left_semi")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("pivot", F.lit(True))
    points = big.withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts")).cast("int")).withColumn("pivot", F.lit(False))

    def meet(table: pa.Table) -> pa.Table:
        key, is_pivot, blobs = table["key"].to_numpy(), np.array(table["pivot"].to_pylist(), bool), table["shingles"].to_pylist()
        rows = [np.flatnonzero(x)[np.unique(key[x], return_index=True)[1]] for x in (is_pivot, ~is_pivot)]
        s = Sets([np.frombuffer(blobs[i], np.uint64) for part in rows for i in part])
        d, near = distances(s, len(rows[0]))
        mask = (near * (1 << np.arange(len(rows[0])))[:, None]).sum(0)
        block, shingles = table["block"].to_pylist()[:1] * len(rows[1]), [blobs[i] for i in rows[1]]
        return pa.table([pa.array(block, pa.int64()), pa.array(key[rows[1]], pa.int64()), pa.array(shingles, pa.binary()), pa.array(mask, pa.int32()), pa.array(d.argmin(0), pa.int32()), pa.array(list(d.T), pa.list_(pa.float64()))], ["block", "key", "shingles", "mask", "region", "far"])

    columns = ["block", "part", "key", "shingles", "pivot"]
    met_rows = points.select(columns).unionAll(pivots.select(columns)).groupBy("block", "part").applyInArrow(meet, "block long, key long, shingles binary, mask int, region int, far array<double>")
    laid = written(met_rows, "laid")

    # A block has at most 2**PIVOTS masks: pivots that share a point, or are linked themselves, are one class.
    @F.pandas_udf("array<int>")
    def classes(masks: pd.Series) -> pd.Series:
        def of(found) -> list[int]:
            group = [1 << i for i in range(PIVOTS)]
            for m in found:
                joined = int(m)
                for g in group:
                    joined |= g if g & joined else 0
                group = [joined if g & joined else g for g in group]
            return [(g & -g).bit_length() - 1 for g in group]

        return masks.map(of)

    groups = laid.where("mask <> 0").groupBy("block").agg(F.array_sort(F.collect_set("mask")).alias("masks"))
    groups = groups.join(chosen, "block").select(F.col("block").alias("of"), "pivots", classes("masks").alias("class"))
    lowest = F.expr("bit_count((mask & -mask) - 1)")
    label = F.when(F.col("mask") == 0, F.col("key")).otherwise(F.expr("element_at(pivots, element_at(class, lowest + 1) + 1)"))
    laid = laid.join(groups, F.col("block") == F.col("of"), "left").withColumn("lowest", F.when(F.col("mask") != 0, lowest)).withColumn("label", label).drop("of", "pivots", "class", "lowest", "mask")
    laid = written(laid, "labelled")

    # Of two points that no pivot connects, one lies outside the block's largest class: those visit the others.
    tally = laid.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("guests"))
    tally = written(tally.where("guests > 0").select(F.col("block").alias("of"), "main", F.ceil(F.col("guests") / LIMIT).cast("int").alias("rounds")), "classes")
    areas = laid.groupBy("block", "region").agg(F.ceil(F.greatest(F.count("*") / LIMIT, F.sum(F.octet_length("shingles")) / LIMIT_BYTES)).cast("int").alias("cells"))
    areas = written(areas.join(tally, F.col("block") == F.col("of"), "left_semi").select(F.col("block").alias("area"), F.col("region").alias("place"), "cells"), "areas")
    open_ = laid.join(tally, F.col("block") == F.col("of")).drop("of")
    here = open_.join(areas, (F.col("block") == F.col("area")) & (F.col("region") == F.col("place")))
    here = here.withColumn("cell", F.pmod(F.xxhash64("key", F.lit(3)), F.col("cells")).cast("int")).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    guests = open_.where("label <> main").withColumn("round", F.pmod(F.xxhash64("key", F.lit(4)), F.col("rounds")).cast("int"))
    # Own regions lie within 2 eps of the nearest pivot's distance for a partner of that region.
    guests = guests.join(areas, (F.col("block") == F.col("area")) & (F.element_at("far", F.col("place") + 1) <= F.array_min("far") + 0.5 + SLACK))
    guests = guests.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))

    def visit(table: pa.Table) -> pa.Table:
        """Links between visitors and residents of a cell that connect two classes."""
        key, label, guest, blobs = table["key"].to_numpy(), table["label"].to_numpy(), np.array(table["guest"].to_pylist(), bool), table["shingles"].to_pylist()
        far = np.array(table["far"].to_pylist())
        s = Sets([np.frombuffer(b, np.uint64) for b in blobs])
        for same in (key, label):  # what is one point, and what is connected already
            order = np.argsort(same, kind="stable")
            for i, j in zip(order[:-1], order[1:], strict=True):
                if same[i] == same[j]:
                    s.union(int(i), int(j))
        found, residents = [], np.flatnonzero(~guest)
        for i in np.flatnonzero(guest):
            n, m = s.n[i], s.n[residents]
            fits = residents[(4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (np.abs(far[residents] - far[i]).max(1) <= 0.25 + SLACK)]
            root = s.find(int(i))
            rest = np.array([j for j in fits if s.find(int(j)) != root], np.int64)
            if len(rest):
                both = s.shared(int(i), rest)
                for j in rest[linked(both, s.n[rest], n)]:
                    s.union(int(i), int(j))
                    found.append((int(key[i]), int(key[j])))
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    columns = ["block", "place", "cell", "round", "key", "label", "far", "shingles"]
    cells = here.select(*columns, F.lit(False).alias("guest")).unionAll(guests.select(*columns, F.lit(True).alias("guest")))
    across = cells.groupBy("block", "place", "cell", "round").applyInArrow(visit, "a long, b long")
    known = laid.where("label <> key").select(F.col("key").alias("a"), F.col("label").alias("b"))
    found = components(written(known.unionAll(across), "links"))
    return laid.select("key").join(found, F.col("key") == F.col("node"), "left").select("key", F.coalesce("block", "key").alias("name"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they came: the one with the smallest id, null last.

    Rows are told apart by a number of their own, so repeated and null ids are judged row by row; of rows of one id
    and one component, one stays. Rows without shingles all stay.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_components(rows, "__row", text_col).withColumnRenamed("doc_id", "__of")
    ids = rows.select("__row", F.col(id_col).alias("__id"))
    best = found.join(ids, F.col("__of") == F.col("__row")).groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__row"))).alias("first"))
    kept = best.select(F.col("first.__row").alias("__kept"))
    return rows.join(kept, rows["__row"] == kept["__kept"], "left_semi").select(docs.columns)
