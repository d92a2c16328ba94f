"""LM scoring with Brown-style class bigrams.

Every training word has a class. Texts are hashed once, into blocks of token places in the block's own vocabulary.
The ``top`` most frequent words seed the classes: exchange clustering on the driver, whose input is bounded by ``top``
squared, moves each to the class that raises the mutual information of neighbouring classes most, until none moves.
Every other training word, whatever its count, then joins the class that raises it most, in parallel by hash bucket,
from its neighbours' classes (neighbours that are no seeds count as one class there, and the words of a bucket do not see
each other move). Class transitions are counted anew over the classes of all words. A token's probability is mixed
from P(class | class before) * P(word | class), transitions add-half smoothed, and the unigram base:

    share * P(class | before) * P(word | class) + (1 - share) * (c + 0.5) / (N + 0.5 * (V + 1))

which sums to one over all known words, the end and one unknown word. The unknown word and the boundary of texts are
classes of their own; what follows an unknown word is as frequent as anywhere. Counts and classes of the most
frequent words of each bucket travel to the tasks (``listed`` in all); each block looks those of its other words up
in their buckets, so no table that grows with the corpus is ever broadcast.

Words are known by 64-bit hashes. Defined results: null and empty texts are the end alone; a null id counts
as training; identical rows (id and text) score alike; without training rows N = V = 0 and every token has
base probability 1; an empty table gives no rows; other columns are not read. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, docs_only, encoded, n_buckets, pack, small_batches, unpack, word_hashes, written

TOP, CLASSES, LISTED, SHARE, ALPHA = 1024, 64, 131_072, 0.95, 0.5


def tokens(text: bytes) -> np.ndarray:
    return word_hashes(text.lower().split())


def merged(value: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """Distinct values, ascending, with the sums of each array."""
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
    return [value[first], *[np.add.reduceat(s[order], first) if len(first) else s for s in sums]]


def looked_up(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of the first K symbols of a (K + 2)-square count matrix; the last two are classes of their own."""
    k = len(bigrams) - 2
    c = min(classes, max(k, 1))
    label = np.concatenate([np.arange(k) % c, [c, c + 1]])
    n = bigrams.astype(np.float64)
    one_hot = lambda: np.eye(c + 2)[label]
    right, left = n @ one_hot(), n.T @ one_hot()  # of each symbol: successors' and predecessors' classes
    grid = one_hot().T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(k):
            a, own = label[w], n[w, w]
            r, le = right[w].copy(), left[w].copy()
            r[a] -= own
            le[a] -= own
            grid[a] -= r
            grid[:, a] -= le
            grid[a, a] -= own
            row, col = grid.sum(1), grid.sum(0)
            base = xlogx(grid)
            by_row, by_col = xlogx(grid + r) - base, xlogx(grid + le[:, None]) - base
            both = xlogx(np.diag(grid) + r + le + own) - np.diag(base)
            gain = by_row.sum(1) - np.diag(by_row) + by_col.sum(0) - np.diag(by_col) + both
            gain -= xlogx(row + r.sum() + own) - xlogx(row) + xlogx(col + le.sum() + own) - xlogx(col)
            b = int(np.argmax(gain[:c]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += le
            grid[b, b] += own
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        if not moved:
            break
    return label[:k]


def squeezed(ids: np.ndarray) -> bytes:
    """Places in a block's vocabulary, byte by byte; frequent words come first there, so that high bytes are mostly 0."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def restored(blob: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, 4 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def framed(x: np.ndarray, lengths: np.ndarray, edge: int) -> np.ndarray:
    """The texts of a block one after another, with an edge before, between and after them."""
    out = np.full(len(x) + len(lengths) + 1, edge, np.int64)
    out[np.arange(len(x)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = x
    return out


def best_classes(word: np.ndarray, code: np.ndarray, count: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, class of each) by the gain of mutual information, from counts of the neighbours' classes.

    Rows ascend by word and code; codes are the classes after a word, then those before it. The last two classes of
    ``grid`` take no words.
    """
    c = len(grid) - 2
    cells = np.concatenate([grid[:c].T, grid[:, :c]])  # by code: the cells that the classes would add it to
    row, col, own = grid.sum(1)[:c], grid.sum(0)[:c], np.diag(grid)[:c]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
    ends, label = np.append(first[1:], len(word)), np.empty(len(first), np.int64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + 32_768)))
        a, b = first[at], ends[to - 1]
        old, n = cells[code[a:b]], count[a:b, None]
        gain = np.add.reduceat(xlogx(old + n) - xlogx(old), first[at:to] - a)
        near = np.zeros((to - at, len(cells)))
        near[np.repeat(np.arange(to - at), ends[at:to] - first[at:to]), code[a:b]] = count[a:b]
        r, le = near[:, :c], near[:, c + 2 : 2 * c + 2]
        i, j = np.nonzero((r > 0) & (le > 0))  # both sides add to one cell
        g, x, y = own[j], r[i, j], le[i, j]
        gain[i, j] += xlogx(g + x + y) - xlogx(g + x) - xlogx(g + y) + xlogx(g)
        t = near[:, : c + 2].sum(1)[:, None]
        gain -= xlogx(row + t) - xlogx(row) + xlogx(col + t) - xlogx(col)
        label[at:to] = gain.argmax(1)
        at = to
    return word[first], label


def score_documents(
    docs: DataFrame, folds: int = 5, held: int = 1, top: int = TOP, classes: int = CLASSES, listed: int = LISTED, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for every row."""
    n = n_buckets(docs)
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    d = docs_only(docs, id_col, text_col).withColumn("held_out", is_held)

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(small_batches(batches)):
            hashes = [tokens(t) for t in encoded(batch)]
            lengths = np.array([len(h) for h in hashes], np.int64)
            training = ~np.array(batch.column(2).to_pylist(), bool)
            vocab, ids, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            vocab, ids = vocab[order], np.argsort(order)[ids]
            seen = np.bincount(ids[np.repeat(training, lengths)], minlength=len(vocab))
            blobs = [lengths.tobytes(), training.tobytes(), vocab.tobytes(), seen.astype("u4").tobytes(), squeezed(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + i]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in blobs]], ["block", "doc_ids", "lengths", "training", "vocab", "seen", "ids"])

    blocks = written(d.mapInArrow(make_blocks, "block long, doc_ids array<long>, lengths binary, training binary, vocab binary, seen binary, ids binary"), "blocks")

    def arrays(row: dict) -> tuple[np.ndarray, ...]:
        """(lengths, training, vocab, ids) of a block."""
        lengths, training, vocab = (np.frombuffer(row[x], t) for x, t in (("lengths", "i8"), ("training", "?"), ("vocab", "u8")))
        return lengths, training, vocab, restored(row["ids"], int(lengths.sum()))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            value, count = np.frombuffer(row["vocab"], "u8"), np.frombuffer(row["seen"], "u4")
            value, count = value[count > 0], count[count > 0]
            yield pack((value % np.uint64(n)).astype(np.int32), [value, count.astype("i8")])

    def sum_words(table: pa.Table) -> pa.Table:
        value, count = merged(*unpack(table["blob"].to_pylist(), ["u8", "i8"]))
        return pa.table([table["bucket"][:1], pa.array([len(value)], pa.int64()), pa.array([int(count.sum())], pa.int64()), pa.array([value.tobytes() + count.tobytes()], pa.binary())], ["bucket", "types", "total", "blob"])

    counts = written(blocks.select("vocab", "seen").mapInArrow(count_words, PACKED).groupBy("bucket").applyInArrow(sum_words, "bucket int, types long, total long, blob binary"), "counts")
    sums = counts.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    ends = d.where(~F.col("held_out")).count()
    types, total = sums["v"] + (ends > 0), sums["n"] + ends

    def most_frequent(words: DataFrame, each: int, dtypes: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    value, count, *more = unpack([blob], dtypes)
                    best = np.lexsort([value, -count])[:each]
                    cls = more[0][best].astype(np.int64) if more else np.zeros(len(best), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(value[best].view(np.int64)), pa.array(count[best]), pa.array(cls)], ["value", "count", "class"])

        return words.select("blob").mapInArrow(run, "value long, count long, class long")

    def by_value(df: DataFrame) -> list[np.ndarray]:
        got = df.toArrow()  # ``top`` or ``listed`` rows at most
        value = got["value"].to_numpy().view(np.uint64)
        order = np.argsort(value)
        return [value[order], got["count"].to_numpy()[order], got["class"].to_numpy()[order]]

    top_value = by_value(most_frequent(counts, top, ["u8", "i8"]).orderBy(F.desc("count"), "value").limit(top))[0]
    k = len(top_value)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((k + 2) ** 2, np.int64)
        for row in rows_of(batches):
            lengths, training, vocab, ids = arrays(row)
            at, found = looked_up(top_value, vocab)
            f = framed(np.where(found, at, k)[ids[np.repeat(training, lengths)]], lengths[training], k + 1)
            grid += np.bincount(f[:-1] * (k + 2) + f[1:], minlength=len(grid))
        code = np.flatnonzero(grid)
        yield pack((code % n).astype(np.int32), [code.astype("i8"), grid[code]])

    def sum_bigrams(table: pa.Table) -> pa.Table:
        code, count = merged(*unpack(table["blob"].to_pylist(), ["i8", "i8"]))
        return pa.table([pa.array(code), pa.array(count)], ["code", "count"])

    def summed(packed: DataFrame, size: int) -> np.ndarray:
        cells = packed.groupBy("bucket").applyInArrow(sum_bigrams, "code long, count long").toArrow()  # size squared at most
        grid = np.zeros(size**2, np.int64)
        grid[cells["code"].to_numpy()] = cells["count"].to_numpy()
        return grid.reshape(size, size)

    bigrams = summed(blocks.select("lengths", "training", "vocab", "ids").mapInArrow(count_bigrams, PACKED), k + 2)
    label = np.unique(exchange(bigrams, classes), return_inverse=True)[1].astype(np.int64)
    c = int(label.max()) + 1 if k else 0  # classes of words; then the unknown word (before: words without class), then the edge
    hot = np.eye(c + 2, dtype=np.int64)[np.concatenate([label, [c, c + 1]])]
    seeds = (hot.T @ bigrams @ hot).astype(np.float64)
    width = 2 * (c + 2)

    def count_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            lengths, training, vocab, ids = arrays(row)
            at, found = looked_up(top_value, vocab)
            cls = np.where(found, label[at] if k else 0, c)
            mine, lengths = ids[np.repeat(training, lengths)], lengths[training]
            f, w = framed(cls[mine], lengths, c + 1), framed(np.where(found, -1, np.arange(len(vocab)))[mine], lengths, -1)
            after, before = w[:-1] >= 0, w[1:] >= 0
            code, count = np.unique(np.concatenate([w[:-1][after] * width + f[1:][after], w[1:][before] * width + c + 2 + f[:-1][before]]), return_counts=True)
            word, per = np.unique(code // width, return_counts=True)
            bucket = (vocab[word] % np.uint64(n)).astype(np.int32)
            words = pack(bucket, [vocab[word], per.astype("u4")])
            yield pa.RecordBatch.from_arrays([*words.columns, pack(np.repeat(bucket, per), [(code % width).astype("u4"), count.astype("u4")]).column(1)], ["bucket", "blob", "near"])

    word_types = ["u8", "i8", "u4"]

    def assign(near: pa.Table, table: pa.Table) -> pa.Table:
        value, count = unpack(table["blob"].to_pylist(), ["u8", "i8"])
        at, found = looked_up(top_value, value)
        cls = np.where(found, label[at] if k else 0, c)
        who, per = unpack(near["blob"].to_pylist(), ["u8", "u4"])
        code, times = unpack(near["near"].to_pylist(), ["u4", "u4"])
        key, times = merged(np.repeat(looked_up(value, who)[0], per) * width + code, times.astype(np.int64))
        word, best = best_classes(key // width, key % width, times, seeds)
        cls[word] = best
        in_class = np.zeros(c + 1, np.int64)
        np.add.at(in_class, cls, count)
        blob = value.tobytes() + count.tobytes() + cls.astype("u4").tobytes()
        return pa.table([table["bucket"][:1], pa.array([in_class.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["bucket", "in_class", "blob"])

    near = blocks.select("lengths", "training", "vocab", "ids").mapInArrow(count_neighbours, "bucket int, blob binary, near binary")
    words = written(near.groupBy("bucket").cogroup(counts.select("bucket", "blob").groupBy("bucket")).applyInArrow(assign, "bucket int, in_class array<long>, blob binary"), "words")
    in_class = np.zeros(c + 1, np.int64)
    for row in words.select(F.posexplode("in_class").alias("class", "words")).groupBy("class").agg(F.sum("words").alias("words")).collect():  # one row a class
        in_class[row["class"]] = row["words"]
    list_value, list_count, list_class = by_value(most_frequent(words, max(1, listed // n), word_types).orderBy(F.desc("count"), "value").limit(listed))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            vocab = np.frombuffer(row["vocab"], "u8")
            far = vocab[~looked_up(list_value, vocab)[1]]
            asked = pack((far % np.uint64(n)).astype(np.int32), [far])
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array([row["block"]] * asked.num_rows, pa.int64())], ["bucket", "blob", "block"])

    def reply(questions: pa.Table, table: pa.Table) -> pa.Table:
        value, count, cls = unpack(table["blob"].to_pylist(), word_types)
        answers = []
        for blob in questions["blob"].to_pylist():
            at, found = looked_up(value, np.frombuffer(blob, "u8"))
            have, of = (np.where(found, x[at], y) if len(value) else np.full(len(at), y) for x, y in ((count, 0), (cls, c)))
            answers.append(have.astype("i8").tobytes() + of.astype("u4").tobytes())
        return pa.table([questions["block"], questions["bucket"], pa.array(answers, pa.binary())], ["block", "bucket", "blob"])

    resolved_schema = "doc_ids array<long>, lengths binary, training binary, counts binary, classes binary, ids binary, grid binary"

    def resolve(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        lengths, training, vocab, ids = arrays(row)
        at, found = looked_up(list_value, vocab)
        count, cls = (np.where(found, x[at], 0) if len(x) else np.zeros(len(vocab), np.int64) for x in (list_count, list_class))
        far = np.flatnonzero(~found)
        far = far[np.argsort(vocab[far] % np.uint64(n), kind="stable")]
        count[far], cls[far] = unpack(answers.sort_by("bucket")["blob"].to_pylist(), ["i8", "u4"])
        f = framed(cls[ids[np.repeat(training, lengths)]], lengths[training], c + 1)
        grid = np.bincount(f[:-1] * (c + 2) + f[1:], minlength=(c + 2) ** 2)
        blobs = [row["lengths"], row["training"], count.tobytes(), cls.astype("u4").tobytes(), row["ids"], grid.astype("i8").tobytes()]
        return pa.table([pa.array([row["doc_ids"]], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in blobs]], [x.split()[0] for x in resolved_schema.split(", ")])

    answers = blocks.select("block", "vocab").mapInArrow(ask, "bucket int, blob binary, block long").groupBy("bucket").cogroup(words.select("bucket", "blob").groupBy("bucket")).applyInArrow(reply, "block long, bucket int, blob binary")
    kept = blocks.select("block", "doc_ids", "lengths", "training", "vocab", "ids")
    resolved = written(kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(resolve, resolved_schema), "resolved")

    def count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((c + 2) ** 2, np.int64)
        for row in rows_of(batches):
            grid += np.frombuffer(row["grid"], "i8")
        code = np.flatnonzero(grid)
        yield pack((code % n).astype(np.int32), [code.astype("i8"), grid[code]])

    grid = summed(resolved.select("grid").mapInArrow(count_classes, PACKED), c + 2).astype(np.float64)
    grid[c] = grid.sum(0)  # after the unknown word, of which there are no counts
    follow = (grid + ALPHA) / (grid.sum(1, keepdims=True) + ALPHA * (c + 2))
    base_total = total + 0.5 * (types + 1)
    end = (ends + 0.5) / base_total

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            lengths, training, count, cls = (np.frombuffer(row[x], t) for x, t in (("lengths", "i8"), ("training", "?"), ("counts", "i8"), ("classes", "u4")))
            ids = restored(row["ids"], int(lengths.sum()))
            base = (count + 0.5) / base_total
            emit = np.where(cls < c, count / np.maximum(in_class[cls], 1), 1.0)
            f = framed(cls[ids], lengths, c + 1)
            last = np.cumsum(lengths + 1)
            b, e = np.full(len(f) - 1, end), np.ones(len(f) - 1)  # of each token, the ends among them
            is_word = np.ones(len(b), bool)
            is_word[last - 1] = False
            b[is_word], e[is_word] = base[ids], emit[ids]
            model, known = np.log10(share * follow[f[:-1], f[1:]] * e + (1 - share) * b), np.full(len(b), int(ends > 0))
            known[is_word] = (count > 0)[ids]
            first, b = last - lengths - 1, np.log10(b)
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(~training), pa.array(lengths + 1), pa.array(np.add.reduceat(known, first)), pa.array(np.full(len(lengths), total, np.int64)), pa.array(np.add.reduceat(b, first)), pa.array(np.add.reduceat(model, first))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in scored.split(", ")])

    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return resolved.select("doc_ids", "lengths", "training", "counts", "classes", "ids").mapInArrow(score, scored)
