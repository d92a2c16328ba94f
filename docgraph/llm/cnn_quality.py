"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` windows that overlap by one window less a byte, so that every window of
``WIDTH`` bytes of the whole text lies in exactly one chunk. Learned filters run over each chunk and are
max-pooled; a document combines its chunks' maxima (their mean and their maximum) into one probability.

The model is fitted on the driver on at most ``sample`` labelled rows and ``sample_bytes`` bytes of text (both bounds
are parameters), chosen by a hash of their id, never on rows of the held-out fold; nothing but the text enters a score.
Of rows that repeat an id the least text is taken; a text that does not fit into what is left of the bytes is passed
over. Scoring runs in the mappers, without a shuffle.

Defined results: null and empty texts have no chunk and score by the bias of the empty feature vector; rows
without a label are scored alike; repeated rows score alike; a null id has no label and is not held out; a score equal
to the threshold is predicted 1; with no labelled row, or one class only, every score is the share of label 1 (0.5 if
none); an empty table gives no rows; other columns are not read. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_only, encoded, small_batches

WIDTH, CHUNK, FILTERS = 5, 256, 24


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS): a filter's weight of a byte at a place
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + 1,)
    out_bias: float
    constant: float | None = None


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of CHUNK + WIDTH - 1 bytes, the number of windows of each, and its text's index."""
    size = np.array([len(t) for t in texts], np.int64)
    windows = np.where(size > 0, np.maximum(size - WIDTH + 1, 1), 0)
    per = -(-windows // CHUNK)
    of = np.repeat(np.arange(len(texts)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    flat = np.frombuffer(b"".join(texts) + bytes(CHUNK + WIDTH), np.uint8)
    at = (np.cumsum(size) - size)[of] + k * CHUNK
    rows = flat[at[:, None] + np.arange(CHUNK + WIDTH - 1)]
    left = size[of] - k * CHUNK
    rows = np.where(np.arange(CHUNK + WIDTH - 1) < left[:, None], rows, 0).astype(np.uint8)
    return rows, np.minimum(windows[of] - k * CHUNK, CHUNK), of


def pooled(model: Model, rows: np.ndarray, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each chunk's rectified maxima, and on request the windows they come from."""
    best = np.zeros((len(rows), FILTERS), np.float32)
    arg = np.zeros((len(rows), FILTERS), np.int32) if where else None
    for i in range(0, len(rows), 32):
        r = rows[i : i + 32]
        z = model.table[0][r[:, :CHUNK]]
        for j in range(1, WIDTH):
            z += model.table[j][r[:, j : j + CHUNK]]
        for c in np.flatnonzero(windows[i : i + 32] < CHUNK):
            z[c, windows[i + c] :] = -np.inf
        if arg is not None:
            arg[i : i + 32] = z.argmax(1)
        best[i : i + 32] = z.max(1)
    return np.maximum(best + model.bias, 0), arg


def features(maxima: np.ndarray, windows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per text the mean and the maximum of its chunks' maxima, and how far it falls short of one full chunk."""
    out = np.zeros((n, 2 * FILTERS + 1), np.float32)
    if len(of):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        count = np.diff(np.append(first, len(of)))
        out[of[first], :FILTERS] = np.add.reduceat(maxima, first) / count[:, None]
        out[of[first], FILTERS:-1] = np.maximum.reduceat(maxima, first)
        out[of[first], -1] = np.log(CHUNK / np.maximum.reduceat(windows, first))
    return out


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    rows, windows, of = chunked(texts)
    logit = features(pooled(model, rows, windows)[0], windows, of, len(texts)).astype(np.float64) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def span(text: bytes, rng: np.random.Generator) -> bytes:
    if rng.random() > 1 / 3 or len(text) < 24:
        return text
    size = int(np.exp(rng.uniform(np.log(16), np.log(600))))
    start = int(rng.integers(0, max(1, len(text) - size)))
    return text[start : start + size].lstrip(b" \n")


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, steps: int = 400, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam on the balanced logistic loss; only a maximum's own window gets its gradient.

    At least ``epochs`` rounds and ``steps`` steps. A third of the texts of each round are replaced by a short span from anywhere in them, so that short texts are known.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    model = Model(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(rng.normal(0, 0.1, 2 * FILTERS), 0), 0.0)
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        model.constant = float(share)
        return model
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    batch = int(np.clip(len(texts) // 16, 8, 64))
    epochs = max(epochs, -(-steps * batch // len(texts)))
    params = [model.table, model.bias, model.out, np.zeros(1)]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            ids = order[i : i + batch]
            rows, windows, of = chunked([span(texts[k], rng) for k in ids])
            m, arg = pooled(model, rows, windows, True)
            f = features(m, windows, of, len(ids)).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(f @ model.out + params[3][0], -40, 40)))
            g = (p - labels[ids]) * weight[ids] / len(ids)
            df = g[:, None] * model.out
            count = np.bincount(of, minlength=len(ids)).clip(1)
            dm = (df[:, :FILTERS] / count[:, None])[of]
            top = m >= f[of, FILTERS:-1] - 1e-7
            dm = (dm + df[of, FILTERS:-1] * top) * (m > 0)
            grad = [np.zeros(model.table.shape), dm.sum(0), f.T @ g + 1e-4 * model.out, np.array([g.sum()])]
            c, k = np.nonzero(dm)
            for j in range(WIDTH):
                at = rows[c, arg[c, k] + j].astype(np.int64) * FILTERS + k
                grad[0][j] = np.bincount(at, dm[c, k], 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.9 * epoch / epochs)
            for par, gr, (a, b) in zip(params, grad, moments, strict=True):
                a *= 0.9
                a += 0.1 * gr
                b *= 0.99
                b += 0.01 * gr * gr
                par -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(par.dtype)
    model.out_bias = float(params[3][0])
    return model


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, sample: int = 3000, sample_bytes: int = 32 << 20
) -> Model:
    """Fit on labelled rows outside the held-out fold; at most ``sample`` texts of ``sample_bytes`` together reach the driver."""
    mine = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    chosen = mine.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs_only(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= sample_bytes)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*")
    # Of ``sample`` rows at most: those that fit one after another, in the order of the ids.
    sizes = rows.select("doc_id", F.octet_length("text").alias("size")).orderBy("doc_id").collect()
    fits, left = [], sample_bytes
    for r in sizes:
        if r["size"] <= left:
            fits.append(r["doc_id"])
            left -= r["size"]
    got = rows.where(F.col("doc_id").isin(fits)).toArrow() if len(fits) < len(sizes) else rows.toArrow()
    got = sorted(zip(got["doc_id"].to_pylist(), got["text"].cast(pa.binary()).to_pylist(), got["y"].to_pylist(), strict=True))
    return fit([t for _, t, _ in got], np.array([y for _, _, y in got]))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            s = scores(model, encoded(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    got = docs_only(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return got.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns as they came; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(scores(model, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
