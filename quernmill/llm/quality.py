"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned embeddings; ``FILTERS`` learned filters of ``TAPS`` bytes slide over all of a text
in steps of ``STRIDE``.  Chunks of ``2 * HALF`` bytes, each overlapping the next by half, cover the
whole text; each filter's greatest response is taken in every chunk.  The rectified maxima are
combined over all chunks, as their mean and as their greatest, by one logistic unit.  Embeddings,
filters and unit are trained jointly by Adam, on a bounded sample of labelled documents.

For scoring, embeddings and filters are folded into one table per tap, so that a response is a sum of
table rows.

Defined results: a null or empty text has probability 0.0 and isn't good; without labelled rows of both
classes all have 0.0; repeated rows and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.session import table

TAPS = 8
STRIDE = 2
HALF = 256
FILTERS = 16
EMBEDDING = 8
#: The sample: labelled documents taken of each class.
DOCS = 600


@dataclass
class Model:
    """Folded filters (taps, 256, filters), their intercepts, the combining weights and the intercept; threshold."""

    tables: np.ndarray
    intercept: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float = 0.5


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out at multiples of HALF bytes, each followed by at least TAPS zeros; and the first half-chunk of each."""
    size = np.diff(offsets)
    halves = -(-(size + TAPS) // HALF)
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(first[-1] * HALF + TAPS, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * HALF - offsets[:-1], size)] = data
    return out, first


def responses(out: np.ndarray, tables: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(half-chunks, positions, filters) of a layout; ``last`` marks the half-chunks that end a text.

    What would reach from a text's last half-chunk into the next text counts as the zeros before it.
    """
    n = (len(out) - TAPS) // STRIDE
    total = tables[0].take(out[: n * STRIDE : STRIDE], axis=0)
    for j in range(1, TAPS):
        total += tables[j].take(out[j : j + n * STRIDE : STRIDE], axis=0)
    total = total.reshape(-1, HALF // STRIDE, tables.shape[2])
    over = (TAPS - 1) // STRIDE
    total[last, -over:] = total[last, -over - 1][:, None]
    return total


def _pieces(out: np.ndarray, first: np.ndarray, tables: np.ndarray):
    """Responses of a layout, 512 half-chunks at a time."""
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    for s in range(0, first[-1], 512):
        yield responses(out[s * HALF : min(s + 512, first[-1]) * HALF + TAPS], tables, last[s : s + 512])


def _chunks(peaks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of chunks from those of half-chunks: (maxima, first chunk of each row, whether the second half has them)."""
    halves = np.diff(first)
    count = np.maximum(halves - 1, 1)
    start = np.concatenate([[0], np.cumsum(count)])
    left = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], count)
    right = np.minimum(left + 1, np.repeat(first[1:] - 1, count))
    return np.maximum(peaks[left], peaks[right]), start, np.where(peaks[right] > peaks[left], right[:, None], left[:, None])


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of being good for each text."""
    data, offs = B.buffers(column)
    result = np.zeros(len(offs) - 1)
    for a, b in B.chunks(offs, 1 << 18):
        own = offs[a : b + 1] - offs[a]
        out, first = layout(data[offs[a] : offs[b]], own)
        peaks = np.concatenate([x.max(1) for x in _pieces(out, first, model.tables)])
        maxima, start, _ = _chunks(peaks + model.intercept, first)
        maxima = np.maximum(maxima, 0)
        mean = np.add.reduceat(maxima, start[:-1], axis=0) / np.diff(start)[:, None]
        top = np.maximum.reduceat(maxima, start[:-1], axis=0)
        z = np.concatenate([mean, top], 1) @ model.weights + model.bias
        result[a:b] = np.where(np.diff(own) > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
    return result


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 12, batch: int = 24, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> Model:
    """Fits all parts together; both classes weigh the same."""
    y = np.asarray(labels, np.float32)
    data, offs = B.buffers(pa.array(texts, pa.string()))
    keep = np.flatnonzero(np.diff(offs) > 0)
    if len(set(y[keep].tolist())) < 2:
        return Model(np.zeros((TAPS, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), -50.0)
    weight = np.where(y == 1, len(keep) / 2 / (y[keep] == 1).sum(), len(keep) / 2 / (y[keep] == 0).sum())
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        rng.normal(0, 0.5 / np.sqrt(TAPS), (TAPS, EMBEDDING, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    moment, square, step = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts], 0
    for epoch in range(epochs):
        rng.shuffle(keep)
        for at in range(0, len(keep), batch):
            rows = keep[at : at + batch]
            own = np.concatenate([[0], np.cumsum(offs[rows + 1] - offs[rows])])
            out, first = layout(np.concatenate([data[offs[r] : offs[r + 1]] for r in rows]), own)
            emb, kernel, intercept, w, bias = parts
            tables = np.einsum("be,jef->jbf", emb, kernel, optimize=True)
            found = list(_pieces(out, first, tables))
            peaks = np.concatenate([x.max(1) for x in found]) + intercept
            where = np.concatenate([x.argmax(1) for x in found])
            maxima, start, half = _chunks(peaks, first)
            live = np.maximum(maxima, 0)
            count = np.diff(start)
            mean = np.add.reduceat(live, start[:-1], axis=0) / count[:, None]
            top = np.maximum.reduceat(live, start[:-1], axis=0)
            features = np.concatenate([mean, top], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ w + bias[0], -30, 30)))
            dz = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            row = np.repeat(np.arange(len(rows)), count)
            is_top = live == top[row]
            ties = np.add.reduceat(is_top, start[:-1], axis=0)
            d = dz[row, None] * (w[:FILTERS] / count[row, None] + w[FILTERS:] * is_top / ties[row]) * (maxima > 0)
            f = np.broadcast_to(np.arange(FILTERS), d.shape)
            place = half * HALF + where[half, f] * STRIDE
            dt = np.stack([np.bincount((out[place + j].astype(np.int64) * FILTERS + f).ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(TAPS)]).astype(np.float32)
            grads = [
                np.einsum("jbf,jef->be", dt, kernel, optimize=True) + l2 * emb,
                np.einsum("jbf,be->jef", dt, emb, optimize=True) + l2 * kernel,
                d.sum(0),
                features.T @ dz + l2 * w,
                dz.sum(keepdims=True),
            ]
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for x, g, m, v in zip(parts, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    emb, kernel, intercept, w, bias = parts
    return Model(np.einsum("be,jef->jbf", emb, kernel, optimize=True).astype(np.float32), intercept, w, float(bias[0]))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = DOCS, **options) -> Model:
    """Trains on at most max_rows labelled documents of each class (the bound of the sample), those whose id hashes least."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).withColumn("_h", F.xxhash64("_id"))
    parts = [chosen.where(F.col("_y") == c).orderBy("_h", "_id").limit(max_rows) for c in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    # one text for each id, however many rows have it
    rows = documents.select(F.col("doc_id").alias("_id"), "text").join(sample, "_id").groupBy("_id", "_y").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values("_id", kind="stable")
    return train(rows["text"].tolist(), rows["_y"].to_numpy(), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_good, good) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in B.small(batches):
            p = score_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= shared.value.threshold)], ["doc_id", "p_good", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, p_good double, good boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model trained on the labelled ones."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
