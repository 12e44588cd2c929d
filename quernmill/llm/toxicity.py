"""Toxicity: averaged subword embeddings under a linear softmax.

Every word, with a boundary mark at either end, is cut into character n-grams (in bytes); each
n-gram is hashed to a bucket that owns an embedding, and a word's vector is the mean of those of its
n-grams.  Vectors are averaged over a window of words, and a linear softmax gives the window's
probability of being toxic; a document has that of its highest window, over all windows of its whole
text.  Embeddings and softmax are trained jointly by Adagrad in numpy, on a bounded sample of labelled
documents: first whole texts, then the highest window of each, as scoring does.  A misspelling
shares most of its n-grams with the word it distorts, so it is scored without having been seen.

For scoring, the product of each embedding with the softmax weights is folded into one number per
bucket, so that a document takes one pass over its bytes.

Defined results: a null or empty text has no n-grams and probability 0.0; other columns, repeated
rows and null ids are passed through; without labelled rows of both classes nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.session import table

LENGTHS = (3, 4, 5, 6)
BITS = 18
DIM = 8
#: Means over many n-grams are small; this brings them to unit size.
SCALE = 20.0
L2 = 1e-4
#: Words of a window.
WINDOW = 3


@dataclass
class Model:
    """The folded weights: one number per bucket, the intercept and the threshold."""

    weights: np.ndarray
    bias: float
    window: int = WINDOW
    threshold: float = 0.5


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, each between two blanks; all that is not a word is blank."""
    texts = pc.utf8_lower(column.fill_null(""))
    data, offs = B.buffers(pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(""), " "))
    return np.where(B.IS_WORD[data], data, np.uint8(32)), offs


def grams(data: np.ndarray, n: int, prefix: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n bytes from each position on, and whether they lie in one word with its marks."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = (prefix[n:] - prefix[:m]) * B._pow(B.BASE_INV, len(data) + 1, "q")[:m]
    bucket = ((h + B.U64(n)) * B.U64(0x9E3779B97F4A7C15)) >> B.U64(64 - BITS)
    return bucket.view(np.int64), blanks[n - 1 : n - 1 + m] == blanks[1 : m + 1]


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of being toxic for each text: that of its most toxic window."""
    data_all, offs = padded(column)
    out = np.zeros(len(offs) - 1)
    for a, b in B.chunks(offs):
        data, first = data_all[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        value, words = _word_values(data, first, model.weights)
        z = _peaks(value, words, model.window)[0] + model.bias
        out[a:b] = np.where(np.diff(words) > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
    return out


def _word_values(data: np.ndarray, first: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of the n-grams of each word, and each row's first word."""
    words = B.Words(data, first)
    prefix = words.prefix
    blanks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 32, out=blanks[1:])
    length = words.end - words.start + 2
    total = np.zeros(len(words))
    count = np.zeros(len(words))
    for n in LENGTHS:
        bucket, valid = grams(data, n, prefix, blanks)
        if not len(bucket):
            continue
        w = weights[bucket]
        w[~valid] = 0
        run = np.zeros(len(w) + 1)
        np.cumsum(w, out=run[1:])
        had = np.maximum(length - n + 1, 0)
        at = np.minimum(words.start - 1, len(w))
        total += run[np.minimum(at + had, len(w))] - run[at]
        count += had
    return total / np.maximum(count, 1), words.first


def _peaks(value: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the highest mean over a window of words (over all words, if fewer), and where it starts."""
    n = len(value)
    rows = len(first) - 1
    if not n:
        return np.zeros(rows), np.zeros(rows, np.int64)
    run = np.zeros(n + 1)
    np.cumsum(value, out=run[1:])
    size = np.diff(first)
    end = np.repeat(np.maximum(first[1:] - window, first[:-1]), size)  # the last start of a full window
    start = np.minimum(np.arange(n), end)
    stop = np.minimum(start + window, np.repeat(first[1:], size))
    mean = (run[stop] - run[start]) / (stop - start)
    best = np.zeros(rows)
    where = np.zeros(rows, np.int64)
    some = np.flatnonzero(size)
    best[some] = np.maximum.reduceat(mean, first[some])
    hit = np.flatnonzero(mean == np.repeat(best, size))
    row = np.repeat(np.arange(rows), size)[hit]
    r, k = np.unique(row, return_index=True)
    where[r] = start[hit[k]]
    return best, where


def _lexicon(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts: n-gram buckets of each (flat, with bounds); and the texts as word numbers (flat, with bounds)."""
    data_all, offs = padded(pa.array(texts, pa.string()))
    seen, parts, sizes, hashes, firsts = [], [], [], [], [np.zeros(1, np.int64)]
    for a, b in B.chunks(offs, 1 << 19):
        data = data_all[offs[a] : offs[b]]
        words = B.Words(data, offs[a : b + 1] - offs[a])
        own_hash, at = np.unique(words.hash, return_index=True)
        starts, length = words.start[at] - 1, words.end[at] - words.start[at] + 2
        had = np.stack([np.maximum(length - n + 1, 0) for n in LENGTHS], 1)
        bounds = np.concatenate([[0], np.cumsum(had.sum(1))])
        flat = np.empty(bounds[-1], np.int32)
        to = bounds[:-1].copy()
        for n, h in zip(LENGTHS, had.T, strict=True):
            bucket, _ = grams(data, n, words.prefix, np.zeros(len(data) + 1, np.int32))
            own = np.repeat(np.arange(len(at)), h)
            inside = np.arange(len(own)) - np.repeat(np.cumsum(h) - h, h)
            flat[to[own] + inside] = bucket[starts[own] + inside]
            to += h
        seen.append(own_hash)
        parts.append(flat)
        sizes.append(np.diff(bounds))
        hashes.append(words.hash)
        firsts.append(words.first[1:] + firsts[-1][-1])
    if not seen:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    uniq, at = np.unique(np.concatenate(seen), return_index=True)
    size = np.concatenate(sizes)
    place = np.concatenate([[0], np.cumsum(size)])
    pick, _ = _spread(place[at], place[at] + size[at])
    number = np.searchsorted(uniq, np.concatenate(hashes)).astype(np.int32)
    return np.concatenate(parts)[pick], np.concatenate([[0], np.cumsum(size[at])]), number, np.concatenate(firsts)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of some ranges, and the number of the range that each is of."""
    size = last - first
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own], own


def train(texts: list[str | None], labels: np.ndarray, warm: int = 2, epochs: int = 10, lr: float = 0.4, batch: int = 32, min_docs: int = 3, window: int = WINDOW, false_cost: float = 5.0, drop: float = 1.0, seed: int = 7) -> Model:
    """Fits embeddings and softmax together; both classes weigh the same.

    The first epochs take the whole text of each document; those after them its highest window under
    the weights so far, so that what raises clean documents is unlearned; of these, a share of ``drop``
    is seen without half of its n-grams, so that a distorted word suffices.  N-grams that fewer than
    min_docs of the sample's documents have keep a zero vector: what they would learn is the label of
    single documents.  A fifth of the sample is kept back; the threshold, at least 0.5, is
    that at which the share of its toxic documents found, less ``false_cost`` times that of its clean
    ones, is greatest.
    """
    y = np.asarray(labels, np.int64)
    flat, bounds, number, first = _lexicon(texts)
    some = np.diff(first) > 0
    if len(set(y[some].tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -50.0, window)
    rng = np.random.default_rng(seed)
    order = rng.permutation(np.flatnonzero(some))
    held, keep = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(y[keep].tolist())) < 2:
        held, keep = order[:0], order
    row = np.repeat(np.arange(len(y)), np.diff(first))
    pair = np.unique(row * len(bounds) + number)  # a word once a document
    own_row, own_word = pair // len(bounds), pair % len(bounds)
    bag_first = np.searchsorted(own_row, np.arange(len(y) + 1))
    frequency = np.zeros(1 << BITS, np.int64)
    for r in range(len(y)):
        at, _ = _spread(bounds[own_word[bag_first[r] : bag_first[r + 1]]], bounds[own_word[bag_first[r] : bag_first[r + 1]] + 1])
        frequency[np.unique(flat[at])] += 1
    learned = frequency >= min(min_docs, max(1, len(keep) // 20))
    share = 1.0 / np.maximum(np.diff(bounds), 1)
    e = np.where(learned[:, None], rng.normal(0, 0.05, (1 << BITS, DIM)), 0).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    weight = np.where(y == 1, len(keep) / 2 / max(1, (y[keep] == 1).sum()), len(keep) / 2 / max(1, (y[keep] == 0).sum())).astype(np.float32)
    squares_e, squares_w, squares_b = np.full(1 << BITS, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def values() -> np.ndarray:
        folded = e @ (w[:, 1] - w[:, 0]) * SCALE
        run = np.concatenate([[0], np.cumsum(folded[flat], dtype=np.float64)])
        return ((run[bounds[1:]] - run[bounds[:-1]]) * share)[number]

    for epoch in range(warm + epochs):
        rate = lr * (1 - epoch / (warm + epochs))
        if epoch >= warm:
            _, where = _peaks(values(), first, window)
        rng.shuffle(keep)
        for start in range(0, len(keep), batch):
            rows = keep[start : start + batch]
            if epoch < warm:
                place, doc = _spread(bag_first[rows], bag_first[rows + 1])
                word = own_word[place]
            else:
                place, doc = _spread(where[rows], np.minimum(where[rows] + window, first[rows + 1]))
                word = number[place]
            count = np.bincount(doc, minlength=len(rows))
            at, own = _spread(bounds[word], bounds[word + 1])
            ids = flat[at]
            ok = learned[ids]
            if epoch >= warm:  # half of the windows lose a random half of their n-grams, as misspellings do
                ok &= (rng.random(len(rows)) >= drop)[doc[own]] | (rng.random(len(ids)) < 0.5)
            ids, own = ids[ok], own[ok]
            if not len(ids):
                continue
            amount = (share[word] / np.maximum(count, 1)[doc])[own] * SCALE
            own = doc[own]
            hidden = np.stack([np.bincount(own, e[ids, d] * amount, len(rows)) for d in range(DIM)], 1).astype(np.float32)
            z = hidden @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - np.stack([1 - y[rows], y[rows]], 1)) * weight[rows, None] / len(rows)
            dh = dz @ w.T
            uniq, inverse = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inverse, dh[own, d] * amount, len(uniq)) for d in range(DIM)], 1).astype(np.float32)
            grad += L2 * e[uniq]
            dw, db = hidden.T @ dz, dz.sum(0)
            squares_e[uniq] += (grad * grad).mean(1)
            squares_w += dw * dw
            squares_b += db * db
            e[uniq] -= rate * grad / np.sqrt(squares_e[uniq])[:, None]
            w -= rate * dw / np.sqrt(squares_w)
            b -= rate * db / np.sqrt(squares_b)
    model = Model((e @ (w[:, 1] - w[:, 0]) * SCALE).astype(np.float32), float(b[1] - b[0]), window)
    z = _peaks(values(), first, window)[0] + model.bias
    clean, toxic = np.sort(z[held][y[held] == 0]), np.sort(z[held][y[held] == 1])
    if len(clean) and len(toxic):
        at = np.unique(np.concatenate([[0.0], clean[clean > 0] + 1e-3]))
        gain = 1 - np.searchsorted(toxic, at) / len(toxic) - false_cost * (1 - np.searchsorted(clean, at) / len(clean))
        model.threshold = float(1 / (1 + np.exp(-np.clip(at[gain.argmax()], 0, 30))))
    return model


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 1000, label: str = "toxic", **options) -> Model:
    """Trains on at most max_rows labelled documents of each class (the bound of the sample).

    The rows are those with the least hash of their id, so that the choice doesn't depend on order.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_id"))
    parts = [chosen.where(F.col("_y") == c).orderBy("_h", "_id").limit(max_rows) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # one text for each id, however many rows have it
    rows = documents.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values("_id", kind="stable")
    return train(rows["text"].tolist(), rows["_y"].to_numpy(), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_toxic, toxic) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in B.small(batches):
            p = score_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= shared.value.threshold)], ["doc_id", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in B.small(batches):
            yield batch.filter(pa.array(score_texts(batch.column(at), shared.value) < shared.value.threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model trained on the labelled ones."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
