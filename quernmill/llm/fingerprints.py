"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its words, the weight being how often each occurs in the whole
text.  For each of ``SAMPLES`` hash functions and each word, r and c are Gamma(2, 1) and beta is
uniform, all three drawn from a hash of word and function; with t = floor(ln w / r + beta) the word
whose ln c - r (t + 1 - beta) is least is the sample, and (word, t) is its value.  Two documents
agree in a sample with a probability equal to their generalised Jaccard similarity, the sum of the
lesser weights over the sum of the greater.

The gamma variates are quantiles of 16 hash bits, so that no random generator runs per word.

Defined results: a null or empty text, or one without a word, has a null fingerprint; rows with a
null id and repeated rows are kept; ties between words are broken by their hash; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.session import table

SAMPLES = 64


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) e**-x, by Newton's method."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 4, x + 2)
    return x


GAMMA = _gamma_quantiles()
LOG_GAMMA = np.log(GAMMA)


def sample(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Values of the samples, for each row of a ragged array of weighted terms; 0 for empty rows."""
    rows = len(starts) - 1
    out = np.zeros((rows, samples), np.uint32)
    some = np.flatnonzero(np.diff(starts))
    if not len(some):
        return out
    at, size = starts[some], np.diff(starts)[some]
    log_w = np.log(weights)
    for k in range(samples):
        h = B.mix(terms + B.U64((k * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
        r = GAMMA[(h & B.U64(0xFFFF)).view(np.int64)]
        beta = (h >> B.U64(32)).astype(np.float64) * 2.0**-32
        t = np.floor(log_w / r + beta)
        value = LOG_GAMMA[((h >> B.U64(16)) & B.U64(0xFFFF)).view(np.int64)] - r * (t + 1 - beta)
        hit = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, at), size))
        if len(hit) > len(some):
            hit = hit[np.unique(np.searchsorted(at, hit, "right"), return_index=True)[1]]
        out[some, k] = (B.mix(terms[hit] * B.U64(0xD6E8FEB86659FD93) + t[hit].astype(np.int64).view(B.U64)) >> B.U64(32)).astype(np.uint32)
    return out


def fingerprint_texts(column: pa.Array, samples: int = SAMPLES) -> pa.Array:
    """A list of 32-bit samples for each text; null where there is no word."""
    data_all, offs = B.lowered(column)
    parts, has = [], []
    for a, b in B.chunks(offs):
        words = B.Words(data_all[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        terms, times, starts = B.bags(words.hash, words.first)
        parts.append(sample(terms, times, starts, samples))
        has.append(np.diff(starts) > 0)
    if not parts:
        return pa.array([], pa.list_(pa.int32()))
    mine, has = np.concatenate(parts), np.concatenate(has)
    offsets = np.concatenate([[0], np.cumsum(np.where(has, samples, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(mine[has].ravel().view(np.int32)), mask=pa.array(~has))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) for every row."""

    def run(batches):
        for batch in B.small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), fingerprint_texts(batch.column(1), samples)], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint array<int>")


def similarity(a: str, b: str) -> F.Column:
    """Estimated generalised Jaccard similarity of two fingerprint columns: the share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document."""
    return fingerprint(table(spark, sf_dir, "documents"))
