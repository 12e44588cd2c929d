"""All vectors of a table against a bank of vectors, by matrix products over slices of the bank.

A slice is broadcast and is at most ``BYTES`` in size; a larger bank is split by a hash of its key and the
rows are passed once for each slice.  Of a slice's products a worker holds those of ``ROWS`` rows with
``COLUMNS`` columns at a time, in single precision; what these can't rule out is computed anew as SQL does,
term by term, so that equal vectors are equally similar.  A null vector counts as zeros; all others have one length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTES = 64 << 20
ROWS = 1024
COLUMNS = 2048
#: Rows of a task, and pairs that are computed anew at a time.
TASK = 4096
PAIRS = 1 << 16


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix."""
    out = np.zeros((len(column), width))
    some = np.flatnonzero(np.asarray(column.is_valid()))
    flat = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
    out[some] = flat.reshape(len(some), width)
    return out


def lengths(a: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows of a matrix, summed in the order of their places."""
    total = np.zeros(len(a))
    for column in a.T:
        total += column * column
    return np.sqrt(total)


def units(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows at unit length in single precision; zeros stay."""
    return (a / np.where(size > 0, size, 1.0)[:, None]).astype(np.float32)


def places(keys: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each key the places [left, right) of its equals among sorted keys, nulls first."""
    if pa.types.is_integer(keys.type) and pa.types.is_integer(own.type) and not keys.null_count and not own.null_count:
        own, keys = own.to_numpy(), keys.to_numpy()
        return np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
    nulls, some = keys.null_count, keys.to_pylist()
    left = [0 if x is None else bisect_left(some, x, nulls) for x in own.to_pylist()]
    right = [nulls if x is None else bisect_right(some, x, nulls) for x in own.to_pylist()]
    return np.array(left, int), np.array(right, int)


class Bank:
    """The vectors of a slice, sorted by key."""

    def __init__(self, keys: pa.Array, vectors: np.ndarray, eps: float):
        self.keys, self.vectors, self.eps = keys, vectors, eps
        self.lengths = lengths(vectors)
        self.units = units(vectors, self.lengths)
        self.shortest = min(self.lengths[self.lengths > 0], default=1.0)


class Block:
    """Some rows against a slice; ``left`` and ``right`` are the places of a row's own key among the slice's."""

    def __init__(self, bank: Bank, keys: pa.Array, vectors: np.ndarray):
        self.bank, self.vectors, self.size = bank, vectors, len(bank.keys)
        self.left, self.right = places(bank.keys, keys)
        self.lengths = lengths(vectors)
        self.units = units(vectors, self.lengths)
        #: More than what ``near`` can be off by: twice the bound for a product of unit vectors in single precision.
        self.slack = (vectors.shape[1] + 8) * 2.0**-23
        self.tiny = min(self.lengths[self.lengths > 0], default=1.0) * bank.shortest < bank.eps

    def near(self, at: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Similarities of some rows with the columns from ``at``, within ``slack``."""
        part = slice(at, at + COLUMNS)
        if self.tiny:
            return self.vectors[rows] @ self.bank.vectors[part].T / np.maximum(self.lengths[rows][:, None] * self.bank.lengths[part], self.bank.eps)
        return self.units[rows] @ self.bank.units[part].T

    def exact(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Similarities of pairs, summed in the order of their places."""
        out = np.empty(len(row))
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], column[at : at + PAIRS]
            total = np.zeros(len(r))
            for x, y in zip(self.vectors[r].T, self.bank.vectors[c].T, strict=True):
                total += x * y
            out[at : at + PAIRS] = total / np.maximum(self.lengths[r] * self.bank.lengths[c], self.bank.eps)
        return out


#: What picks (rows, columns, similarities) from a block, any number of times.
Best = Callable[[Block], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def against(rows: DataFrame, bank: DataFrame, key: str, vec: str, bank_key: str, bank_vec: str, best: Best, value: str = "similarity", size: int = BYTES, eps: float = 1e-8) -> DataFrame:
    """(key, other, value) of the pairs that ``best`` picks from each block of rows and slice of the bank."""
    spark = rows.sparkSession
    whole = bank.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(bank_vec)), F.lit(0)).alias("d")).first()
    width = max(whole["d"], 0)
    parts = max(1, -(-whole["n"] * max(width, 1) * 8 // size))
    kind, other_kind = rows.schema[key].dataType, bank.schema[bank_key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("other", other_kind), T.StructField(value, T.DoubleType())])
    # a file of vectors is small for what is to be done with it: it is spread by the number of its rows
    spread = rows.select(key, vec).repartition(max(1, -(-rows.count() // TASK)), key)
    out = None
    for k in range(parts):
        part = bank.where(F.pmod(F.xxhash64(bank_key), F.lit(parts)) == k).select(bank_key, bank_vec).orderBy(bank_key).toArrow()
        shared = spark.sparkContext.broadcast((part.column(0).combine_chunks(), matrix(part.column(1).combine_chunks(), width)))

        def run(batches, shared=shared):
            ids, vectors = shared.value
            held = Bank(ids, vectors, eps) if len(ids) else None
            for batch in batches:
                for at in range(0, batch.num_rows if held else 0, ROWS):
                    piece = batch.slice(at, ROWS)
                    for row, column, sims in best(Block(held, piece.column(0), matrix(piece.column(1), width))):
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), ids.take(pa.array(column)), pa.array(sims)], [key, "other", value])

        own = spread.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return out


def above(threshold: float) -> Best:
    """Pairs (smaller key, greater key) above a similarity."""

    def best(block: Block):
        for at in range(0, block.size, COLUMNS):
            row, column = np.nonzero(block.near(at) > threshold - block.slack)
            column += at
            later = column >= block.right[row]
            for k in range(0, int(later.sum()), PAIRS):
                r, c = row[later][k : k + PAIRS], column[later][k : k + PAIRS]
                sims = block.exact(r, c)
                yield r[sims > threshold], c[sims > threshold], sims[sims > threshold]

    return best


def first(threshold: float) -> Best:
    """Of each row the pair with the least key that is smaller than its own and above a similarity; a row that has it is passed no more."""

    def best(block: Block):
        rest = np.arange(len(block.left))
        for at in range(0, block.size, COLUMNS):
            rest = rest[block.left[rest] > at]
            if not len(rest):
                return
            row, column = np.nonzero(block.near(at, rest) > threshold - block.slack)
            row, column = rest[row], column + at
            earlier = column < block.left[row]
            row, column = row[earlier], column[earlier]
            sims = block.exact(row, column)
            row, column, sims = row[sims > threshold], column[sims > threshold], sims[sims > threshold]
            row, where = np.unique(row, return_index=True)  # in the order of columns within a row
            yield row, column[where], sims[where]
            rest = np.setdiff1d(rest, row, assume_unique=True)

    return best


def greatest(k: int, other_only: bool = True) -> Best:
    """The ``k`` greatest of each row, ties by key."""

    def best(block: Block):
        n = len(block.left)
        top, place = np.full((n, k), -np.inf), np.zeros((n, k), int)
        for at in range(0, block.size, COLUMNS):
            sims = block.near(at)
            width = sims.shape[1]
            if other_only:
                for r in np.flatnonzero((block.left < at + width) & (block.right > at)):
                    sims[r, max(block.left[r] - at, 0) : max(block.right[r] - at, 0)] = -np.inf
            least = top[:, -1] - block.slack
            if at == 0 and width > k:
                least = np.partition(sims, -k, axis=1)[:, -k] - 2 * block.slack
            row, column = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            for lo in range(0, len(row), PAIRS):
                r, c = row[lo : lo + PAIRS], column[lo : lo + PAIRS] + at
                exact = block.exact(r, c)
                better = exact > top[r, -1]  # those that tie with the last come after it
                r, c, exact = r[better], c[better], exact[better]
                some, at_row = np.unique(r, return_inverse=True)
                all_r = np.concatenate([np.repeat(np.arange(len(some)), k), at_row])
                all_v = np.concatenate([top[some].ravel(), exact])
                all_c = np.concatenate([place[some].ravel(), c])
                order = np.lexsort((all_c, -all_v, all_r))
                begin = np.searchsorted(all_r[order], np.arange(len(some)))
                take = order[(begin[:, None] + np.arange(k)).ravel()]
                top[some], place[some] = all_v[take].reshape(-1, k), all_c[take].reshape(-1, k)
        row, column = np.nonzero(top > -np.inf)
        yield row, place[row, column], top[row, column]

    return best
