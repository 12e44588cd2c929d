"""Vectorised scanning of UTF-8 text columns straight from Arrow buffers.

Words, word n-grams and character n-grams are hashed for millions of bytes at a time with numpy; no
Python string is made for any of them.  A word is a maximal run of ASCII letters, digits and
non-ASCII characters; null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; bounds the memory of a Python worker whatever the batch.
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = int(_rng.integers(1, 2**62)) * 8 + 5
BASE_INV = pow(BASE, -1, 2**64)
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    IS_WORD[ord(_a) : ord(_b) + 1] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _pow(base: int, n: int, key: str) -> np.ndarray:
    """The first n powers of base modulo 2**64; kept, and doubled when longer ones are asked for."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * U64(pow(base, done, 2**64))
            done *= 2
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about limit bytes; a row is never cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a worker holds beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Words:
    """The words of some rows: ``start``, ``end`` (bytes), ``hash``, and ``row`` boundaries ``first``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD):
        n = len(data)
        self.offsets = offsets
        mask = np.zeros(n + 2, bool)
        mask[1:-1] = inside[data]
        change = mask[1:] != mask[:-1]
        inner = np.unique(offsets[1:-1])
        inner = inner[(inner > 0) & (inner < n)]
        cut = inner[mask[inner] & mask[inner + 1]]  # a word ends where its row ends
        edges = np.flatnonzero(change)
        if len(cut):
            edges = np.sort(np.concatenate([edges, cut, cut]))
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, offsets)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[data] * _pow(BASE, n, "p"), out=prefix[1:])
        self.prefix = prefix
        length = self.end - self.start
        raw = (prefix[self.end] - prefix[self.start]) * _pow(BASE_INV, n + 1, "q")[self.start]
        self.hash = mix(raw + length.astype(U64) * U64(0x9E3779B97F4A7C15))

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each one on; the last n - 1 are of no use."""
    if n == 1:
        return hashes
    m = len(hashes)
    prefix = np.zeros(m + 1, U64)
    np.cumsum(hashes * _pow(BASE, m, "p"), out=prefix[1:])
    out = np.zeros(m, U64)
    k = m - n + 1
    if k > 0:
        out[:k] = mix((prefix[n:] - prefix[:k]) * _pow(BASE_INV, m, "q")[:k])
    return out


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of words from which n words lie in the same row."""
    ends = np.maximum(first[1:] - (n - 1), first[:-1])
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, ends, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def hash_words(text: str) -> np.ndarray:
    """Word hashes of one text that is already in lower case (for tests and small tables)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash


def lowered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column in lower case; nulls are empty."""
    import pyarrow.compute as pc

    return buffers(pc.utf8_lower(column.fill_null("")))


TERM_BITS = 40


def bags(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, cut to 40 bits: (hash, times, where each row starts among them).

    One sort of (row, hash) packed into 64 bits; at most 2**24 rows, which a chunk never has.
    """
    rows = len(first) - 1
    row = np.repeat(np.arange(rows, dtype=U64), np.diff(first))
    key = np.sort((row << U64(TERM_BITS)) | (hashes >> U64(64 - TERM_BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    key = key[at]
    starts = np.searchsorted(key >> U64(TERM_BITS), np.arange(rows + 1, dtype=U64))
    return key & U64((1 << TERM_BITS) - 1), times, starts


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each row, and where each row's start; a row of fewer words has one, of all of them."""
    size = np.diff(words.first)
    full = gram_starts(words.first, n)
    grams = ngrams(words.hash, n)[full]
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((size > 0) & (size < n))
    out = np.zeros(first[-1], U64)
    is_short = np.zeros(first[-1], bool)
    is_short[first[short]] = True
    out[~is_short] = grams
    for r in short:
        own = words.hash[words.first[r] : words.first[r + 1]]
        out[first[r]] = mix(np.cumsum(own * _pow(BASE, len(own), "p"))[-1:] + U64(len(own)))[0]
    return out, first
