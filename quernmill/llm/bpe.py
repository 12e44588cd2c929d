"""Byte-level BPE encoding and decoding as a reduction over a tree.

Encoded text is a monoid: an element is a piece of text with its tokens, and joining two elements
gives the tokens of the joined text.  ``encode`` halves a text until pieces are small, encodes these,
and joins neighbours up the tree.  A join encodes anew only a window around the boundary.  The window
grows to either side, twice as far each time, until it begins and ends at a *stable* place: a
blank or line feed after a character that isn't white space.  No pre-token of the vocabulary's
pattern extends across such a place, whatever stands before or after, and what follows it is split
without looking back; so the tokens outside the window are those of the whole text.  A window that
finds no such place takes in its whole side.

``decode`` concatenates the bytes of tokens up the same kind of tree.

The vocabulary is a file of base64 tokens and ranks that stays where it is; its path is a parameter.
Tokens are kept as packed little-endian numbers, of 16 bits where the vocabulary has at most 65,536.

Defined results: a null text has null tokens, number and decoded text; an empty one has none, 0 and
an empty text; other columns are ignored by ``encode_docs``; rows are kept as they are.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split that byte-level vocabularies of this family were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf.
LEAF = 4096
WINDOW = 64
_STABLE = re.compile(r"(?<=\S)[ \n]")


class Codec:
    """A vocabulary: leaf encoding, joins and decoding."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = max(ranks.values()) + 1
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.length = np.zeros(size, np.int64)
        pieces = [b""] * size
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)
            pieces[rank] = piece
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.place = np.concatenate([[0], np.cumsum(self.length)])

    def _tokens(self, text: str) -> np.ndarray:
        return np.asarray(self.leaf(text), self.kind)

    def _take(self, tokens: np.ndarray, size: int, last: bool) -> int:
        """How many tokens, from the start or the end, come to ``size`` bytes."""
        n = min(len(tokens), size)
        run = np.cumsum(self.length[tokens[len(tokens) - n :][::-1] if last else tokens[:n]])
        k = int(np.searchsorted(run, size)) + 1 if size else 0
        assert not size or run[k - 1] == size, "a stable place is between tokens"
        return k

    def join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        p, width = a, WINDOW
        while m - width > a:
            found = [x.start() for x in _STABLE.finditer(text, m - width, m)]
            found = [x for x in found if x > a]
            if found:
                p = found[-1]
                break
            width *= 2
        q, width = b, WINDOW
        while m + width < b:
            found = _STABLE.search(text, m + 1, m + width)
            if found:
                q = found.start()
                break
            width *= 2
        keep = len(left) - self._take(left, len(text[p:m].encode()), True)
        drop = self._take(right, len(text[m:q].encode()), False)
        return np.concatenate([left[:keep], self._tokens(text[p:q]), right[drop:]])

    def encode(self, text: str, a: int = 0, b: int | None = None, leaf: int = LEAF) -> np.ndarray:
        b = len(text) if b is None else b
        if b - a <= leaf:
            return self._tokens(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self.encode(text, a, m, leaf), self.encode(text, m, b, leaf))

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes of all tokens, in one gather."""
        size = self.length[tokens]
        total = np.cumsum(size)
        if not len(total) or not total[-1]:
            return b""
        at = np.arange(total[-1]) + np.repeat(self.place[tokens] - (total - size), size)
        return self.pieces[at].tobytes()

    def decode_tree(self, tokens: np.ndarray, leaf: int = 1 << 14) -> bytes:
        if len(tokens) <= leaf:
            return self.decode(tokens)
        m = len(tokens) // 2
        return self.decode_tree(tokens[:m], leaf) + self.decode_tree(tokens[m:], leaf)


@lru_cache(2)
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(path)


def encode_docs(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): packed tokens of each text, their number, and whether decoding them gives the text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed, number, same = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = None if text is None else own.encode(text)
                    packed.append(None if text is None else tokens.tobytes())
                    number.append(None if text is None else len(tokens))
                    same.append(None if text is None else own.decode_tree(tokens) == text.encode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(number, pa.int32()), pa.array(same, pa.bool_())], ["doc_id", "tokens", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens binary, n_tokens int, round_trip boolean")


def decode_docs(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of packed tokens; bytes that aren't UTF-8 become replacement characters."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [None if x is None else own.decode_tree(np.frombuffer(x, own.kind)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, "doc_id long, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its text."""
    return encode_docs(table(spark, sf_dir, "documents"))
