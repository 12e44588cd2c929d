"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with whole texts of a bounded sample of
labelled documents.  A text, in lower case, is cut into pieces of ``PIECE`` bytes that cover all of it, every piece is
encoded with each language's dictionary, and the language whose encodings are smallest in sum is
chosen.  The text is rejected as ``und`` when the next language needs less than ``MARGIN`` of the
text's bytes more, or less than ``LEAST`` bytes more.

Defined results: a null or empty text is ``und`` with null margin; ties are narrow margins, so ``und``;
rows with a null or empty language aren't trained on; without a labelled text all is ``und``; repeated
rows and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.session import table

UNKNOWN = "und"
PIECE = 4096
LEVEL = 6
MARGIN = 0.005
LEAST = 6
#: The sample: documents taken for each language, and bytes of a dictionary.
DOCS = 60
#: Most labels that get a dictionary.
LANGUAGES = 256
DICTIONARY_BYTES = 1 << 16


@dataclass
class Model:
    """The languages in order and the content of their dictionaries."""

    languages: list[str]
    content: list[bytes]
    _ready: list | None = None

    def compressors(self) -> list:
        import zstandard as zstd

        if self._ready is None:
            self._ready = []
            for content in self.content:
                d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._ready

    def __getstate__(self):
        return {"languages": self.languages, "content": self.content, "_ready": None}


def plain(raw: np.ndarray) -> bytes:
    """Bytes with blanks for all that isn't a letter or beyond ASCII, so that only words are compared."""
    return np.where(B.IS_WORD[raw] & ~((raw >= 48) & (raw < 58)), raw, np.uint8(32)).tobytes()


def train(rows: list[tuple[str, str]], size: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries from (language, text) rows; whole texts are taken, in order, until ``size`` bytes are there."""
    own: dict[str, bytes] = {}
    for lang, text in rows:
        if lang and text and len(own.get(lang, b"")) < size:
            own[lang] = own.get(lang, b"") + plain(np.frombuffer(text.lower().encode(), np.uint8)) + b" "
    names = sorted(x for x in own if len(own[x]) >= 8)
    return Model(names, [own[x] for x in names])


def sizes(text: bytes, model: Model) -> np.ndarray:
    """Compressed bytes of a text under each dictionary."""
    total = np.zeros(len(model.content), np.int64)
    pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
    for k, c in enumerate(model.compressors()):
        total[k] = sum(len(c.compress(piece)) for piece in pieces)
    return total


def classify_texts(column: pa.Array, model: Model) -> tuple[list[str], list[float | None]]:
    """Language and margin, in shares of the text's bytes, of each text."""
    raw, offs = B.lowered(column)
    data = plain(raw)
    names, margins = [], []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if a == b or len(model.content) < 1:
            names.append(UNKNOWN)
            margins.append(None)
            continue
        need = sizes(data[a:b], model)
        order = np.argsort(need, kind="stable")
        more = int(need[order[1]] - need[order[0]]) if len(need) > 1 else 0
        sure = len(need) == 1 or (more >= LEAST and more >= MARGIN * (b - a))
        names.append(model.languages[order[0]] if sure else UNKNOWN)
        margins.append(more / (b - a))
    return names, margins


def fit(docs: DataFrame, per_language: int = DOCS, languages: int = LANGUAGES) -> Model:
    """Takes the ``per_language`` different documents whose id hashes least, of each of the ``languages`` most frequent labels (the bounds of the sample)."""
    rows = docs.where("lang is not null and lang <> '' and text is not null and text <> ''")
    rows = rows.select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text")
    spread = 2.0**64
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()}
    if not counts:
        return Model([], [])
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * per_language + 20) / n))])
    chosen = rows.where((F.col("h") / F.lit(spread) + 0.5) <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    chosen.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    taken: dict[str, int] = {}
    kept = []
    for r in chosen:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            kept.append((r["lang"], r["text"]))
    return train(kept)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, margin) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in B.small(batches):
            names, margins = classify_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(margins, pa.float64())], ["doc_id", "language", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, language string, margin double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by dictionaries of a sample of the documents' own labels."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
