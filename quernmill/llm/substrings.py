"""Substring duplicates: matching statistics from a compressed FM-index per shard.

What is reported are the ranges of words of a document every ``WINDOW`` of which occur, as words in
lower case, in another document too.

Text is brought to shards by its content.  A window of ``WINDOW`` words has as key the least hash of
its ``GRAM``-word grams, so that equal windows have equal keys wherever they stand; neighbouring
windows of one key are one segment.  Keys that only one document has are dropped after a count over
all documents: none of their windows can occur elsewhere.  Of the other keys each distinct segment
is sent to its key's shard once, by one document that holds it.  A shard is an FM-index of its
segments, a suffix array's Burrows-Wheeler transform in a wavelet matrix; each segment is then
streamed through it by backward search, which gives how far to the left a match with another
document reaches, and ranges of at least ``WINDOW`` words are kept (``fmindex.shared_windows``).  A
segment that several documents hold as it is needs no search.  Last, the ranges found are joined back
to all documents that hold the segment, and merged.

A passage that very many documents have, each in a context of its own, gives its key as many distinct
segments.  A key whose segments come to more than ``HEAVY_WORDS`` is split: its windows become keys
themselves, which is exact as well, since a window's key then tells all of its words.  No index
therefore holds more than ``INDEX_WORDS`` and one key's ``HEAVY_WORDS``.

Words are told apart by 32 bits of their hash, in runs of 50 at least.

Defined results: null and empty texts and those of fewer than ``WINDOW`` words have no range; rows
that repeat id and text are one document, so they don't match each other; null ids are documents;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.llm import fmindex as M
from quernmill.session import cut, table

WINDOW = 50
GRAM = 10
#: Symbols after which a shard begins another index.
INDEX_WORDS = 400_000
#: Symbols of a key's distinct segments beyond which its windows are keys of their own.
HEAVY_WORDS = 400_000


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    if len(values) < width:
        return np.zeros(0, values.dtype)
    least, size = values, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments(words: B.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, first word, end) of the segments of some rows; words are counted over all rows."""
    at = B.gram_starts(words.first, window)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z.astype(B.U64), z, z
    key = sliding_least(B.ngrams(words.hash, gram), window - gram + 1)[at]
    row = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(row) > 0) | (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return row[head], key[head], at[head], at[tail] + window


def _hash_of(words: B.Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of words."""
    n = len(words)
    prefix = np.zeros(n + 1, B.U64)
    np.cumsum(words.hash * B._pow(B.BASE, n, "p"), out=prefix[1:])
    return B.mix((prefix[end] - prefix[start]) * B._pow(B.BASE_INV, n + 1, "q")[start] + (end - start).astype(B.U64))


def _located(batches):
    """(node, doc_id, key, seg, start, words) of every segment."""
    for batch in B.small(batches):
        data, offs = B.lowered(batch.column(2))
        for a, b in B.chunks(offs):
            words = B.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            row, key, start, end = segments(words)
            seg = _hash_of(words, start, end)
            for s in range(0, len(row), 1 << 16):
                part = slice(s, s + (1 << 16))
                at = pa.array(row[part] + a)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(key[part].view(np.int64)), pa.array(seg[part].view(np.int64)), pa.array(start[part] - words.first[row[part]]), pa.array(end[part] - start[part])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "key", "seg", "start", "words"])


def _tag(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One hash of a row and a value."""
    return B.mix(value ^ (row.astype(B.U64) * B.U64(0x9E3779B97F4A7C15)))


def _tokens(batches):
    """(key, seg, tokens, least, most) of the segments that each row (node, text, wanted) is asked for, once each."""
    for batch in B.small(batches):
        data, offs = B.lowered(batch.column(1))
        for a, b in B.chunks(offs):
            words = B.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            row, key, start, end = segments(words)
            tag = _tag(row, _hash_of(words, start, end))
            lists = batch.column(2).slice(a, b - a)
            asked = lists.flatten()
            seg = np.asarray(asked.field("seg"))
            owner = np.repeat(np.arange(b - a), np.asarray(lists.value_lengths()))
            order = np.argsort(tag, kind="stable")
            want = _tag(owner, seg.view(B.U64))
            place = np.searchsorted(tag[order], want)
            ok = place < len(tag)
            ok[ok] = tag[order[place[ok]]] == want[ok]
            at = order[place[ok]]
            most, seg, owner = np.asarray(asked.field("most"))[ok], seg[ok], owner[ok]
            row, key, start, end = row[at], key[at], start[at], end[at]
            short = (words.hash >> B.U64(32)).astype(np.uint32)
            size = end - start
            for s in range(0, len(row), 4096):
                part = slice(s, s + 4096)
                count = size[part]
                where = np.arange(count.sum()) + np.repeat(start[part] - (np.cumsum(count) - count), count)
                bounds = np.concatenate([[0], np.cumsum(count * 4)]).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(short[where].tobytes())])
                columns = [pa.array(key[part].view(np.int64)), pa.array(seg[part]), tokens, batch.column(0).take(pa.array(owner[part] + a)), pa.array(most[part])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "seg", "tokens", "least", "most"])


def _windows(batches):
    """(node, doc_id, win, start) of every window in the ranges (start, words) that each row (node, doc_id, text, ranges) is asked for."""
    for batch in B.small(batches):
        data, offs = B.lowered(batch.column(2))
        for a, b in B.chunks(offs):
            words = B.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            lists = batch.column(3).slice(a, b - a)
            asked = lists.flatten()
            owner = np.repeat(np.arange(b - a), np.asarray(lists.value_lengths()))
            start, count = np.asarray(asked.field("start")) + words.first[owner], np.asarray(asked.field("words")) - WINDOW + 1
            row = np.repeat(owner, count)
            at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
            for s in range(0, len(row), 1 << 16):
                part = slice(s, s + (1 << 16))
                win = _hash_of(words, at[part], at[part] + WINDOW)
                to = pa.array(row[part] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(to), batch.column(1).take(to), pa.array(win.view(np.int64)), pa.array(at[part] - words.first[row[part]])], ["node", "doc_id", "win", "start"])


def shared_ranges(tokens: list[np.ndarray], owner: np.ndarray, many: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, end) of what some sequences share with those of other owners; ``many`` have several owners."""
    size = np.array([len(x) for x in tokens], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    single = np.flatnonzero(~many)
    whole = np.flatnonzero(many)
    out = [(whole, np.zeros(len(whole), np.int64), size[whole])]
    if len(single) and len(tokens) > 1:
        _, flat = np.unique(np.concatenate(tokens), return_inverse=True)
        _, own = np.unique(owner, return_inverse=True)
        own = np.where(many, own.max() + 1 + np.arange(len(own)), own)
        index = M.FMIndex(flat, bounds, own, int(size.max()) + 1)
        q, a, b = M.shared_windows(index, flat, bounds[single], bounds[single + 1], window)
        q = single[q]
        out.append((q, a - bounds[q], b - bounds[q]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(batches):
    """(seg, start, end) by one index after another over a shard, whose rows come in the order of their keys."""
    held: list[tuple] = []
    count = 0

    def flush():
        key, seg, tokens, least, most = (np.concatenate(x) if not isinstance(x[0], list) else sum(x, []) for x in zip(*held, strict=True))
        q, a, b = shared_ranges(tokens, least, least != most)
        return pa.RecordBatch.from_arrays([pa.array(seg[q]), pa.array(a), pa.array(b)], ["seg", "start", "end"])

    for batch in batches:
        key = batch.column(0).to_numpy()
        raw, offs = B.buffers(batch.column(2))
        numbers = raw.copy().view(np.uint32)
        tokens = np.split(numbers, (offs[1:-1] // 4).astype(np.int64)) if len(key) else []
        columns = (batch.column(1).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy())
        turns = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for s, e in zip(turns[:-1], turns[1:], strict=True):
            if s == e:
                continue
            if count >= INDEX_WORDS and held[-1][0][-1] != key[s]:
                yield flush()
                held, count = [], 0
            held.append((key[s:e], columns[0][s:e], tokens[s:e], columns[1][s:e], columns[2][s:e]))
            count += int(offs[e] - offs[s]) // 4
    if held:
        yield flush()


def merge(starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges of each row: (row, start, end)."""
    order = np.lexsort((starts, row))
    starts, ends, row = starts[order], ends[order], row[order]
    if not len(row):
        return row, starts, ends
    step = int(ends.max()) + 2
    far = np.maximum.accumulate(ends + row * step) - row * step
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) > 0) | (starts[1:] > far[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    return row[head], starts[head], far[tail]


def _merged(batches):
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        own = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        row, start, end = merge(np.asarray(flat.field("start")), np.asarray(flat.field("end")), own)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end)], ["doc_id", "start_word", "end_word"])


def node() -> F.Column:
    """A key of a document's id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "text")


def _of_many(rows: DataFrame, key: str) -> DataFrame:
    """The keys that rows of at least two documents have."""
    return rows.groupBy(key).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(key)


def repeats(docs: DataFrame, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word) of each range that is repeated in another document."""
    rows = docs.where("text is not null").select(node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    located = cut(rows.mapInArrow(_located, "node long, doc_id long, key long, seg long, start long, words long"))
    some = cut(located.join(_of_many(located, "key"), "key", "left_semi"))
    segs = some.groupBy("key", "seg").agg(F.min("node").alias("node"), F.max("node").alias("most"), F.first("words").alias("words"))
    heavy = cut(segs.groupBy("key").agg(F.sum("words").alias("total")).where(F.col("total") > heavy_words).select("key"))
    # the text of a segment comes from one document that holds it
    wanted = segs.join(heavy, "key", "left_anti").groupBy("node").agg(F.collect_list(F.struct("seg", "most")).alias("wanted"))
    texts = rows.select("node", "text").join(wanted, "node").dropDuplicates(["node"]).select("node", "text", "wanted")
    shards = texts.mapInArrow(_tokens, "key long, seg long, tokens binary, least long, most long").select("key", "seg", "tokens", "least", "most").repartition("key").sortWithinPartitions("key")
    ranges = shards.mapInArrow(_search, "seg long, start long, end long")
    held = some.select("seg", "node", "doc_id", F.col("start").alias("at"))
    spans = held.join(ranges, "seg").select("node", "doc_id", F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")).alias("span"))
    if not heavy.isEmpty():
        asked = some.join(heavy, "key", "left_semi").select("node", "start", "words").distinct().groupBy("node").agg(F.collect_list(F.struct("start", "words")).alias("ranges"))
        texts = rows.join(asked, "node").dropDuplicates(["node"]).select("node", "doc_id", "text", "ranges")
        windows = cut(texts.mapInArrow(_windows, "node long, doc_id long, win long, start long"))
        alike = windows.join(_of_many(windows, "win"), "win", "left_semi")
        spans = spans.unionByName(alike.select("node", "doc_id", F.struct("start", (F.col("start") + WINDOW).alias("end")).alias("span")))
    return spans.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.collect_set("span").alias("spans")).select("doc_id", "spans").mapInArrow(_merged, "doc_id long, start_word long, end_word long")


def op4_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated ranges of all documents."""
    return repeats(table(spark, sf_dir, "documents"))
