"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass counts in how many contexts, of two words to either side, each word trigram of the
benchmark occurs; occurrences in a run of ``LONG`` words that stands in an item don't count.  So
neither copies of an item, exact or with the same edits, nor copies of a document that holds one make
its trigrams common, however many there are.  An item's seeds are its trigrams that occur in at most
``FLOOR`` contexts, or a share of ``RARE`` of the documents' number if that is more, and all its runs of
``LONG`` words; of an item of fewer than ``LONG`` words, all its trigrams.  A second pass looks seeds up in every document.  Around the
seeds of an item that a document has, stretches are cut that hold every alignment through a seed that
could reach the threshold, and are aligned with it by Smith-Waterman over words: a match scores 2, a
mismatch or gap -1.  The score over that of the whole item, 0 to 1, is kept if it is at least ``THRESHOLD``.

All contexts of all documents are counted, as hashes: the rows shuffled are as many as the different
contexts of the benchmark's trigrams, each but once.  Seeds are looked up, stretches aligned and rows
dropped without moving any text.  What is broadcast is at most about ``BROADCAST_GRAMS`` trigrams, or the
items of so many seeds, at a time; a larger benchmark is split by hash and the documents are passed once
for each slice, with equal results.  The runs of ``LONG`` words are known to all slices by a bit set of at
most 32 MB; runs that it may hold are joined with those of the items, so that a full one costs rows
shuffled and changes no count.

Defined results: null and empty texts on either side have no hit, items of fewer than three words
have no trigram and are never found; repeated rows and items give equal rows once; null ids are ids
of their own; other columns are ignored by ``matches`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.session import cut, table

GRAM = 3
LONG = 5
RARE = 1e-4
FLOOR = 50
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, 1, 1
BROADCAST_GRAMS = 2_000_000
#: Columns for the runs of LONG words over a trigram.
RUNS = [f"run{k}" for k in range(LONG - GRAM + 1)]


def _item_grams(batches):
    """(item, size, gram) of each item: its trigrams and its runs of LONG words."""
    for batch in batches:
        data, offs = B.lowered(batch.column(1))
        items = batch.column(0)
        for a, b in B.chunks(offs):
            words = B.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            for size in (GRAM, LONG):
                at = B.gram_starts(words.first, size)
                gram = B.ngrams(words.hash, size)[at]
                row = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([items.take(pa.array(row + a)), pa.array(np.full(len(at), size)), pa.array(gram.view(np.int64))], ["item", "size", "gram"])


class BitSet:
    """A set of hashes that may seem to hold some that it doesn't."""

    def __init__(self, expected: int):
        self.width = min(28, max(16, int(64 * max(expected, 1)).bit_length()))
        self.bits = np.zeros(1 << (self.width - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes >> B.U64(64 - self.width)
        np.bitwise_or.at(self.bits, (at >> B.U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & B.U64(7)).astype(np.uint8)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> B.U64(64 - self.width)
        return (self.bits[(at >> B.U64(3)).view(np.int64)] >> (at & B.U64(7)).astype(np.uint8)) & 1 == 1


class Lookup:
    """Places of hashes in a sorted list, with a bit set before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = BitSet(len(keys))
        self.maybe.add(keys)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are there, their places)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.flatnonzero(self.maybe.has(hashes))
        place = np.minimum(np.searchsorted(self.keys, hashes[which]), len(self.keys) - 1)
        ok = self.keys[place] == hashes[which]
        return which[ok], place[ok]


def contexts_of(column: pa.Array, lookup: Lookup, runs: BitSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, context, runs) of the lookup's trigrams, distinct by chunk; runs has a row for each place of a run of LONG words over the trigram, 0 where that can't be an item's."""
    out = [(np.zeros(0, B.U64), np.zeros(0, B.U64), np.zeros((len(RUNS), 0), B.U64))]
    data, offs = B.lowered(column)
    for a, b in B.chunks(offs):
        words = B.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        at = B.gram_starts(words.first, GRAM)
        which, place = lookup.find(B.ngrams(words.hash, GRAM)[at])
        at = at[which]
        if not len(at):
            continue
        row = np.searchsorted(words.first, at, "right") - 1
        context = lookup.keys[place]
        for step in (-2, -1, GRAM, GRAM + 1):
            near = at + step
            inside = (near >= words.first[row]) & (near < words.first[row + 1])
            context = B.mix(context ^ np.where(inside, words.hash[np.clip(near, 0, len(words) - 1)], B.U64(0)))
        long = B.gram_starts(words.first, LONG)
        run = B.ngrams(words.hash, LONG)
        # 0 also for the two places before the first word
        known = np.zeros(len(words) + LONG - GRAM, B.U64)
        long = long[runs.has(run[long])]
        known[long + LONG - GRAM] = run[long]
        _, one = np.unique(context, return_index=True)
        out.append((lookup.keys[place[one]], context[one], np.stack([known[at[one] + k] for k in range(len(RUNS))])))
    return tuple(np.concatenate(x, axis=-1) for x in zip(*out, strict=True))


@dataclass
class Items:
    """Some items: their seeds, the items of each seed, and their words."""

    seeds: Lookup
    first: np.ndarray
    owners: np.ndarray
    words: list[np.ndarray]
    ids: np.ndarray


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of some ranges, and the number of the range that each is of."""
    own = np.repeat(np.arange(len(count)), count)
    return np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own], own


def found_in(column: pa.Array, items: Items, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of the texts and items that align at least at the threshold."""
    data_all, offs = B.lowered(column)
    length = np.array([len(w) for w in items.words], np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a, b in B.chunks(offs):
        words = B.Words(data_all[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        hits = []
        for size in (GRAM, LONG):
            at = B.gram_starts(words.first, size)
            which, place = items.seeds.find(B.ngrams(words.hash, size)[at])
            each, own = _spread(items.first[place], items.first[place + 1] - items.first[place])
            hits.append((at[which][own], items.owners[each], np.full(len(own), size)))
        at, item, size = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(at):
            continue
        row = np.searchsorted(words.first, at, "right") - 1
        # an alignment that reaches the threshold has at most as many gaps as the item has words
        left = np.maximum(at - 2 * length[item], words.first[row])
        right = np.minimum(at + size + 2 * length[item], words.first[row + 1])
        order = np.lexsort((left, item, row))
        row, item, left, right = row[order], item[order], left[order], right[order]
        change = np.ones(len(row), bool)
        change[1:] = (np.diff(row) > 0) | (np.diff(item) != 0)
        # stretches of one row and item that touch are one
        group = np.cumsum(change) - 1
        step = len(words) + 1
        far = np.maximum.accumulate(right + group * step) - group * step
        new = change.copy()
        new[1:] |= left[1:] > far[:-1]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1
        for k in range(0, len(head), 1 << 14):
            h, t = head[k : k + (1 << 14)], tail[k : k + (1 << 14)]
            score = align([words.hash[x:y] for x, y in zip(left[h], far[t], strict=True)], [items.words[i] for i in item[h]])
            ok = score >= threshold
            out.append((row[h][ok] + a, item[h][ok], score[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(passages: list[np.ndarray], items: list[np.ndarray], cells: int = 1 << 19) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, over that of the whole item."""
    score = np.zeros(len(items))
    size = np.array([len(p) for p in passages], np.int64)
    length = np.array([len(i) for i in items], np.int64)
    order = np.lexsort((length, size))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and size[order[end]] * (end + 1 - at) <= cells:
            end += 1
        own = order[at:end]
        m, n = int(size[own].max()), int(length[own].max())
        p = np.zeros((len(own), m), np.uint64)
        q = np.full((len(own), n), np.uint64(1))
        for k, x in enumerate(own):
            p[k, : size[x]] = passages[x] | np.uint64(2)
            q[k, : length[x]] = items[x] | np.uint64(2)
        ramp = np.arange(m, dtype=np.int32) * GAP
        row = np.zeros((len(own), m + 1), np.int32)
        best = np.zeros(len(own), np.int32)
        for j in range(n):
            step = row[:, :-1] + np.where(p == q[:, j : j + 1], np.int32(MATCH), np.int32(-MISMATCH))
            np.maximum(step, row[:, 1:] - GAP, out=step)
            np.maximum(step, 0, out=step)
            step += ramp
            np.maximum.accumulate(step, axis=1, out=step)
            step -= ramp
            row[:, 1:] = step
            np.maximum(best, step.max(1), out=best)
        score[own] = best / (MATCH * length[own])
        at = end
    return score


def node() -> F.Column:
    """A key of a document's id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "text")


def _slices(rows: DataFrame, key: str, count: int, limit: int) -> list[DataFrame]:
    """The rows in parts of about ``limit`` at most, by a hash of the key."""
    parts = max(1, -(-count // limit))
    return [rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(parts)) == k) for k in range(parts)]


def seeds_of(docs: DataFrame, grams: DataFrame, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """(item, gram) of the seeds of some items' grams (item, size, gram)."""
    spark = docs.sparkSession
    keys = {size: grams.where(F.col("size") == size).select("gram").distinct() for size in (GRAM, LONG)}
    number = {size: rows.count() for size, rows in keys.items()}
    runs = BitSet(number[LONG])
    for part in _slices(keys[LONG], "gram", number[LONG], limit):
        runs.add(part.toArrow().column("gram").to_numpy().view(np.uint64))
    most = max(FLOOR, RARE * docs.count())
    counted = None
    for part in _slices(keys[GRAM], "gram", number[GRAM], limit):
        shared = spark.sparkContext.broadcast((Lookup(np.sort(part.toArrow().column("gram").to_numpy().view(np.uint64))), runs))

        def run(batches, shared=shared):
            for batch in B.small(batches):
                gram, context, over = contexts_of(batch.column(0), *shared.value)
                columns = [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), *(pa.array(x.view(np.int64), mask=x == 0) for x in over)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "context", *RUNS])

        own = docs.where("text is not null").select("text").mapInArrow(run, ", ".join(f"{c} long" for c in ["gram", "context", *RUNS]))
        counted = own if counted is None else counted.unionByName(own)
    # one context has the same runs wherever it stands
    seen = counted.groupBy("gram", "context").agg(*(F.max(c).alias(c) for c in RUNS))
    free = F.coalesce(*RUNS).isNull()
    unsure = seen.where(~free).select("gram", "context", F.explode(F.array_compact(F.array(*RUNS))).alias("run"))
    held = unsure.join(keys[LONG].select(F.col("gram").alias("run"), F.lit(True).alias("held")), "run", "left")
    mistaken = held.groupBy("gram", "context").agg(F.max("held").alias("held")).where("held is null")
    outside = seen.where(free).select("gram").unionByName(mistaken.select("gram"))
    common = outside.groupBy("gram").count().where(F.col("count") > most).select("gram")
    short = grams.where(F.col("size") == GRAM).join(grams.where(F.col("size") == LONG).select("item").distinct(), "item", "left_anti").select("item", "gram")
    rare = grams.where(F.col("size") == GRAM).select("item", "gram").join(common, "gram", "left_anti").select("item", "gram")
    return cut(rare.unionByName(short).unionByName(grams.where(F.col("size") == LONG).select("item", "gram")).distinct())


def _prepared(docs: DataFrame, benchmark: DataFrame, limit: int) -> tuple[DataFrame, list]:
    """(item, item_id) of the items, one item for all of equal text; and broadcast slices of them, with their seeds."""
    spark = docs.sparkSession
    named = benchmark.where("text is not null").select(F.xxhash64("text").alias("item"), F.col("item_id").alias("item_id"), "text")
    texts = named.groupBy("item").agg(F.first("text").alias("text"))
    grams = cut(texts.mapInArrow(_item_grams, "item long, size long, gram long").distinct())
    seeds = seeds_of(docs, grams, limit)
    # as many slices of items as of their seeds
    parts = max(1, -(-seeds.count() // limit))
    shared = []
    for own, words in zip(_slices(seeds, "item", parts, 1), _slices(texts, "item", parts, 1), strict=True):
        pairs = own.toArrow()
        kept = words.join(own.select("item").distinct(), "item", "left_semi").toArrow()
        ids = kept.column("item").to_numpy()
        order = np.argsort(ids)
        hashes = _words(kept.column("text").combine_chunks() if kept.num_rows else pa.array([], pa.string()))
        gram, item = pairs.column("gram").to_numpy().view(np.uint64), pairs.column("item").to_numpy()
        turn = np.lexsort((item, gram))
        keys, first = np.unique(gram[turn], return_index=True)
        owners = np.searchsorted(ids[order], item[turn])
        shared.append(spark.sparkContext.broadcast(Items(Lookup(keys), np.append(first, len(turn)), owners, [hashes[k] for k in order], ids[order])))
    return named.select("item", "item_id").distinct(), shared


def _words(column: pa.Array) -> list[np.ndarray]:
    data, offs = B.lowered(column)
    out = []
    for a, b in B.chunks(offs):
        w = B.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        out += np.split(w.hash, w.first[1:-1])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """(node, doc_id, item_id, score) of every document and item that align at least at the threshold."""
    named, slices = _prepared(docs, benchmark, limit)
    rows = docs.where("text is not null").select(node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for shared in slices:

        def run(batches, shared=shared):
            for batch in B.small(batches):
                row, item, score = found_in(batch.column(2), shared.value, threshold)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shared.value.ids[item], pa.int64()), pa.array(score)], ["node", "doc_id", "item", "score"])

        own = rows.mapInArrow(run, "node long, doc_id long, item long, score double")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("node", "doc_id", "item").agg(F.max("score").alias("score")).join(named, "item").select("node", "doc_id", "item_id", "score")


def keep_clean(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """The rows that hold no item, with all their columns, each where it is."""
    at = docs.columns.index("text")
    out = docs
    for shared in _prepared(docs, benchmark, limit)[1]:

        def run(batches, shared=shared):
            for batch in B.small(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[found_in(batch.column(at), shared.value)[0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that align, with their score."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score")
