"""Near duplicates by ProbMinHash, banding and verification.

A document is the probability distribution of its word trigrams over the whole text, each weighing as
often as it occurs.  Every trigram is a Poisson process whose rate is its weight; each arrival falls
on a random register, which keeps the trigram that arrives there first.  Arrivals are taken round by
round, and a trigram stops as soon as its next arrival is later than all registers of its document,
so that few arrivals are made beyond the first.  Two documents agree in a register with a probability
equal to the probability Jaccard similarity of their distributions.

Documents that agree in all ``ROWS`` registers of one of the ``BANDS`` bands are candidates.  They
are verified by one byte each of all ``REGISTERS`` registers: in a bucket all are compared with the
least, those not similar with the least of the rest, and so on; clusters found so are then compared
member by member with each other, so that the links of a bucket connect just what comparing all
pairs would connect, though a bucket of similar documents costs linear time.  Connected documents
are one group; that with the least id stays.

A bucket of at most ``BUCKET`` different signatures is one row.  A larger one never is: by joins, its
members are compared with its least one, and those not similar to that are a bucket again, until few
are left.  A member that isn't similar to the least one can still be similar to one that is; as
registers that differ are a metric, only those near enough to the border on either side can be, and
these are compared in blocks of ``SIDE``.  So are, after ``STARS`` rounds, all that are left of a bucket.

Texts of fewer than three words are one shingle, of all their words.

Defined results: a null or empty text, or one without a word, is in a group of its own; repeated rows
(same id and text) are one group; among equal ids the row with the least hash stays; null ids rank
last; other columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernmill.llm import bytescan as B
from quernmill.llm.components import Forest, components
from quernmill.session import cut, table

REGISTERS = 128
BANDS = 24
ROWS = 3
SHINGLE = 3
THRESHOLD = 0.45
#: Signatures of a bucket that is verified as one row.
BUCKET = 4096
#: Signatures on either side of a block of a larger bucket.
SIDE = 2048
#: Rounds of comparing a larger bucket with its least signature.
STARS = 6


def signatures(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The first arrival's trigram in each register: (rows, m) hashes of 40 bits; all ones for empty rows."""
    rows = len(starts) - 1
    first = np.full(rows * m, np.inf)
    winner = np.full(rows * m, ~B.U64(0))
    row = np.repeat(np.arange(rows), np.diff(starts))
    inverse = 1.0 / weights
    time = np.zeros(len(terms))
    step = 0
    while len(terms):
        h = B.mix(terms * B.U64(0x9E3779B97F4A7C15) + B.U64((step * 0xD1B54A32D192ED03 + 0x632BE5AB) % 2**64))
        time = time - np.log(((h >> B.U64(11)).astype(np.float64) + 0.5) * 2.0**-53) * inverse
        slot = row * m + (h & B.U64(m - 1)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = np.flatnonzero(first[slot] == time)
        winner[slot[won]] = terms[won]
        latest = first.reshape(rows, m).max(1)
        go = np.flatnonzero(time < latest[row])
        terms, inverse, time, row = terms[go], inverse[go], time[go], row[go]
        step += 1
    return winner.reshape(rows, m)


def sign_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of some texts, and which have a word."""
    data_all, offs = B.lowered(column)
    parts, has = [], []
    for a, b in B.chunks(offs):
        words = B.Words(data_all[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        grams, first = B.shingles(words, SHINGLE)
        terms, times, starts = B.bags(grams, first)
        parts.append(signatures(terms, times.astype(np.float64), starts))
        has.append(np.diff(starts) > 0)
    if not parts:
        return np.zeros((0, REGISTERS), np.uint64), np.zeros(0, bool)
    return np.concatenate(parts), np.concatenate(has)


def _fold(columns: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(columns), B.U64(salt * 0x9E3779B97F4A7C15 % 2**64))
    for x in columns.T:
        h = B.mix(h ^ x)
    return h


def _sign(batches):
    for batch in B.small(batches):
        sigs, has = sign_texts(batch.column(2))
        bands = np.stack([_fold(sigs[:, b * ROWS : (b + 1) * ROWS], b + 1) for b in range(BANDS)], 1)
        digest = _fold(sigs, 99)
        short = (B.mix(sigs) >> B.U64(56)).astype(np.uint8)
        n = len(sigs)
        bytes_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * REGISTERS).tobytes()), pa.py_buffer(short.tobytes())])
        offsets = pa.array((np.arange(n + 1) * BANDS).astype(np.int32))
        out = pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digest.view(np.int64)), bytes_, pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))],
            ["node", "doc_id", "digest", "sig", "bands"],
        )
        yield out.filter(pa.array(has))


def bucket_edges(ids: np.ndarray, sigs: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Edges that connect what the similar pairs of a bucket connect."""
    least = int(np.ceil(threshold * sigs.shape[1]))
    edges, clusters, rest = [], [], np.arange(len(ids))
    while len(rest):
        alike = (sigs[rest] == sigs[rest[0]]).sum(1) >= least
        clusters.append(rest[alike])
        edges += [(int(ids[x]), int(ids[rest[0]])) for x in rest[alike][1:]]
        rest = rest[~alike]
    if len(clusters) > 1:
        forest = Forest()
        for i, one in enumerate(clusters):
            for j in range(i):
                if forest.find(i) == forest.find(j):
                    continue
                for x in one:
                    hit = np.flatnonzero((sigs[clusters[j]] == sigs[x]).sum(1) >= least)
                    if len(hit):
                        edges.append((int(ids[x]), int(ids[clusters[j][hit[0]]])))
                        forest.join(i, j)
                        break
    return edges


def _verify(batches):
    least = int(np.ceil(THRESHOLD * REGISTERS))
    for batch in batches:
        members = batch.column(0)
        offsets = members.offsets.to_numpy()
        flat = members.flatten()
        offsets = offsets - offsets[0]
        ids = flat.field("node").to_numpy(zero_copy_only=False)
        raw, offs = B.buffers(flat.field("sig"))
        sigs = raw.reshape(len(ids), REGISTERS)
        size = np.diff(offsets)
        lead = np.repeat(offsets[:-1], size)
        alike = np.zeros(len(ids), bool)
        for a in range(0, len(ids), 1 << 15):
            alike[a : a + (1 << 15)] = (sigs[a : a + (1 << 15)] == sigs[lead[a : a + (1 << 15)]]).sum(1) >= least
        whole = np.logical_and.reduceat(alike, offsets[:-1]) if len(size) else np.zeros(0, bool)
        own = np.repeat(whole, size) & (np.arange(len(ids)) != lead)
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[lead[own]])], ["a", "b"])
        found = []
        for k in np.flatnonzero(~whole):
            found += bucket_edges(ids[offsets[k] : offsets[k + 1]], sigs[offsets[k] : offsets[k + 1]])
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _agreeing(batches):
    """(key, node, sig, lead, agree) of rows (key, node, sig, lead, lead_sig): the number of registers alike."""
    for batch in batches:
        n = batch.num_rows
        one, other = (B.buffers(batch.column(k))[0].reshape(n, REGISTERS) for k in (2, 4))
        agree = np.zeros(n, np.int64)
        for a in range(0, n, 1 << 15):
            agree[a : a + (1 << 15)] = (one[a : a + (1 << 15)] == other[a : a + (1 << 15)]).sum(1)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(agree)], ["key", "node", "sig", "lead", "agree"])


def block_edges(ids: np.ndarray, sigs: np.ndarray, others: np.ndarray, other_sigs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect what the similar pairs between two sides connect; at most one for each member."""
    forest, edges = Forest(), []
    for x, sig in zip(ids.tolist(), sigs, strict=True):
        for y in others[(other_sigs == sig).sum(1) >= least].tolist():
            if x != y and forest.find(x) != forest.find(y):
                forest.join(x, y)
                edges.append((x, y))
    return edges


def _blocked(batches):
    least = int(np.ceil(THRESHOLD * REGISTERS))
    for batch in batches:
        for k in range(batch.num_rows):
            sides = []
            for column in (0, 1):
                members = batch.column(column)[k].values
                raw, _ = B.buffers(members.field("sig"))
                sides += [members.field("node").to_numpy(zero_copy_only=False), raw.reshape(len(members), REGISTERS)]
            found = np.array(block_edges(*sides, least), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _blocks(left: DataFrame, right: DataFrame | None, side: int) -> DataFrame:
    """Edges of similar pairs between two sides (key, node, sig) of each key, or within one; both are cut into blocks of about ``side`` by hash."""
    same = right is None
    right = left if same else right
    counts = lambda rows, name: rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias(name))
    sizes = counts(left, "m").join(counts(right, "n"), "key")
    place = lambda count: F.pmod(F.xxhash64(F.col("node"), F.lit(5)), F.col(count)).cast("int")
    member = F.struct("node", "sig")
    one = left.join(sizes, "key").withColumn("i", place("m")).withColumn("j", F.explode(F.sequence(F.col("i") if same else F.lit(0), F.col("n") - 1)))
    two = right.join(sizes, "key").withColumn("j", place("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if same else F.col("m") - 1)))
    none = F.lit(None).cast(left.select(member.alias("x")).schema["x"].dataType)
    both = one.select("key", "i", "j", member.alias("x"), none.alias("y")).unionByName(two.select("key", "i", "j", none.alias("x"), member.alias("y")))
    listed = both.groupBy("key", "i", "j").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y")).where("size(x) > 0 and size(y) > 0")
    return listed.select("x", "y").mapInArrow(_blocked, "a long, b long")


def star_edges(rows: DataFrame, bucket: int = BUCKET, side: int = SIDE, stars: int = STARS) -> tuple[list[DataFrame], DataFrame]:
    """(edges, rest) of buckets (key, node, sig) of any size: the edges found, and smaller buckets whose own pairs are still to be compared."""
    least = int(np.ceil(THRESHOLD * REGISTERS))
    edges, small = [], []
    for turn in range(stars):
        lead = rows.groupBy("key").agg(F.min(F.struct("node", "sig")).alias("l")).select("key", F.col("l.node").alias("lead"), F.col("l.sig").alias("lead_sig"))
        seen = cut(rows.join(lead, "key").select("key", "node", "sig", "lead", "lead_sig").mapInArrow(_agreeing, "key long, node long, sig binary, lead long, agree long"))
        near, far = seen.where(F.col("agree") >= least), seen.where(F.col("agree") < least)
        edges.append(near.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
        # with d registers between a member and the least one, and e > d between that and another, these two differ in at least e - d
        border = far.groupBy("key").agg(F.max("agree").alias("most"), F.count(F.lit(1)).alias("n"))
        edge_of = near.groupBy("key").agg(F.min("agree").alias("fewest"))
        inner = near.join(border, "key").where(F.col("agree") <= F.col("most") + (REGISTERS - least)).select("key", "node", "sig")
        outer = far.join(edge_of, "key").where(F.col("fewest") <= F.col("agree") + (REGISTERS - least)).select("key", "node", "sig")
        edges.append(_blocks(inner, outer, side))
        sized = far.join(border.select("key", "n"), "key")
        # what is left is another bucket
        again = F.xxhash64("key", F.lit(turn)).alias("key")
        small.append(sized.where(F.col("n") <= bucket).select(again, "node", "sig"))
        rows = cut(sized.where(F.col("n") > bucket).select(again, "node", "sig"))
        if rows.isEmpty():
            break
    else:
        edges.append(_blocks(rows, None, side))
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    return edges, rest


def _within(rows: DataFrame) -> DataFrame:
    """Edges of buckets (key, node, sig), each verified as one row."""
    listed = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "sig"))).alias("members")).where("size(members) > 1").select("members")
    return listed.mapInArrow(_verify, "a long, b long")


def bucket_links(keyed: DataFrame, heads: DataFrame, bucket: int = BUCKET, side: int = SIDE, stars: int = STARS) -> DataFrame:
    """Edges (a, b) that connect what comparing all pairs of each bucket would connect; keyed (node, key), heads (node, sig)."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node", F.lit(3))).alias("print")).where("n > 1")
    # buckets that several bands have alike are verified once
    sizes = sizes.groupBy("n", "least", "print").agg(F.min("key").alias("key")).select("key", "n")
    many = cut(keyed.join(sizes, "key"))
    edges = _within(many.where(F.col("n") <= bucket).select("key", "node").join(heads, "node"))
    large = many.where(F.col("n") > bucket).select("key", "node")
    if not large.isEmpty():
        found, rest = star_edges(cut(large.join(heads, "node").select("key", "node", "sig")), bucket, side, stars)
        for more in [*found, _within(rest)]:
            edges = edges.unionByName(more)
    return edges


def _node() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "text")


def groups(docs: DataFrame, **sizes: int) -> DataFrame:
    """(node, doc_id, root, root_id) for each distinct document that is in a group with another and isn't the one that stays."""
    rows = docs.select(_node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(rows.mapInArrow(_sign, "node long, doc_id long, digest long, sig binary, bands array<long>"))
    # equal signatures: one of each goes on
    same = signed.groupBy("digest").agg(F.min("node").alias("b"), F.max("node").alias("most"))
    exact = signed.select("digest", F.col("node").alias("a")).join(same.where("b <> most"), "digest").where("a <> b").select("a", "b")
    heads = signed.join(same.select(F.col("b").alias("node")), "node", "left_semi").select("node", "sig", "bands").dropDuplicates(["node"])
    edges = bucket_links(heads.select("node", F.explode("bands").alias("key")), heads.select("node", "sig"), **sizes).unionByName(exact)
    linked = components(edges)
    ids = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()).join(ids, "node")
    # the least id of a component stays; null ids come last
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best"))
    return named.join(best, "root").select("node", "doc_id", F.col("best.node").alias("root"), F.col("best.doc_id").alias("root_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group, with all their columns."""
    dropped = groups(docs).where("node <> root").select(F.col("node").alias("gone"), F.col("doc_id").alias("gone_id"))
    # a row travels as one struct, so that its columns can have any names
    rows = docs.select(_node().alias("node"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.lit(11), "text").alias("second"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # ids are compared so that rows stay partitioned by node alone, which the window below needs too
    same = ((F.col("id") >= F.col("gone_id")) & (F.col("id") <= F.col("gone_id"))) | (F.col("id").isNull() & F.col("gone_id").isNull())
    rows = rows.join(dropped, (F.col("node") == F.col("gone")) & same, "left_anti")
    # rows that repeat id and text are one; other texts whose node is the same by chance stay apart
    nth = F.row_number().over(Window.partitionBy("node", "id", "second").orderBy("node"))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of its group's document that stays, and whether it is that."""
    docs = table(spark, sf_dir, "documents")
    found = groups(docs).select("node", F.col("doc_id").alias("id"), "root", "root_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("own"))
    return rows.join(found, (F.col("own") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("root_id")).alias("group_id"), (F.col("root").isNull() | (F.col("root") == F.col("node"))).alias("stays")
    )
