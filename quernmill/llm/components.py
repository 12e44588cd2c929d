"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.session import cut


class Forest:
    """Union-find over 64-bit ids, for the edges of one partition."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def local_stars(batches, most: int = 1_000_000):
    """Edges (a, b) of a partition in; edges (member, least member) of its components out, of up to about ``most`` nodes at a time."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > most:
            yield from _stars(forest)
            forest = Forest()
    yield from _stars(forest)


def _stars(forest: Forest):
    members = np.fromiter(forest.up, np.int64, len(forest.up))
    roots = np.fromiter((forest.find(x) for x in forest.up), np.int64, len(forest.up))
    for at in range(0, len(members), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(members[at : at + (1 << 16)]), pa.array(roots[at : at + (1 << 16)])], ["a", "b"])


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots themselves; root is the component's least node.

    Each partition first reduces its edges to stars.  A round is a large-star and a small-star step and is cut
    from its lineage by a checkpoint; the rounds end when all edges are those of stars, which a step doesn't
    change.  If ``rounds`` is given and they run out before, that is an error.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(local_stars, "a long, b long").distinct())
    for done in count(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # large star: neighbours greater than the node go to the least of node and neighbours
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: the node and its lesser neighbours go to the least of these
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(new)
        stars = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        single = stars and new.groupBy("a").count().where("count > 1").isEmpty()
        edges = new
        if single:
            break
        if done == rounds:
            raise RuntimeError(f"components haven't converged after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
