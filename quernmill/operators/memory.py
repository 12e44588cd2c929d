"""Replay memory: what is kept, and what is drawn.

The batch operators are what the sequential strategies amount to when each draw is a hash of the id:
any engine then keeps the same rows.  The fold itself, in arrival order, is in ``streaming.memory``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernmill.functions.text import order_key
from quernmill.operators.blocks import against, greatest
from quernmill.operators.rules import dot, norm


def uniform(*key: str, seed: str) -> Column:
    """A number in (0, 1) that stands for a random draw."""
    return (order_key(*key, seed=seed) + 0.5) / 4294967296.0


def reservoir(rows: DataFrame, most: int, *key: str, seed: str = "reservoir") -> DataFrame:
    """A uniform sample: the ``most`` least by hash."""
    return rows.orderBy(order_key(*key, seed=seed), *key).limit(most)


def most_uncertain(rows: DataFrame, most: int, uncertainty: str, *key: str) -> DataFrame:
    """The ``most`` most uncertain; among equals the earliest stays."""
    return rows.orderBy(F.col(uncertainty).desc(), *key).limit(most)


def balanced(rows: DataFrame, most: int, concept: str, *key: str, seed: str = "balanced") -> DataFrame:
    """At most ``most`` rows over the number of concepts, of each concept."""
    n = rows.agg(F.count_distinct(concept)).first()[0]
    place = F.row_number().over(Window.partitionBy(concept).orderBy(order_key(*key, seed=seed), *key))
    return rows.withColumn("_n", place).where(F.col("_n") <= max(1, most // max(1, n))).drop("_n")


def distance(a: Column | str, b: Column | str) -> Column:
    return 1 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def diversity_threshold(vectors: DataFrame, id_column: str, vec: str, sample: int = 50, share: float = 0.25) -> DataFrame:
    """One row: the quantile of the distances of all pairs of a hash sample of ``sample`` vectors."""
    some = vectors.orderBy(order_key(id_column, seed="diversity"), id_column).limit(sample).select(F.col(id_column).alias("i"), F.col(vec).alias("u"))
    other = some.select(F.col("i").alias("j"), F.col("u").alias("v"))
    return some.join(other, F.col("i") < F.col("j")).agg(F.percentile(distance("u", "v"), F.lit(share)).alias("threshold"))


def nearest_distance(vectors: DataFrame, memory: DataFrame, id_column: str, vec: str) -> DataFrame:
    """(id, distance) of each vector to the nearest other in memory, which holds few."""
    m = memory.select(F.col(id_column).alias("_j"), F.col(vec).alias("_v"))
    near = against(vectors, m, id_column, vec, "_j", "_v", greatest(1), eps=1e-12)
    return near.groupBy(id_column).agg((1 - F.max("similarity")).alias("distance"))


def concept_counts(rows: DataFrame, concept: str, known: DataFrame | None = None) -> DataFrame:
    """(concept, n): entries by concept; known concepts (concept) without any are kept at zero."""
    counts = rows.groupBy(F.col(concept).alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    if known is None:
        return counts
    names = known.select("concept").unionByName(counts.select("concept")).distinct()
    return names.join(counts, "concept", "left").select("concept", F.coalesce("n", F.lit(0)).alias("n"))


def changed_counts(before: DataFrame, added: DataFrame, removed: DataFrame, concept: str) -> DataFrame:
    """Counts (concept, n) after entries are added and removed; a concept left without any stays at zero."""
    one = lambda rows, by: rows.select(F.col(concept).alias("concept"), F.lit(by).cast("long").alias("n"))
    return before.select("concept", "n").unionByName(one(added, 1)).unionByName(one(removed, -1)).groupBy("concept").agg(F.greatest(F.sum("n"), F.lit(0)).alias("n"))


def hybrid(rows: DataFrame, memory: DataFrame, id_column: str, vec: str, uncertainty: str, weight: float = 0.5) -> DataFrame:
    """New rows, not in memory, that would displace an entry: their uncertainty alone exceeds the least score in memory.

    An entry's score is its uncertainty and its distance to the nearest other entry, weighted.
    """
    held = memory.join(nearest_distance(memory, memory, id_column, vec), id_column)
    least = held.agg(F.min((1 - weight) * F.col(uncertainty) + weight * F.col("distance")).alias("_least"))
    new = rows.join(memory.select(id_column), id_column, "left_anti")
    return new.crossJoin(least).where(F.col(uncertainty) > F.col("_least")).drop("_least")


def cleared(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Empties the memory kept in a folder, and returns what is there then: nothing."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def weighted_draw(rows: DataFrame, most: int, weight: str, *key: str, seed: str = "draw") -> DataFrame:
    """A weighted sample without replacement: the greatest ln(u) / w."""
    k = F.ln(uniform(*key, seed=seed)) / F.greatest(F.col(weight), F.lit(1e-9))
    return rows.orderBy(k.desc(), *key).limit(most)


def draw(rows: DataFrame, most: int, strategy: str, *key: str, uncertainty: str = "uncertainty", time: str = "ts", importance: str = "importance", seed: str = "draw") -> DataFrame:
    """A batch from memory: ``uncertain``, ``recent``, ``weighted`` or, else, random."""
    if strategy == "uncertain":
        return most_uncertain(rows, most, uncertainty, *key)
    if strategy == "recent":
        return rows.orderBy(F.col(time).desc(), *key).limit(most)
    if strategy == "weighted":
        return weighted_draw(rows, most, importance, *key, seed=seed)
    return reservoir(rows, most, *key, seed=seed)


def mixed_batch(new: DataFrame, memory: DataFrame, target: int, ratio: float, *key: str) -> DataFrame:
    """New rows and replayed ones, marked: replay has its share of the target, and more if new rows are short of theirs."""
    there = new.count()
    n_replay = int(target * ratio)
    n_new = min(there, target - n_replay)
    n_replay = max(n_replay, target - n_new)
    return reservoir(new, n_new, *key, seed="new").withColumn("replayed", F.lit(False)).unionByName(reservoir(memory, n_replay, *key, seed="replay").withColumn("replayed", F.lit(True)))


def statistics(rows: DataFrame, uncertainty: str, concept: str) -> DataFrame:
    """Size, mean and range of uncertainty, and rows by concept."""
    by = rows.groupBy(concept).agg(F.count(F.lit(1)).alias("n"), F.sum(uncertainty).alias("s"), F.min(uncertainty).alias("lo"), F.max(uncertainty).alias("hi"))
    counts = F.array_sort(F.collect_list(F.struct(F.col(concept).alias("concept"), "n"))).alias("concepts")
    return by.agg(F.sum("n").alias("size"), (F.sum("s") / F.sum("n")).alias("mean_uncertainty"), F.min("lo").alias("least"), F.max("hi").alias("most"), counts)
