"""Vocabularies, mixtures, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernmill.functions.text import order_key
from quernmill.session import cut

ENTITY_TYPES = ["person", "location", "organization", "object", "animal", "attribute", "temporal", "quantity", "event", "concept"]
#: Ranges of draws that a mixture counts.
BINS = 4096
PRIORITY = ["animal", "person", "location", "attribute", "predator"]


def ranked(rows: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in an order, without bringing them to one partition.

    They are range-partitioned and counted by partition; only the counts reach the driver.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    kept = cut(sorted_.withColumn("_m", F.monotonically_increasing_id()))
    first = kept.groupBy("_p").agg(F.min("_m").alias("_f"), F.count(F.lit(1)).alias("_c"))
    before = first.withColumn("_before", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    out = kept.join(F.broadcast(before.select("_p", "_f", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p")
    return out.withColumn(name, (F.col("_m") - F.col("_f") + F.col("_before") + 1).cast("long")).drop("_p", "_m", "_f", "_before")


def vocabulary(names: DataFrame, column: str, base: int = 0) -> DataFrame:
    """(name, id): distinct names in their order, numbered from ``base``."""
    distinct = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    return ranked(distinct, F.col("name"), name="n").select("name", (F.col("n") - 1 + base).cast("int").alias("id"))


def capacities(concepts: Column, relations: Column, types: Column | None = None) -> Column:
    """Room for entity types, concepts and relations beyond those there are."""
    return F.struct(F.greatest(F.lit(16), (types if types is not None else F.lit(0)) + 4).alias("types"), F.greatest(F.lit(64), relations + 10).alias("relations"), F.greatest(F.lit(256), concepts + 50).alias("concepts"))


def type_map(concepts: DataFrame, most: int | None = None, priority: list[str] = PRIORITY) -> DataFrame:
    """(concept, id) from (concept, position): the priority names that occur, in their order, then others by frequency, ties by first position."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("concept"))
    counted = concepts.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    keyed = counted.withColumn("_r", F.when(rank == 0, len(priority) + 1).otherwise(rank)).withColumn("_n", F.when(rank == 0, -F.col("n")))
    out = ranked(keyed, F.col("_r"), F.col("_n"), F.col("first"), F.col("concept"), name="_id").select("concept", (F.col("_id") - 1).cast("int").alias("id"))
    return out.where(F.col("id") < most) if most is not None else out


def splits(rows: DataFrame, *key: str, train: float = 0.8, val: float = 0.1, seed: str = "split") -> DataFrame:
    """A ``split`` column of exact sizes, truncated for train and val; the rest is test."""
    total = rows.count()
    a, b = int(total * train), int(total * train) + int(total * val)
    numbered = ranked(rows.withColumn("_k", order_key(*key, seed=seed)), F.col("_k"), *[F.col(k) for k in key], name="_n")
    return numbered.withColumn("split", F.when(F.col("_n") <= a, "train").when(F.col("_n") <= b, "val").otherwise("test")).drop("_n", "_k")


def mixture(rows: DataFrame, source: str, ratios: dict[str, float], *key: str, seed: str = "mix") -> DataFrame:
    """Of each source as many rows as its ratio of the total asks for, if it has them; sources without a ratio are left out.

    The rows of a source are those with the least draws.  Draws are counted in ``BINS`` ranges first, so
    that only the one range where a source's quota ends is ordered; the rest is kept or left as it is.
    """
    total = rows.count()
    most = F.create_map(*[F.lit(x) for s, r in ratios.items() for x in (s, int(total * r))]) if ratios else F.create_map().cast("map<string,int>")
    drawn = rows.where(F.col(source).isin(list(ratios))).withColumn("_k", order_key(*key, seed=seed)).withColumn("_b", F.floor(F.col("_k") / (2**32 // BINS)).cast("int"))
    bins = drawn.groupBy(F.col(source).alias("_s"), F.col("_b").alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a source: the range where its quota ends, and what is left of the quota there
    last = bins.withColumn("_a", before).where((F.col("_a") < most[F.col("_s")]) & (F.col("_a") + F.col("_c") >= most[F.col("_s")]))
    last = last.select("_s", F.col("_bin").alias("_last"), (most[F.col("_s")] - F.col("_a")).alias("_left"))
    placed = drawn.join(F.broadcast(last), F.col(source) == F.col("_s"), "left").where((most[F.col(source)] > 0) & (F.col("_last").isNull() | (F.col("_b") <= F.col("_last"))))
    edge = placed.where(F.col("_b") == F.col("_last"))
    edge = edge.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy("_k", *key))).where(F.col("_n") <= F.col("_left"))
    inside = placed.where(F.col("_last").isNull() | (F.col("_b") < F.col("_last")))
    return inside.select(*rows.columns).unionByName(edge.select(*rows.columns))


def distinct_names(samples: DataFrame, *columns: str) -> DataFrame:
    """(kind, name) of the distinct names of some columns."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in columns]))
    return samples.select(kinds.alias("x")).select("x.*").where("name is not null").distinct()


def batches(rows: DataFrame, size: int, *key: str, seed: str = "batch") -> DataFrame:
    """A ``batch`` number for each row in shuffled order; an incomplete last batch goes if there is another."""
    total = rows.count()
    numbered = ranked(rows.withColumn("_k", order_key(*key, seed=seed)), F.col("_k"), *[F.col(k) for k in key], name="_n")
    out = numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n", "_k")
    return out.where(F.col("batch") < total // size) if total > size else out
