"""Training stages: what is prepared for each, from which sources, and how sets are converted and loaded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.functions.text import order_key
from quernmill.operators import conversion as C
from quernmill.operators.vocabulary import ranked


def entity_projection(samples: DataFrame) -> DataFrame:
    """Samples for entity and relation training: each entity's type becomes its one concept."""
    rest = [c for c in samples.columns if c != "entity_types"]
    return samples.select(*rest, F.transform("entity_types", lambda t: F.array(t)).alias("concepts"))


def instruction_projection(rows: DataFrame) -> DataFrame:
    """Rows that have instruction and response; an empty context is null."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.where(has("instruction") & has("response")).withColumn("context", F.nullif("context", F.lit("")))


def entity_stage(markup: DataFrame, most: int | None, *order: str) -> DataFrame:
    """Stage 1: linearised triples converted, at most ``most`` converted rows in order, as entity samples."""
    out = C.triplet_samples(markup)
    return entity_projection(out.orderBy(*order).limit(most) if most is not None else out)


def instruction_stage(sources: dict[str, DataFrame], wanted: list[str], most: int | None = None, seed: str = "stage2") -> DataFrame:
    """Stage 2: the wanted sources (key, instruction, response, context, order), unknown ones skipped, of each the first ``most`` rows; with their place in shuffled order."""
    parts = []
    for name in wanted:
        if name in sources:
            rows = instruction_projection(sources[name])
            rows = rows.orderBy("order").limit(most) if most is not None else rows
            parts.append(rows.select(F.lit(name).alias("source"), "key", "instruction", "response", "context"))
    if not parts:
        raise ValueError("no known source")
    return ranked(reduce(DataFrame.unionByName, parts).withColumn("_k", order_key("source", "key", seed=seed)), F.col("_k"), F.col("source"), F.col("key"), name="place").drop("_k")


def prepare_all(spark: SparkSession, stages: dict[str, DataFrame], folder: str) -> DataFrame:
    """Saves each stage as JSON lines below a folder and counts what can be read there: (stage, samples)."""
    counts = []
    for name, rows in stages.items():
        rows.write.mode("overwrite").json(f"{folder}/stage={name}")
        counts.append(spark.read.schema(rows.schema).json(f"{folder}/stage={name}").agg(F.count(F.lit(1)).alias("samples")).select(F.lit(name).alias("stage"), "samples"))
    return reduce(DataFrame.unionByName, counts)


def convert_splits(splits: dict[str, DataFrame], convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each split of a set converted, with its name as ``split``."""
    return reduce(DataFrame.unionByName, [rows.transform(convert).withColumn("split", F.lit(name)) for name, rows in splits.items()])


def load_samples(samples: DataFrame, most: int | None, *order: str) -> DataFrame:
    """Samples after statements are expanded, and of these the first ``most``; a statement comes before its question."""
    out = C.expand_entries(samples)
    return out.orderBy(*order, F.when(F.col("form") == "question", 1).otherwise(0)).limit(most) if most is not None else out
