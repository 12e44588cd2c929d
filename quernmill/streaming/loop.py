"""The online loop: safety, self-labels, uncertainty, decision, memory, symbolic updates and consolidation, batch by batch.

What a model predicts is an input: ``uncertainty`` is a column, and a labeller gives labels with their
confidence.  Decisions are columns, the same over a batch and over a stream.  What a micro-batch leaves
behind is written below a folder, in a directory of its own number, so that a batch that is run again
after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernmill.operators import conversion as C
from quernmill.operators import memory as Y
from quernmill.operators import metrics as M
from quernmill.operators import rules as R
from quernmill.operators import safety as S

SAMPLE = {"entities": "array<string>", "concepts": "array<array<string>>", "relations": "array<struct<head:int,tail:int,rel:string>>", "uncertainty": "double"}
#: What a labeller adds, each beside the sample's own.
LABELS = {"label_entities": SAMPLE["entities"], "label_concepts": SAMPLE["concepts"], "label_relations": SAMPLE["relations"], "label_confidence": "double"}
EVENT = "total bigint, learned bigint, skipped_confident bigint, skipped_unsafe bigint, deferred bigint, self_labeled bigint, mean_uncertainty double, batch bigint"


def normalised(rows: DataFrame, columns: dict[str, str] = SAMPLE) -> DataFrame:
    """Samples with all their columns: what is missing is an empty list, or null."""
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c).cast(kind), empty(kind)) if c in have else empty(kind) for c, kind in columns.items()})


@dataclass
class Loop:
    """Configuration of a loop, and its steps."""

    threshold: float = 0.5
    force: bool = False
    min_confidence: float = 0.6
    strictness: str = "medium"
    keywords: S.Keywords = field(default_factory=S.Keywords)
    constraints: list[S.Constraint] = field(default_factory=lambda: list(S.CONSTRAINTS))
    labeller: Callable[[DataFrame], DataFrame] | None = None
    memory_size: int = 1000
    memory_strategy: str = "reservoir"
    max_concepts: int = 2048
    rule_frequency: int = 3
    rule_confidence: float = 0.5
    consolidate_every: int = 5
    consolidate_least: int = 50
    callback: Callable[[DataFrame, int], None] | None = None

    def decided(self, samples: DataFrame) -> DataFrame:
        """Samples with ``verdict``, ``self_labeled`` and ``decision``: skip_unsafe, defer, learn or skip_confident.

        An unsafe text is skipped.  A sample without entities or concepts takes the labeller's, if they are
        sure enough, and is deferred otherwise.  A missing uncertainty is no reason to learn.
        """
        rows = normalised(samples)
        rows = normalised(self.labeller(rows) if self.labeller else rows, LABELS)
        rows = S.regulate(rows, self.keywords, self.strictness, constraints=self.constraints)
        rows = rows.withColumn("_needs", C.needs_labels("entities", "concepts"))
        rows = rows.withColumn("_sure", F.col("_needs") & (F.coalesce("label_confidence", F.lit(0.0)) >= self.min_confidence) & ~C.needs_labels("label_entities", "label_concepts"))
        safe = F.col("verdict.is_safe")
        learn = M.decision(F.coalesce("uncertainty", F.lit(0.0)), self.threshold, self.force)
        rows = rows.withColumn("decision", F.when(~safe, "skip_unsafe").when(F.col("_needs") & ~F.col("_sure"), "defer").otherwise(learn)).withColumn("self_labeled", safe & F.col("_sure"))
        own = {c: F.when(F.col("_sure"), F.col(f"label_{c}")).otherwise(F.col(c)) for c in ("entities", "concepts", "relations")}
        return rows.withColumns(own).drop("_needs", "_sure", *LABELS)

    def statistics(self, decided: DataFrame) -> DataFrame:
        """One row of counts over decided samples, and the mean uncertainty of those learned."""
        n = lambda d: F.count_if(F.col("decision") == d)
        return decided.agg(F.count(F.lit(1)).alias("total"), n("learn").alias("learned"), n("skip_confident").alias("skipped_confident"), n("skip_unsafe").alias("skipped_unsafe"), n("defer").alias("deferred"), F.count_if("self_labeled").alias("self_labeled"), F.avg(F.when(F.col("decision") == "learn", F.col("uncertainty"))).alias("mean_uncertainty"))

    def remembered(self, before: DataFrame | None, new: DataFrame) -> DataFrame:
        """Memory after new entries (sample_id, concept, uncertainty), by its strategy over all; an unknown strategy is a reservoir."""
        rows = new if before is None else before.unionByName(new).dropDuplicates(["sample_id"])
        if self.memory_strategy == "uncertainty":
            return Y.most_uncertain(rows, self.memory_size, "uncertainty", "sample_id")
        if self.memory_strategy == "balanced":
            return Y.balanced(rows, self.memory_size, "concept", "sample_id")
        return Y.reservoir(rows, self.memory_size, "sample_id")

    def step(self, folder: str) -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` calls: works a micro-batch of samples (sample_id, text, ...) and leaves its results below a folder."""

        def run(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            put(self.decided(batch).drop("batch"), "decided")
            # all that follows reads what was written, so that nothing is decided twice
            rows = spark.read.parquet(f"{folder}/decided/batch={number}")
            passed = rows.where("decision in ('learn', 'skip_confident')")
            entry = passed.select("sample_id", F.get(F.flatten("concepts"), F.lit(0)).alias("concept"), "uncertainty")
            before = spark.read.parquet(f"{folder}/memory/batch={number - 1}") if number > 0 else None
            put(self.remembered(before, entry), "memory")
            put(passed.select("entities", "concepts", "relations"), "observed")
            put(self.statistics(rows), "statistics")
            if self.callback:
                self.callback(rows, number)

        return run

    def start(self, stream: DataFrame, folder: str, once: bool = True):
        """Runs the loop over a stream of samples; with ``once`` over what there is."""
        writer = stream.writeStream.foreachBatch(self.step(folder)).option("checkpointLocation", f"{folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def events(self, spark: SparkSession, folder: str) -> DataFrame:
        """The learning events: a row for each batch that learned, and whether weights are consolidated after it."""
        log = spark.read.schema(EVENT).parquet(f"{folder}/statistics").where("learned > 0")
        so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
        rows = log.withColumn("_n", F.count(F.lit(1)).over(so_far)).withColumn("_s", F.sum("learned").over(so_far))
        return rows.withColumn("consolidates", (F.col("_n") % self.consolidate_every == 0) & (F.col("_s") >= self.consolidate_least)).drop("_n", "_s")

    def symbolic(self, spark: SparkSession, folder: str, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(concepts, rules, relations) that all samples so far update the known concepts (name, id) with."""
        observed = spark.read.parquet(f"{folder}/observed").drop("batch")
        return R.process_samples(observed, known, self.max_concepts, self.rule_frequency, self.rule_confidence)

    def rollup(self, spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
        """One row: samples seen and learned, learning events, memory, concepts, rules and relations so far."""
        log = spark.read.schema(EVENT).parquet(f"{folder}/statistics")
        seen = log.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("seen"), F.coalesce(F.sum("learned"), F.lit(0)).alias("learned"), F.count_if(F.col("learned") > 0).alias("events"), F.max("batch").alias("last"))
        memory = spark.read.parquet(f"{folder}/memory")
        held = memory.groupBy("batch").agg(F.count(F.lit(1)).alias("memory"))
        concepts, rules, relations = self.symbolic(spark, folder, known)
        one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
        out = seen.join(held, F.col("last") == F.col("batch"), "left").select("seen", "learned", "events", F.coalesce("memory", F.lit(0)).alias("memory"))
        return out.crossJoin(one(concepts, "concepts")).crossJoin(one(rules, "rules")).crossJoin(one(relations, "relations"))


def freeze(parameters: DataFrame, patterns: list[str]) -> DataFrame:
    """(name, ..., trained) of a table of parameters: those whose name holds one of the patterns aren't trained."""
    held: Column = F.lit(False)
    for p in patterns:
        held = held | F.contains("name", F.lit(p))
    return parameters.withColumn("trained", ~held)
