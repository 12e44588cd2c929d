"""Configuration, logs and small state: what the online loop keeps beside its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.operators import metrics as M
from quernmill.operators import safety as S

CATEGORIES = {"safe", "unknown", *S.SEVERITY, "sexual"}
#: Presets of a run by the machine it is for: context length, batch and accumulation.
PRESETS = {"small": (512, 2, 1), "card_8k": (8192, 2, 8), "card_16k": (16384, 2, 8), "node": (16384, 8, 4)}


@dataclass
class SafetyConfig:
    """Strictness and keyword terms; patterns are added at run time and aren't saved."""

    strictness: str = "medium"
    keywords: S.Keywords = field(default_factory=S.Keywords)
    constraints: list[S.Constraint] = field(default_factory=lambda: list(S.CONSTRAINTS))

    def add_pattern(self, pattern: str, category: str) -> None:
        """An unknown category is a KeyError; a pattern that isn't one is left out."""
        import re

        if category not in CATEGORIES:
            raise KeyError(category)
        try:
            re.compile(pattern)
        except re.error:
            return
        self.keywords.patterns.setdefault(category, []).append(pattern)

    def add_terms(self, block: list[str] | None = None, allow: list[str] | None = None) -> None:
        self.keywords.block += block or []
        self.keywords.allow += allow or []

    def add_constraint(self, name: str, category: str, broken: Callable) -> None:
        self.constraints.append(S.Constraint(name, category, broken))

    def check(self, docs: DataFrame) -> DataFrame:
        """Rows with their verdicts by this configuration."""
        return S.regulate(docs, self.keywords, self.strictness, constraints=self.constraints)

    def check_batch(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Safe and unsafe rows, judged."""
        return S.split_safe(self.check(docs))

    def statistics(self, docs: DataFrame, source: str = "batch") -> DataFrame:
        """Audit statistics of rows judged by this configuration."""
        return S.audit_statistics(S.audit(self.check(docs), source))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.strictness, self.keywords.block, self.keywords.allow)
        spark.createDataFrame([row], "strictness string, block array<string>, allow array<string>").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SafetyConfig:
        row = spark.read.schema("strictness string, block array<string>, allow array<string>").json(path).first()
        return cls(row["strictness"], S.Keywords(allow=list(row["allow"] or []), block=list(row["block"] or [])))


@dataclass
class LearnerState:
    """Counters of the online loop."""

    seen: int = 0
    learned: int = 0
    rejected: int = 0
    skipped: int = 0

    def add(self, decided: DataFrame) -> LearnerState:
        """With the rows of one micro-batch counted in."""
        n = {r["decision"]: r["n"] for r in decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}
        return LearnerState(self.seen + sum(n.values()), self.learned + n.get("learn", 0), self.rejected + n.get("reject_unsafe", 0), self.skipped + n.get("skip_confident", 0))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([asdict(self)], "seen long, learned long, rejected long, skipped long").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LearnerState:
        return cls(**spark.read.schema("seen long, learned long, rejected long, skipped long").json(path).first().asDict())


def to_samples(extracted: DataFrame) -> DataFrame:
    """Rows of (text, entities array<struct<text, type, conf>>, relations) as samples."""
    return extracted.select("text", F.transform("entities", lambda e: e["text"]).alias("entities"), F.transform("entities", lambda e: F.array(e["type"].cast("string"))).alias("concepts"), "relations")


def valid_rules(rules: DataFrame, n_types: int, n_relations: int) -> DataFrame:
    """Rules whose numbers are in range and whose polarity is 1 or -1."""
    return rules.where(F.col("a").between(0, n_types - 1) & F.col("b").between(0, n_types - 1) & F.col("r").between(0, n_relations - 1) & F.col("polarity").isin(1, -1))


def path_vectors(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, dst, place, entity, vec) for the steps of found paths, missing vectors null: the lookups a path encoder is fed with."""
    steps = paths.select("src", "dst", "path", F.posexplode(F.split("path", r"\|")).alias("place", "step"))
    return steps.withColumn("entity", F.split_part("step", F.lit(">"), F.lit(2))).join(vectors, "entity", "left").select("src", "dst", "path", "place", "entity", "vec")


def report(results: DataFrame, most: int = 3) -> list[dict[str, Any]]:
    """The first results and the means of their metrics, for printing."""
    means = results.select(*[F.avg(c).alias(c) for c, kind in results.dtypes if kind == "double"]).first()
    return [*(r.asDict() for r in results.limit(most).collect()), {"means": means.asDict() if means else {}}]


def guarded(convert: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A converter for ``DataFrame.transform`` that is checked to give texts."""

    def run(rows: DataFrame) -> DataFrame:
        out = convert(rows)
        if "text" not in out.columns:
            raise ValueError("a converter must give a text column")
        return out

    return run


decision = M.decision
