"""Layered content safety: keywords, likeness to harmful examples, ethical constraints, verdicts and audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.functions.text import any_of, contains_any, preview
from quernmill.operators.blocks import against, greatest

#: Similarity from which an example counts as harmful, and whether all layers are always asked.
STRICTNESS = {"low": (0.85, False), "medium": (0.70, False), "high": (0.60, True), "maximum": (0.50, True)}
SEVERITY = ["illegal", "violence", "hate_speech", "harassment", "self_harm", "misinformation", "manipulation", "privacy_violation", "bias"]
TITLES = ["prof", "dr", "ms", "mrs", "mr"]
INSULTS = ["worst", "terrible", "hate", "fool", "idiot", "stupid"]
GROUPS = ["they never", "they always", "those people", "every", "all"]
SLURS = ["inferior", "dangerous", "criminal", "lazy", "stupid"]
DECEPTIVE = r"(?:experts|scientists|doctors)\s+(?:are hiding|hate|don't want)|(?:hidden|secret)\s+(?:knowledge|cure|truth)|(?:proven|guaranteed|100%)\s+(?:fix|solution|cure)"
NUMBERS = r"\b\d{3}[.-]?\d{2,3}[.-]?\d{4}\b|\b\d{16}\b"
ADDRESSES = r"\b[\w.%+-]+@[\d.a-zA-Z-]+\.[a-zA-Z]{2,}\b"
PRIVATE = f"{NUMBERS}|{ADDRESSES}"


@dataclass
class Keywords:
    """Terms that pass or fail a text, and patterns by category in the order they are tried."""

    allow: list[str] = field(default_factory=list)
    block: list[str] = field(default_factory=list)
    patterns: dict[str, list[str]] = field(default_factory=dict)

    def judged(self, rows: DataFrame, text: str, low: str) -> DataFrame:
        """Adds ``_k_category`` and ``_k_rules``; an allowed term passes at once, blocked terms are all named, else the first pattern that matches counts.

        The columns are flat and each is computed once, however often a later step refers to it.
        """
        none = F.array().cast("array<string>")
        terms = F.filter(F.array(*[F.lit(t.lower()) for t in self.block]).cast("array<string>"), lambda t: F.contains(F.col(low), t))
        rows = rows.withColumn("_k_terms", terms if self.block else none)
        found = F.when(contains_any(low, [t.lower() for t in self.allow]), "safe") if self.allow else F.when(F.lit(False), "safe")
        found = found.when(F.size("_k_terms") > 0, "unknown")
        for category, patterns in self.patterns.items():
            if patterns:
                found = found.when(any_of([F.col(text).rlike(f"(?iu){p}") for p in patterns]), category)
        rows = rows.withColumn("_k_category", found.otherwise("safe"))
        named = F.when(F.col("_k_category") == "safe", none).when((F.col("_k_category") == "unknown") & (F.size("_k_terms") > 0), F.transform("_k_terms", lambda t: F.concat(F.lit("blocklist:"), t)))
        return rows.withColumn("_k_rules", named.otherwise(F.array(F.concat(F.lit("pattern:"), "_k_category")))).drop("_k_terms")

    def check(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``safe``, ``category`` and ``rules``."""
        out = self.judged(rows.withColumn("_low", F.lower(text)), text, "_low")
        return out.withColumn("safe", F.col("_k_category") == "safe").withColumnsRenamed({"_k_category": "category", "_k_rules": "rules"}).drop("_low")


def names_a_person(low: Column) -> Column:
    """Whether an entity in lower case holds a title."""
    return contains_any(low, TITLES)


def insulted(low: str, name: Column) -> Column:
    """Whether an insult stands within 50 characters of an entity's first mention; both in lower case."""
    at = F.instr(F.col(low), name)
    begin = F.greatest(at - 50, F.lit(1))
    near = F.substring(F.col(low), begin, at - begin + F.length(name) + 50)
    return (at > 0) & near.rlike("|".join(INSULTS))


def with_insults(low: Column | str) -> Column:
    """Whether there is an insult anywhere: without one nothing stands near any, and no mention need be looked for."""
    return contains_any(low, INSULTS)


def attacks_person(low: str, entities: str) -> Column:
    return F.exists(F.coalesce(F.col(entities), F.array().cast("array<string>")), lambda e: names_a_person(e) & insulted(low, e))


def denigrates_group(low: str) -> Column:
    return contains_any(low, GROUPS) & contains_any(low, SLURS)


def deceives(low: str) -> Column:
    return F.col(low).rlike(DECEPTIVE)


def exposes(text: str) -> Column:
    # the pattern of addresses starts anew at every word; few texts have what all of them hold
    return F.col(text).rlike(NUMBERS) | (F.contains(F.col(text), F.lit("@")) & F.col(text).rlike(ADDRESSES))


@dataclass
class Constraint:
    """A named rule and what breaks it, from the columns of the text, the text in lower case, and the entities in lower case."""

    name: str
    category: str
    broken: Callable[[str, str, str], Column]


CONSTRAINTS = [
    Constraint("no_personal_attacks", "harassment", lambda text, low, entities: attacks_person(low, entities)),
    Constraint("no_group_denigration", "hate_speech", lambda text, low, entities: denigrates_group(low)),
    Constraint("no_deceptive_claims", "misinformation", lambda text, low, entities: deceives(low)),
    Constraint("respect_privacy", "privacy_violation", lambda text, low, entities: exposes(text)),
]


def lowered(rows: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Adds ``_low`` and ``_names``, text and entities in lower case."""
    return rows.withColumn("_low", F.lower(text)).withColumn("_names", F.transform(entities, lambda e: F.lower(e)))


def broken(rows: DataFrame, constraints: list[Constraint] = CONSTRAINTS, text: str = "text", ask: Column | None = None) -> DataFrame:
    """Adds ``_e_rules``, the names of what lowered rows break, and ``_e_category``, that of the gravest; nothing is broken where ``ask`` is false."""
    ask = F.lit(True) if ask is None else ask
    # the names of the broken ones, joined, are one flat column, so that nothing is evaluated twice
    rows = rows.withColumn("_e_names", F.concat(*[F.when(ask & c.broken(text, "_low", "_names"), f"{i},").otherwise("") for i, c in enumerate(constraints)]))
    rows = rows.withColumn("_e_places", F.filter(F.split("_e_names", ","), lambda x: x != ""))
    name = F.array(*[F.lit(c.name) for c in constraints])
    grade = F.array(*[F.struct(F.lit(SEVERITY.index(c.category) if c.category in SEVERITY else 99).alias("r"), F.lit(c.category).alias("c")) for c in constraints])
    gravest = F.array_min(F.transform("_e_places", lambda i: F.get(grade, i.cast("int"))))["c"]
    rows = rows.withColumn("_e_rules", F.transform("_e_places", lambda i: F.get(name, i.cast("int")))).withColumn("_e_category", F.coalesce(gravest, F.lit("safe")))
    return rows.drop("_e_names", "_e_places")


def ethical(rows: DataFrame, constraints: list[Constraint] = CONSTRAINTS, text: str = "text", entities: str = "entities") -> DataFrame:
    """Adds ``safe``, ``category`` and ``rules``: all constraints that are broken, and the gravest one's category."""
    out = broken(lowered(rows, text, entities), constraints, text)
    return out.withColumn("safe", F.size("_e_rules") == 0).withColumnsRenamed({"_e_category": "category", "_e_rules": "rules"}).drop("_low", "_names")


HARMFUL = "example bigint, category string, vec array<double>"


def add_harmful(spark: SparkSession, folder: str, examples: DataFrame) -> DataFrame:
    """Appends harmful examples (example, category, vec) to those kept in a folder, and returns all."""
    examples.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in HARMFUL.split(", ")]).write.mode("append").parquet(folder)
    return spark.read.schema(HARMFUL).parquet(folder)


def closest(vectors: DataFrame, harmful: DataFrame, key: str) -> DataFrame:
    """(key, similarity, nearest) of the nearest harmful vector (vec, category, example) to each vec; 0 and safe if none is positive."""
    found = against(vectors, harmful, key, "vec", "example", "vec", greatest(1, other_only=False))
    named = found.join(harmful.select(F.col("example").alias("other"), "category"), "other")
    best = named.groupBy(key).agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.col("other")).alias("e"), F.col("category").alias("c"))).alias("m"))
    rows = vectors.select(key).join(best, key, "left")
    return rows.select(key, F.greatest(F.coalesce("m.s", F.lit(0.0)), F.lit(0.0)).alias("similarity"), F.when(F.col("m.s") > 0, F.col("m.c")).otherwise("safe").alias("nearest"))


def regulate(docs: DataFrame, keywords: Keywords | None = None, strictness: str = "medium", text: str = "text", entities: str = "entities", constraints: list[Constraint] = CONSTRAINTS) -> DataFrame:
    """Adds ``verdict``: struct(is_safe, category, confidence, reasons, triggered_rules).

    Keywords, then similarity (columns similarity and nearest, if there), then constraints; a later
    layer is asked only while the text is safe, or always if strictness is high.  The last layer that
    fails gives the category.  Each layer is a flat column, which the optimizer doesn't copy into all
    that refer to it.
    """
    limit, always = STRICTNESS.get(strictness, STRICTNESS["medium"])
    own = "similarity" in docs.columns
    rows = (keywords or Keywords()).judged(lowered(docs, text, entities), text, "_low")
    passed = F.col("_k_category") == "safe"
    alike = (F.col("similarity") >= limit) & (F.lit(always) | passed) if own else F.lit(False)
    rows = rows.withColumn("_s", F.coalesce(alike, F.lit(False)))
    rows = broken(rows, constraints, text, None if always else passed & ~F.col("_s"))
    similarity, nearest = (F.col("similarity"), F.col("nearest")) if own else (F.lit(None).cast("double"), F.lit(None).cast("string"))
    kept = F.size("_e_rules") == 0
    none = F.array().cast("array<string>")
    fine = passed & ~F.col("_s") & kept
    verdict = F.struct(
        fine.alias("is_safe"),
        F.when(~kept, F.col("_e_category")).when(F.col("_s"), nearest).otherwise(F.col("_k_category")).alias("category"),
        F.when(fine, 1.0).otherwise(F.greatest(F.when(~passed, 0.9), F.when(F.col("_s"), similarity), F.when(~kept, 0.8))).alias("confidence"),
        F.array_compact(F.array(F.when(~passed, "Failed keyword filter"), F.when(F.col("_s"), "Similar to known harmful content"), F.when(~kept, F.concat(F.lit("Violated ethical constraints: "), F.array_join("_e_rules", ", "))))).alias("reasons"),
        F.concat("_k_rules", F.when(F.col("_s"), F.array(F.lit("semantic_similarity"))).otherwise(none), F.transform("_e_rules", lambda r: F.concat(F.lit("ethical:"), r))).alias("triggered_rules"),
    )
    return rows.withColumn("verdict", verdict).drop("_low", "_names", "_k_category", "_k_rules", "_s", "_e_rules", "_e_category")


def split_safe(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Safe and unsafe rows of regulated ones."""
    return docs.where("verdict.is_safe"), docs.where("not verdict.is_safe")


def audit(docs: DataFrame, source: str, text: str = "text") -> DataFrame:
    """Audit rows of regulated ones: when, which text (by hash and preview), verdict and source."""
    rest = [c for c in docs.columns if c not in (text, "verdict")]
    return docs.select(*rest, F.current_timestamp().alias("timestamp"), F.left(F.sha2(F.col(text).cast("binary"), 256), F.lit(16)).alias("text_hash"), preview(text).alias("text_preview"), "verdict", F.lit(source).alias("source"))


def write_audit(audited: DataFrame, path: str) -> None:
    """Appends the unsafe rows."""
    audited.where("not verdict.is_safe").write.mode("append").json(path)


def audit_statistics(audited: DataFrame) -> DataFrame:
    """One row a category, with the totals beside it."""
    total = audited.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict.is_safe")).alias("safe"))
    return audited.groupBy(F.col("verdict.category").alias("category")).agg(F.count(F.lit(1)).alias("n")).crossJoin(total).withColumn("safe_rate", F.col("safe") / F.col("total"))
