"""Evaluation metrics, uncertainty and run logs."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernmill.functions.text import mentioned
from quernmill.operators.conversion import responds

EPS = 1e-10


def ngrams(tokens: Column | str, n: int) -> Column:
    """The n-grams of a list of tokens, joined by a control character; none if it is shorter."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\x01"))).otherwise(F.array().cast("array<string>"))


def _bleu(reference: str, hypothesis: str, max_n: int) -> float:
    """The brevity penalty times the geometric mean of clipped n-gram precisions; any that is zero makes it zero."""
    r, h = reference.lower().split(), hypothesis.lower().split()
    if not r or not h:
        return 0.0
    total = 0.0
    for n in range(1, max_n + 1):
        known = Counter(zip(*(r[i:] for i in range(n)), strict=False))
        hits = sum(min(k, known[g]) for g, k in Counter(zip(*(h[i:] for i in range(n)), strict=False)).items() if g in known)
        if not hits:
            return 0.0
        total += math.log(hits / (len(h) - n + 1))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(total / max_n)


def bleu(pairs: DataFrame, reference: str, hypothesis: str, max_n: int = 4) -> DataFrame:
    """Adds ``bleu``; null or empty texts on either side give 0.

    N-grams are counted within the row, in Arrow batches, so that nothing is shuffled.
    """

    @F.pandas_udf("double")
    def score(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([_bleu(r, h, max_n) for r, h in zip(reference, hypothesis, strict=True)], dtype=float)

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.withColumn("bleu", score(text(reference), text(hypothesis)))


def evaluate(samples: DataFrame, *order: str, most: int | None = None, generated: str = "generated") -> DataFrame:
    """Samples that are to be responded to, the first ``most`` in order, with ``bleu`` and ``entity`` (precision, recall, f1) where something was generated.

    Columns: should_respond, response, entities and the text generated; the entities of a generated text
    are those of the sample that it mentions.
    """
    rows = samples.where(responds())
    rows = rows.orderBy(*order).limit(most) if most is not None else rows
    some = F.coalesce(F.col(generated), F.lit("")) != ""
    rows = bleu(rows, "response", generated).withColumn("bleu", F.when(some, F.col("bleu")))
    return rows.withColumn("_p", mentioned(generated, "entities")).withColumn("entity", F.when(some, entity_f1("entities", "_p"))).drop("_p")


METRICS = ("bleu", "precision", "recall", "f1")


def mean_metrics(evaluated: DataFrame, *by: str) -> DataFrame:
    """Rows (by, n, means): how many results, and the mean of each metric over those that have it."""
    entity = lambda c: F.col("bleu") if c == "bleu" else F.col(f"entity.{c}")
    return evaluated.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(entity(c)).alias(f"avg_{c}") for c in METRICS])


def compared(means: DataFrame, side: str = "side", one: str = "train", other: str = "eval", metrics: tuple[str, ...] = ("avg_bleu", "avg_f1")) -> DataFrame:
    """(metric, one, other, difference) of the means of two sides; a mean that is missing counts as 0."""
    long = means.select(side, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select(side, "x.*")
    pick = lambda s: F.coalesce(F.max(F.when(F.col(side) == s, F.col("v"))), F.lit(0.0)).alias(s)
    return long.groupBy("metric").agg(pick(one), pick(other)).withColumn("difference", F.col(other) - F.col(one))


def entity_f1(reference: str, predicted: str) -> Column:
    """struct(precision, recall, f1) of two lists of names as sets in lower case; 1 if both are empty, 0 if one is."""
    as_set = lambda c: F.array_distinct(F.transform(c, lambda e: F.trim(F.lower(e))))
    r, p = as_set(F.col(reference)), as_set(F.col(predicted))
    hits = F.size(F.array_intersect(r, p))
    empty = (F.size(r) == 0) & (F.size(p) == 0)
    one = (F.size(r) == 0) | (F.size(p) == 0)
    score = lambda x: F.when(empty, 1.0).when(one, 0.0).otherwise(x)
    return F.struct(score(F.try_divide(hits, F.size(p))).alias("precision"), score(F.try_divide(hits, F.size(r))).alias("recall"), score(F.try_divide(2.0 * hits, F.size(r) + F.size(p))).alias("f1"))


def early_stop(scores: Column | str, patience: int, min_delta: float = 0.0, lower: bool = True) -> Column:
    """struct(best, waited, stopped_at) of a list of scores in order; the place, from 1, where patience runs out, or null."""
    better = (lambda x, b: x < b - min_delta) if lower else (lambda x, b: x > b + min_delta)
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("int").alias("stopped_at"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("double")
        up = s["best"].isNull() | better(x, s["best"])
        waited = F.when(up, 0).otherwise(s["waited"] + 1)
        new = F.struct(F.when(up, x).otherwise(s["best"]).alias("best"), waited.alias("waited"), F.when(waited >= patience, s["i"] + 1).cast("int").alias("stopped_at"), (s["i"] + 1).alias("i"))
        return F.when(s["stopped_at"].isNotNull(), s).otherwise(new)

    c = F.col(scores) if isinstance(scores, str) else scores
    return F.aggregate(c, zero, step, lambda s: F.struct(s["best"].alias("best"), s["waited"].alias("waited"), s["stopped_at"].alias("stopped_at")))


def kept_checkpoints(log: DataFrame, order: str, score: str, most: int, lower: bool = True, run: str = "run") -> DataFrame:
    """Of a run log the checkpoints that beat all before them, the last ``most`` of each run."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if lower else F.max)(score).over(before)
    saved = log.withColumn("_b", best).where(F.col("_b").isNull() | ((F.col(score) < F.col("_b")) if lower else (F.col(score) > F.col("_b")))).drop("_b")
    return saved.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(F.col(order).desc()))).where(F.col("_n") <= most).drop("_n")


def softmax(logits: Column | str) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def entropy(probs: Column | str) -> Column:
    """Entropy of a list of probabilities."""
    return -F.aggregate(F.transform(probs, lambda p: p * F.ln(p + EPS)), F.lit(0.0), lambda a, b: a + b)


def monte_carlo(passes: DataFrame, sample: str, position: str, klass: str, p: str) -> DataFrame:
    """Uncertainty of each sample from probabilities (sample, pass, position, class, p): variance over passes, entropy of the mean, mean entropy, their difference."""
    cell = passes.groupBy(sample, position, klass).agg(F.avg(p).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"), F.avg(-F.col(p) * F.ln(F.col(p) + EPS)).alias("h"))
    place = cell.groupBy(sample, position).agg(F.avg("v").alias("v"), F.sum(-F.col("m") * F.ln(F.col("m") + EPS)).alias("t"), F.sum("h").alias("a"))
    out = place.groupBy(sample).agg(F.avg("v").alias("variance"), F.avg("t").alias("entropy"), F.avg("a").alias("aleatoric"))
    return out.withColumn("epistemic", F.col("entropy") - F.col("aleatoric"))


def overall(epistemic: Column, entity: Column, concept: Column, relation: Column) -> Column:
    return 0.4 * epistemic + 0.3 * entity + 0.2 * concept + 0.1 * relation


ESTIMATE = ("entropy", "epistemic", "aleatoric", "entity", "concept", "relation", "overall")


def _variances(passes: DataFrame, sample: str, position: str, klass: str, p: str, name: str) -> DataFrame:
    cell = passes.groupBy(sample, position, klass).agg(F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"))
    return cell.groupBy(sample).agg(F.avg("v").alias(name))


def _with_variances(rows: DataFrame, concepts: DataFrame | None, relations: DataFrame | None, sample: str, names: tuple[str, ...]) -> DataFrame:
    for name, passes in (("concept", concepts), ("relation", relations)):
        rows = rows.join(_variances(passes, sample, *names, name), sample, "left") if passes is not None else rows.withColumn(name, F.lit(0.0))
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("concept", "relation")})


def dropout_estimate(entities: DataFrame, concepts: DataFrame | None, relations: DataFrame | None, sample: str, position: str = "position", klass: str = "class", p: str = "p") -> DataFrame:
    """(sample, ESTIMATE) from passes with dropout on."""
    rows = monte_carlo(entities, sample, position, klass, p).withColumnRenamed("variance", "entity")
    rows = _with_variances(rows, concepts, relations, sample, (position, klass, p))
    return rows.withColumn("overall", overall(*[F.col(c) for c in ("epistemic", "entity", "concept", "relation")])).select(sample, *ESTIMATE)


def ensemble_estimate(entities: DataFrame, concepts: DataFrame | None, sample: str, position: str = "position", klass: str = "class", p: str = "p") -> DataFrame:
    """(sample, ESTIMATE) from the passes of several models: their disagreement, from which no aleatoric part can be told."""
    rows = monte_carlo(entities, sample, position, klass, p).withColumnRenamed("variance", "entity").drop("epistemic", "aleatoric")
    rows = _with_variances(rows, concepts, None, sample, (position, klass, p))
    return rows.withColumns({"epistemic": F.col("entity"), "aleatoric": F.lit(0.0), "overall": F.col("entity")}).select(sample, *ESTIMATE)


def estimate(method: str, dropout: dict[str, DataFrame], ensemble: dict[str, DataFrame] | None, sample: str) -> DataFrame:
    """(sample, ESTIMATE) by ``mc_dropout``, ``ensemble`` or ``combined``; without an ensemble, or for any other method, by dropout.

    Passes are given by kind: entities, concepts, relations.  Combined is the mean of both, but for the
    aleatoric part and relations, which are those by dropout.
    """
    one = dropout_estimate(dropout["entities"], dropout.get("concepts"), dropout.get("relations"), sample)
    if not ensemble or method not in ("ensemble", "combined"):
        return one
    other = ensemble_estimate(ensemble["entities"], ensemble.get("concepts"), sample)
    if method == "ensemble":
        return other
    both = one.join(other.select(sample, *[F.col(c).alias(f"_{c}") for c in ESTIMATE]), sample)
    return both.select(sample, *[F.col(c) if c in ("aleatoric", "relation") else ((F.col(c) + F.col(f"_{c}")) / 2).alias(c) for c in ESTIMATE])


def uncertain(score: Column | str, threshold: float = 0.5) -> Column:
    """Whether a score is above the threshold; one that equals it isn't."""
    return (F.col(score) if isinstance(score, str) else score) > threshold


def decision(uncertainty: Column, threshold: float = 0.5, force: bool = False) -> Column:
    """What a learner does with a sample: learn if it is uncertain (or forced), else skip."""
    return F.when(F.lit(force) | uncertain(uncertainty, threshold), "learn").otherwise("skip_confident")
