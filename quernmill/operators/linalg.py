"""Linear algebra of model heads over tables of weights and activations, and losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernmill.functions.text import let
from quernmill.operators.metrics import softmax
from quernmill.operators.rules import cosine, dot


def linear(vectors: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, out, value): each vector against each row (out, w, b) of a small weight table."""
    return vectors.crossJoin(weights).select(key, "out", (dot("vec", "w") + F.col("b")).alias("value"))


def soft_assign(vectors: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """(key, concept, weight): softmax over cosines with the vectors (concept, c) of a bank."""
    rows = vectors.crossJoin(bank).select(key, "concept", F.exp(cosine("vec", "c")).alias("e"))
    return rows.withColumn("weight", F.col("e") / F.sum("e").over(Window.partitionBy(key))).drop("e")


def attention_pool(tokens: DataFrame, queries: DataFrame, sample: str, dim: int) -> DataFrame:
    """(sample, query, pooled): tokens (sample, position, vec, mask) weighted by scaled softmax attention of queries (query, q); masked ones get -10000."""
    rows = tokens.crossJoin(queries).withColumn("s", F.when(F.col("mask"), dot("vec", "q") / dim**0.5).otherwise(-1e4))
    top = F.max("s").over(Window.partitionBy(sample, "query"))
    rows = rows.withColumn("e", F.exp(F.col("s") - top))
    rows = rows.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy(sample, "query")))
    each = rows.select(sample, "query", "w", F.posexplode("vec").alias("d", "x"))
    by = each.groupBy(sample, "query", "d").agg(F.sum(F.col("w") * F.col("x")).alias("v"))
    return by.groupBy(sample, "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda t: t["v"]).alias("pooled"))


def span_mean(tokens: DataFrame, spans: DataFrame, sample: str) -> DataFrame:
    """(sample, value): mean of the means of spans (sample, first, last) over tokens (sample, position, value); without spans, of all tokens."""
    inside = tokens.join(spans.withColumn("_s", F.xxhash64("first", "last")), sample).where(F.col("position").between(F.col("first"), F.col("last")))
    by = inside.groupBy(sample, "_s").agg(F.avg("value").alias("v")).groupBy(sample).agg(F.avg("v").alias("v"))
    every = tokens.groupBy(sample).agg(F.avg("value").alias("a"))
    return every.join(by, sample, "left").select(sample, F.coalesce("v", "a").alias("value"))


def top_nodes(logits: DataFrame, sample: str, k: int) -> DataFrame:
    """(sample, position, score, place): the ``k`` positions with the greatest logit of any class."""
    best = logits.groupBy(sample, "position").agg(F.max("p").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(sample).orderBy(F.col("score").desc(), "position"))).where(F.col("place") <= k)


def node_types(logits: DataFrame, nodes: DataFrame, sample: str, most: int) -> DataFrame:
    """(sample, node, class, p): softmax over the logits (sample, position, class, x) of the chosen positions (sample, position, place), place from 1.

    A sample with fewer nodes than ``most`` is filled with nodes of equal probabilities, as those of zero logits.
    """
    classes = logits.select("class").distinct()
    own = logits.join(nodes.select(sample, "position", (F.col("place") - 1).cast("int").alias("node")), [sample, "position"]).select(sample, "node", "class", "x")
    grid = logits.select(sample).distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).crossJoin(F.broadcast(classes))
    rows = grid.join(own, [sample, "node", "class"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    node = Window.partitionBy(sample, "node")
    rows = rows.withColumn("e", F.exp(F.col("x") - F.max("x").over(node)))
    return rows.select(sample, "node", "class", (F.col("e") / F.sum("e").over(node)).alias("p"))


def clamped(x: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def dense(x: Column, layer: tuple[list[list[float]], list[float]]) -> Column:
    """A linear layer (weights by output, bias) of a vector column; weights are literals, a model's few."""
    return F.array(*[dot(x, F.array(*[F.lit(float(v)) for v in w])) + F.lit(float(b)) for w, b in zip(*layer, strict=True)])


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def scored(x: Column, layers: list) -> Column:
    """A scorer: linear layers with ReLU between them."""

    def act(layer, last: bool) -> Callable[[Column], Column]:
        return lambda v: dense(v, layer) if last else relu(dense(v, layer))

    for i, layer in enumerate(layers):
        x = let(x, act(layer, i == len(layers) - 1))
    return x


def pair_scores(nodes: DataFrame, sample: str, layers: list, feature_limit: float = 100.0, limit: float = 50.0) -> DataFrame:
    """(sample, i, j, scores) for i < j of nodes (sample, position, vec): a scorer over both vectors, features and scores clamped."""
    a = nodes.select(sample, F.col("position").alias("i"), F.col("vec").alias("u"))
    b = nodes.select(sample, F.col("position").alias("j"), F.col("vec").alias("v"))
    both = a.join(b, sample).where("i < j").select(sample, "i", "j", F.transform(F.concat("u", "v"), lambda x: clamped(x, feature_limit)).alias("f"))
    return both.select(sample, "i", "j", F.transform(scored(F.col("f"), layers), lambda x: clamped(x, limit)).alias("scores"))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """A vector brought to mean 0 and variance 1."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    centred = let(x, lambda v: let(total(v) / F.size(v), lambda m: F.transform(v, lambda y: y - m)))
    return let(centred, lambda v: let(F.sqrt(total(F.transform(v, lambda z: z * z)) / F.size(v) + eps), lambda d: F.transform(v, lambda y: y / d)))


def vector_sum(vec: str, key: list[str], rows: DataFrame, name: str) -> DataFrame:
    """(key, name): the sum of the vectors of each key, by place."""
    by = rows.select(*key, F.posexplode(vec).alias("_d", "_x")).groupBy(*key, "_d").agg(F.sum("_x").alias("_x"))
    return by.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda t: t["_x"]).alias(name))


def message_round(nodes: DataFrame, edges: DataFrame, sample: str, layers: list, how: str = "mean", limit: float | None = None, size: int | None = None) -> DataFrame:
    """One round of a graph network: (sample, node, vec) after the messages of its pairs.

    A message is a perceptron over the vectors of a node and a neighbour and, if edges (sample, src, dst,
    relation) have one, a relation's vector.  The messages that a node gets over its edges, all others
    being masked, are averaged over all nodes of the sample (``size``, or as many as there are), or
    summed; the node's own vector is added, the sum is normalised, and clamped if a limit is given.
    """
    a = nodes.select(sample, F.col("node").alias("src"), F.col("vec").alias("u"))
    b = nodes.select(sample, F.col("node").alias("dst"), F.col("vec").alias("v"))
    parts = ["u", "v", "relation"] if "relation" in edges.columns else ["u", "v"]
    sent = edges.join(a, [sample, "src"]).join(b, [sample, "dst"]).select(sample, "src", scored(F.concat(*parts), layers).alias("m"))
    got = vector_sum("m", [sample, "src"], sent, "msg").withColumnRenamed("src", "node")
    rows = nodes.join(got, [sample, "node"], "left")
    if how == "mean":
        n = F.lit(size) if size is not None else F.count(F.lit(1)).over(Window.partitionBy(sample))
        rows = rows.withColumn("_n", n.cast("double")).withColumn("msg", F.transform("msg", lambda x: x / F.col("_n")))
    added = F.when(F.col("msg").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "msg", lambda x, y: x + y))
    out = rows.select(sample, "node", layer_norm(added).alias("vec"))
    return out.withColumn("vec", F.transform("vec", lambda x: clamped(x, limit))) if limit is not None else out


def message_passing(nodes: DataFrame, edges: DataFrame, sample: str, rounds: list, how: str = "mean", size: int | None = None) -> DataFrame:
    """All rounds of a graph network; that of means is clamped to 100 at its end."""
    for layers in rounds:
        nodes = message_round(nodes, edges, sample, layers, how, None, size)
    return nodes.withColumn("vec", F.transform("vec", lambda x: clamped(x, 100.0))) if how == "mean" else nodes


def pair_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair i < j in the upper triangle of n nodes, row by row."""
    return i * n - (i * (i + 1)) / 2 + (j - i - 1)


def symmetric(pairs: DataFrame, *rest: str) -> DataFrame:
    """Pairs (i, j) both ways round."""
    return pairs.select("i", "j", *rest).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def cross_entropy(p: Column | str) -> Column:
    return -F.ln(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(1e-12)))


#: A label that no loss counts.
IGNORED = -100


def mean_cross_entropy(probs: DataFrame, labels: DataFrame, *key: str) -> DataFrame:
    """One row (loss, n): mean cross-entropy of probabilities (key, class, p) at labels (key, label); ignored labels don't count, and without any the loss is null."""
    own = labels.where(F.col("label") != IGNORED).join(probs, list(key)).where(F.col("class") == F.col("label"))
    return own.agg(F.avg(cross_entropy("p")).alias("loss"), F.count(F.lit(1)).alias("n"))


def total_loss(losses: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """(part, loss) of each part (a row with loss) that has a loss, weighted (1 without a weight), and their sum as ``total``."""
    out = None
    for name, row in losses.items():
        one = row.where("loss is not null").select(F.lit(name).alias("part"), (F.col("loss") * weights.get(name, 1.0)).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(out.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss")).select(F.lit("total").alias("part"), "loss"))


def bce_with_logits(x: Column, positive: Column) -> Column:
    """Binary cross-entropy of a logit in its stable form."""
    return F.greatest(x, F.lit(0.0)) - x * positive.cast("double") + F.log1p(F.exp(-F.abs(x)))


def soft_logic_loss(rules: DataFrame, types: DataFrame, logits: DataFrame, sample: str) -> DataFrame:
    """(rule_id, loss): weighted mean logit of a rule's relation over node pairs, weighted by both type probabilities, against its polarity.

    rules (rule_id, a, b, r, weight, polarity), types (sample, position, class, p), logits (sample, i, j, relation, x).
    """
    pa = types.select(sample, F.col("position").alias("i"), F.col("class").alias("a"), F.col("p").alias("pa"))
    pb = types.select(sample, F.col("position").alias("j"), F.col("class").alias("b"), F.col("p").alias("pb"))
    rows = logits.join(rules, F.col("relation") == F.col("r")).join(pa, [sample, "i", "a"]).join(pb, [sample, "j", "b"])
    w = F.col("pa") * F.col("pb")
    by = rows.groupBy("rule_id", "weight", "polarity", sample).agg((F.sum(w * F.col("x")) / F.greatest(F.sum(w), F.lit(1e-6))).alias("x"))
    return by.groupBy("rule_id").agg((F.avg(bce_with_logits(F.col("x"), F.col("polarity") > 0) * F.col("weight"))).alias("loss"))


def ewc_penalty(parameters: DataFrame, strength: float) -> DataFrame:
    """One row: strength times the Fisher-weighted squared distance of (fisher, now, best)."""
    return parameters.agg((strength * F.sum(F.col("fisher") * (F.col("now") - F.col("best")) ** 2)).alias("penalty"))


def path_importance(log: DataFrame, damping: float = 0.1) -> DataFrame:
    """(parameter, omega) from a log (parameter, gradient, delta): the running gain over the squared way made."""
    by = log.groupBy("parameter").agg(F.sum(-F.col("gradient") * F.col("delta")).alias("run"), F.sum("delta").alias("way"))
    return by.select("parameter", (F.col("run") / (F.col("way") ** 2 + damping)).alias("omega"))


def path_penalty(parameters: DataFrame, strength: float) -> DataFrame:
    """One row: strength times the importance-weighted squared distance of (omega, now, best)."""
    return parameters.agg((strength * F.sum(F.col("omega") * (F.col("now") - F.col("best")) ** 2)).alias("penalty"))


def distillation(rows: DataFrame, teacher: str, student: str, teacher_concepts: str, student_concepts: str, temperature: float = 2.0, alpha: float = 0.5) -> DataFrame:
    """One row: alpha times the sum of T squared times the mean divergence of logits at a temperature, and the mean squared difference of concept probabilities."""
    soft = rows.select(softmax(F.transform(teacher, lambda x: x / temperature)).alias("p"), softmax(F.transform(student, lambda x: x / temperature)).alias("q"), F.col(teacher_concepts).alias("c"), F.col(student_concepts).alias("d"))
    kl = F.aggregate(F.zip_with("p", "q", lambda p, q: F.when(p > 0, p * (F.ln(p) - F.ln(q))).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    square = F.aggregate(F.zip_with("c", "d", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    each = soft.select(kl.alias("kl"), square.alias("s"), F.size("c").alias("n"))
    return each.agg((alpha * (F.avg("kl") * temperature**2 + F.sum("s") / F.sum("n"))).alias("penalty"))


def combined_penalty(**parts: DataFrame | None) -> DataFrame:
    """One row: the sum of the penalties there are (rows with penalty); parts that are None or null count as 0."""
    rows = [p.select(F.coalesce("penalty", F.lit(0.0)).alias("penalty")) for p in parts.values() if p is not None]
    if not rows:
        raise ValueError("no penalty")
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.agg(F.sum("penalty").alias("penalty"))
