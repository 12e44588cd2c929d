"""Structure from predictions: entities from token probabilities, concepts, relations, pseudo-labels, and encoding for batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_classes(probs: DataFrame, *place: str, klass: str = "class", p: str = "p") -> DataFrame:
    """(place, type, conf): the most probable class of each place, the least of equals."""
    best = probs.groupBy(*place).agg(F.max(F.struct(F.col(p).alias("p"), (-F.col(klass)).alias("c"))).alias("b"))
    return best.select(*place, (-F.col("b.c")).alias("type"), F.col("b.p").alias("conf"))


def entities(tokens: DataFrame, sample: str, position: str, threshold: float = 0.5, least: int = 1, most: int = 10) -> DataFrame:
    """(sample, start, end, type, conf) from the best class of each token: runs of one type above 0 that are sure enough, cut at ``most`` tokens; end inclusive."""
    good = tokens.where((F.col("type") > 0) & (F.col("conf") >= threshold))
    order = Window.partitionBy(sample, "type").orderBy(position)
    runs = good.withColumn("_run", F.col(position) - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy(sample, "type", "_run").orderBy(position)) - 1
    parts = runs.withColumn("_part", F.floor(place / max(most, 2)))
    found = parts.groupBy(sample, "type", "_run", "_part").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.avg("conf").alias("conf"))
    return found.where(F.col("end") - F.col("start") + 1 >= least).select(sample, "start", "end", "type", "conf")


def entity_texts(found: DataFrame, tokens: DataFrame, sample: str) -> DataFrame:
    """Entities (sample, start, end, ...) with their text and characters, from tokens (sample, tokens) joined by blanks; end exclusive.

    Characters are counted from the lengths of the tokens before, as a decoder without offsets does.
    """
    rows = found.join(tokens, sample)
    size = lambda t: F.aggregate(F.transform(t, lambda w: F.length(w) + 1), F.lit(0), lambda a, b: a + b)
    text = F.array_join(F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start") + 1), " ")
    rows = rows.withColumn("text", text).withColumn("char_start", F.when(F.col("start") > 0, size(F.slice("tokens", F.lit(1), F.col("start")))).otherwise(0))
    return rows.withColumn("char_end", F.col("char_start") + F.length("text")).drop("tokens")


def extract(tokens: DataFrame, token_probs: DataFrame, concept_probs: DataFrame, relation_probs: DataFrame, sample: str, threshold: float = 0.5, relation_threshold: float = 0.3, most: int = 10) -> DataFrame:
    """One row a sample: (sample, entities, concepts, relations) from token, concept and pair probabilities.

    Entities are numbered by place; relations are kept between the numbers of entities that are there.
    Concepts (sample, concept, p) are those of the whole text, which each entity gets.
    """
    found = entities(best_classes(token_probs, sample, "position"), sample, "position", threshold, 1, most)
    named = entity_texts(found, tokens, sample)
    order = Window.partitionBy(sample).orderBy("start", "type")
    numbered = named.withColumn("n", F.row_number().over(order) - 1)
    ents = numbered.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("n", "text", "type", "conf"))).alias("entities"))
    tops = top_concepts(concept_probs, sample, "concept", "p").groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "concept"))), lambda c: c["concept"]).alias("concepts"))
    pairs = relations(relation_probs, sample, relation_threshold)
    for side in ("i", "j"):
        pairs = pairs.join(numbered.select(sample, F.col("n").alias(side)), [sample, side], "left_semi")
    rels = pairs.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("i", "j", "type", "conf"))).alias("relations"))
    return tokens.select(sample).join(ents, sample, "left").join(tops, sample, "left").join(rels, sample, "left").select(sample, *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("entities", ents.schema["entities"].dataType), ("concepts", tops.schema["concepts"].dataType), ("relations", rels.schema["relations"].dataType))])


def padded(rows: DataFrame, batch: str, *columns: str, fill: int = 0) -> DataFrame:
    """Lists filled to the longest of their batch, and ``attention``: 1 where the first list has something."""
    own = Window.partitionBy(batch)
    for c in columns:
        rows = rows.withColumn("_m", F.max(F.size(c)).over(own))
        if c == columns[0]:
            rows = rows.withColumn("attention", F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), F.col("_m") - F.size(c))))
        rows = rows.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(fill).cast(rows.schema[c].dataType.elementType), F.col("_m") - F.size(c))))
    return rows.drop("_m")


def top_concepts(probs: DataFrame, sample: str, concept: str, p: str, k: int = 3, threshold: float = 0.1) -> DataFrame:
    """The ``k`` most probable concepts at or above a threshold; the best one if none is."""
    place = F.row_number().over(Window.partitionBy(sample).orderBy(F.col(p).desc(), concept))
    return probs.withColumn("place", place).where((F.col("place") <= k) & ((F.col(p) >= threshold) | (F.col("place") == 1)))


def relations(logits: DataFrame, sample: str, threshold: float = 0.3) -> DataFrame:
    """(sample, i, j, type, conf) from (sample, i, j, relation, p): pairs i < j whose best relation is above 0 and sure enough."""
    best = best_classes(logits.where("i < j"), sample, "i", "j", klass="relation")
    return best.where((F.col("type") > 0) & (F.col("conf") >= threshold))


def pseudo_labels(ents: DataFrame, rels: DataFrame, sample: str, threshold: float, least: int = 1, min_confidence: float = 0.6) -> DataFrame:
    """One row a sample: its sure entities and the relations between them renumbered, mean confidence, and whether it is taken.

    ents has (sample, n, type, conf), n from 0; rels has (sample, i, j, type, conf) by n.
    """
    sure = ents.where(F.col("conf") >= threshold)
    numbered = sure.withColumn("k", F.row_number().over(Window.partitionBy(sample).orderBy("n")) - 1)
    head, tail = (numbered.select(sample, F.col("n").alias(a), F.col("k").alias(b)) for a, b in (("i", "head"), ("j", "tail")))
    kept = rels.join(head, [sample, "i"]).join(tail, [sample, "j"]).groupBy(sample).agg(F.count(F.lit(1)).alias("n_relations"))
    out = numbered.groupBy(sample).agg(F.count(F.lit(1)).alias("n_entities"), F.avg("conf").alias("confidence")).where(F.col("n_entities") >= least)
    return out.join(kept, sample, "left").select(sample, "n_entities", F.coalesce("n_relations", F.lit(0)).alias("n_relations"), "confidence", (F.col("confidence") >= min_confidence).alias("taken"))


def token_offsets(text: Column | str) -> Column:
    """array<struct<start, end>> of the words of a text, in characters, end exclusive; words are separated by single blanks."""
    parts = F.split(text, " ")
    sizes = F.aggregate(parts, F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("all"), F.lit(0).alias("at")), lambda s, w: F.struct(F.concat(s["all"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(w)).alias("end")))).cast("array<struct<start:int,end:int>>").alias("all"), (s["at"] + F.length(w) + 1).alias("at")), lambda s: s["all"])
    return sizes


def token_span(offsets: Column | str, start: Column, end: Column) -> Column:
    """Inclusive token span of a character span: from the first token that ends after its start to the last that begins before its end."""
    o = F.col(offsets) if isinstance(offsets, str) else offsets
    n = F.size(o)
    first = F.size(F.filter(o, lambda t: t["end"] <= start))
    last = F.size(F.filter(o, lambda t: t["start"] < end)) - 1
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, n - 1))
    return F.struct(clamp(first).alias("first"), F.greatest(clamp(first), clamp(last)).alias("last"))


def multi_hot(concepts: DataFrame, vocabulary: DataFrame, sample: str, types: DataFrame | None = None) -> DataFrame:
    """(sample, entity, hot, type) from (sample, entity, position, concept): sorted places of its concepts, from 0, and the type of the last one that has one."""
    rows = concepts.join(vocabulary.select(F.col("name").alias("concept"), F.col("id")), "concept")
    hot = rows.groupBy(sample, "entity").agg(F.array_sort(F.collect_set(F.col("id") - 1)).alias("hot"))
    if types is None:
        return hot
    last = concepts.join(types.select("concept", F.col("id").alias("t")), "concept").groupBy(sample, "entity").agg(F.max_by("t", "position").alias("type"))
    return hot.join(last, [sample, "entity"], "left")


def indexed_relations(rels: DataFrame, sample: str, entities_column: str, vocabulary: DataFrame) -> DataFrame:
    """(sample, head, tail, rel) by number from (sample, entities, head, tail, rel), heads and tails as places or names; what isn't known or in range goes.

    The vocabulary, a model's few relations, is broadcast: a shuffle by relation would bring all rows to as many tasks.
    """
    place = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), (F.array_position(entities_column, F.col(c)) - 1).cast("int"))
    rows = rels.withColumn("_h", place("head")).withColumn("_t", place("tail")).join(F.broadcast(vocabulary.select(F.col("name").alias("rel"), (F.col("id") - 1).alias("_r"))), "rel")
    n = F.size(entities_column)
    return rows.where((F.col("_h") >= 0) & (F.col("_h") < n) & (F.col("_t") >= 0) & (F.col("_t") < n)).select(sample, F.col("_h").alias("head"), F.col("_t").alias("tail"), F.col("_r").alias("rel"))


def token_labels(spans: DataFrame, sample: str, size: int, n_types: int) -> DataFrame:
    """(sample, position, type) for tokens in spans (sample, n, first, last, type): a later span overwrites."""
    each = spans.select(sample, "n", F.least(F.col("type"), F.lit(n_types - 1)).alias("type"), F.explode(F.sequence("first", "last")).alias("position")).where(F.col("position") < size)
    return each.groupBy(sample, "position").agg(F.max_by("type", "n").alias("type"))
