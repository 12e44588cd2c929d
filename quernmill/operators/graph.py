"""Knowledge graph: edges, linking, neighbours, paths and fact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.session import cut


def edges_both_ways(triples: DataFrame) -> DataFrame:
    """(src, rel, dst) forward, and backward with ``~`` before the relation; parallel edges stay apart."""
    return triples.select("src", "rel", "dst").unionByName(triples.select(F.col("dst").alias("src"), F.concat(F.lit("~"), "rel").alias("rel"), F.col("src").alias("dst")))


def embeddings_of(entities: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Each entity with its vector, or zeros."""
    return entities.join(vectors, "entity", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)))


def _forms(name: Column) -> list[Column]:
    under = F.replace(name, F.lit(" "), F.lit("_"))
    return [F.concat(F.lit("/c/en/"), under), F.concat(F.lit("/c/en/"), F.replace(name, F.lit(" "), F.lit(""))), F.concat(F.lit("/c/en/"), F.lower(name))]


def link(names: DataFrame, mapping: DataFrame, nodes: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(name, node, stage): names linked by a mapping (key, node) of the raw or normal name, by spelling, or fuzzily.

    nodes has (node, place); fuzzy matches are ``/c/en/`` nodes that hold the name or are held by it and
    share over half of the longer one's letters, the first best by place.  They are looked for only for
    names that nothing else links, by a join on three letters that no such pair escapes.
    """
    own = names.select("name").distinct().withColumn("normal", T.normal_name("name"))
    raw = own.join(mapping.select(F.col("key").alias("name"), F.col("node").alias("n1")), "name", "left")
    raw = raw.join(mapping.select(F.col("key").alias("normal"), F.col("node").alias("n2")), "normal", "left")
    for i, form in enumerate(_forms(F.col("normal"))):
        raw = raw.withColumn(f"f{i}", form).join(nodes.select(F.col("node").alias(f"f{i}"), F.col("node").alias(f"m{i}")), f"f{i}", "left")
    exact = raw.select("name", "normal", F.coalesce("n1", "n2", "m0", "m1", "m2").alias("node"), F.when(F.coalesce("n1", "n2").isNotNull(), "mapping").when(F.coalesce("m0", "m1", "m2").isNotNull(), "spelling").alias("stage"))
    found = exact.where("node is not null").select("name", "node", "stage")
    if not fuzzy:
        return found
    rest = exact.where("node is null and normal <> ''").select("name", F.replace("normal", F.lit(" "), F.lit("_")).alias("w"))
    labels = nodes.where(F.startswith("node", F.lit("/c/en/"))).select("node", "place", F.substr("node", F.lit(7)).alias("l")).where("l <> ''")
    # what holds the other has its first three letters somewhere; shorter ones only match up to four letters
    head = lambda c: F.substring(c, 1, 3)
    windows = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n)))
    grams = lambda c: F.array_distinct(F.when(F.length(c) <= 4, F.concat(windows(c, 1), windows(c, 2), windows(c, 3))).otherwise(windows(c, 3)))
    w, l = F.col("w"), F.col("l")
    one = rest.withColumn("key", head(w)).join(labels.withColumn("key", F.explode(grams(l))), "key")
    two = rest.withColumn("key", F.explode(grams(w))).join(labels.withColumn("key", head(l)), "key")
    pairs = one.unionByName(two).select("name", "w", "node", "place", "l").distinct()
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    score = F.size(F.array_intersect(letters(F.col("w")), letters(F.col("l")))) / F.greatest(F.length("w"), F.length("l"))
    held = pairs.where(F.contains("l", F.col("w")) | F.contains("w", F.col("l"))).withColumn("score", score).where("score > 0.5")
    best = held.groupBy("name").agg(F.min_by("node", F.struct(-F.col("score"), F.col("place"))).alias("node"))
    return found.unionByName(best.select("name", "node", F.lit("fuzzy").alias("stage")))


def neighbours(triples: DataFrame, sources: DataFrame | None = None, most: int = 50, order: str = "place") -> DataFrame:
    """The first ``most`` forward edges of each source, in their order."""
    rows = triples if sources is None else triples.join(sources, "src", "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(order, "rel", "dst"))).where(F.col("_n") <= most).drop("_n")


#: Nodes that ``busy`` names at most, rows that a task makes distinct, and edges that are broadcast.
BUSY, ROWS, FEW = 50_000, 500_000, 50_000
#: Edges that a busy node has more of, at least.
LEAST = 64


def _distinct(rows: DataFrame, *key: str) -> DataFrame:
    """Distinct rows, spread by their number before: a few small files can make many, as pairs."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), *key).distinct()


def _meet(grown: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows joined to edges by both ends, (at, back).  Many rows have the same ends, so that the edges that any has are found first; if they are few, no row is moved."""
    some = cut(edges.join(grown.select("at", "back").distinct(), ["at", "back"], "left_semi"))
    return grown.join(F.broadcast(some) if some.count() <= FEW else some, ["at", "back"])


def busy(triples: DataFrame) -> DataFrame:
    """(node, degree) of the nodes with most edges: few enough to be broadcast, whatever the graph's size.

    All others have at most ``LEAST`` edges, or a 50,000th of all there are.
    """
    ends = triples.select(F.explode(F.array("src", "dst")).alias("node"))
    least = max(LEAST, 2 * triples.count() // BUSY)
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > least)


def _forward(rows: DataFrame, hubs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``_forward``: whether the node in column a has no more edges than that in b, as far as they are busy."""
    for c in (a, b):
        rows = rows.join(F.broadcast(hubs.select(F.col("node").alias(c), F.col("degree").alias(f"_d_{c}"))), c, "left")
    da, db = (F.coalesce(f"_d_{c}", F.lit(0)) for c in (a, b))
    return rows.withColumn("_forward", da <= db).drop(f"_d_{a}", f"_d_{b}")


def paths(triples: DataFrame, pairs: DataFrame, max_length: int = 3, max_paths: int | None = 10) -> DataFrame:
    """(src, dst, path): simple paths of at most ``max_length`` steps either way, as texts ``rel>node|...``.

    Paths grow one join a step from that of their two ends that has fewer edges, and the last step joins
    both ends; so each is found once, and a node with many edges is passed only on the way to another.
    The shortest ``max_paths`` of each pair stay, ties in the order of their texts.  A pair of one node
    twice has the path ``self``.
    """
    starts = _distinct(pairs.select("src", "dst"), "src", "dst")
    found = starts.where("src = dst").select("src", "dst", F.concat(F.lit("self>"), "src").alias("path"), F.lit(1).alias("steps"))
    grown = starts.where("src <> dst").select("src", "dst", F.col("src").alias("at"), F.col("dst").alias("back"), F.array("src", "dst").alias("seen"), F.lit("").alias("ahead"), F.lit("").alias("behind"))
    last = edges_both_ways(triples).withColumnsRenamed({"src": "at", "dst": "back"})
    inverse = F.concat(F.lit("~"), "rel")
    # from a node to another, with the relation on the way there and that on the way back
    hop = triples.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("rel").alias("there"), inverse.alias("here"))
    hop = hop.unionByName(triples.select(F.col("dst").alias("node"), F.col("src").alias("to"), inverse.alias("there"), F.col("rel").alias("here")))
    hubs = cut(busy(triples)) if max_length > 1 else None
    after = lambda path: F.concat(path, F.when(F.col(path) != "", "|").otherwise(""))
    for step in range(1, max_length + 1):
        whole = F.concat(after("ahead"), "rel", F.lit(">"), "back", "behind")
        met = _meet(grown, last) if step > 1 else grown.join(last, ["at", "back"])
        found = found.unionByName(met.select("src", "dst", whole.alias("path"), F.lit(step).alias("steps")))
        if step == max_length:
            break
        on = F.col("_forward")
        rows = _forward(grown, hubs, "at", "back").withColumn("node", F.when(on, F.col("at")).otherwise(F.col("back")))
        rows = rows.join(hop, "node").where(~F.array_contains("seen", F.col("to")))
        ahead = F.when(on, F.concat(after("ahead"), "there", F.lit(">"), "to")).otherwise(F.col("ahead"))
        behind = F.when(on, F.col("behind")).otherwise(F.concat(F.lit("|"), "here", F.lit(">"), "back", "behind"))
        grown = rows.select("src", "dst", F.when(on, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(on, F.col("back")).otherwise(F.col("to")).alias("back"), F.concat("seen", F.array("to")).alias("seen"), ahead.alias("ahead"), behind.alias("behind"))
        grown = cut(grown) if step + 1 < max_length else grown
    if max_paths is not None:
        place = F.row_number().over(Window.partitionBy("src", "dst").orderBy("steps", "path"))
        found = found.withColumn("_n", place).where(F.col("_n") <= max_paths).drop("_n")
    return found


def commit(triples: DataFrame, pending: DataFrame) -> DataFrame:
    """The graph with pending relations (src, rel, dst) added; what it has already, or what is pending twice, is there as often."""
    return triples.select("src", "rel", "dst").unionByName(pending.select("src", "rel", "dst"))


def add_relations(spark: SparkSession, folder: str, pending: DataFrame) -> DataFrame:
    """Appends pending relations to the graph kept in a folder, and returns the graph."""
    pending.select("src", "rel", "dst").write.mode("append").parquet(folder)
    return spark.read.schema("src string, rel string, dst string").parquet(folder)


def query_paths(triples: DataFrame | None, pairs: DataFrame, max_length: int = 3, max_paths: int | None = 10) -> DataFrame:
    """Paths of pairs; none without a graph."""
    if triples is None:
        return pairs.limit(0).select("src", "dst", F.lit("").alias("path"), F.lit(0).alias("steps"))
    return paths(triples, pairs, max_length, max_paths)


def verify(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """(src, rel, dst, confidence) of claims: 1.0 if stated, 0.9 if the inverse is, 0.5 if a path of two steps joins them, else 0.0.

    The middle of a path is looked for among the neighbours of that end that has fewer.
    """
    own = _distinct(claims.select("src", "rel", "dst"), "src", "dst")
    known = edges_both_ways(triples).groupBy("src", "dst").agg(F.collect_set("rel").alias("_rels"))
    rows = own.join(known, ["src", "dst"], "left")
    stated, back = F.array_contains("_rels", F.col("rel")), F.array_contains("_rels", F.concat(F.lit("~"), "rel"))
    near = F.col("_rels").isNotNull() | (F.col("src") == F.col("dst"))
    rows = rows.select("src", "rel", "dst", F.when(stated, 1.0).when(back, 0.9).when(near, 0.5).alias("_known"))
    rest = _forward(rows.where("_known is null").select("src", "dst").distinct(), cut(busy(triples)), "src", "dst")
    end = lambda a, b: F.when(F.col("_forward"), F.col(a)).otherwise(F.col(b))
    rest = rest.select("src", "dst", end("src", "dst").alias("_near"), end("dst", "src").alias("_far"))
    # edges go both ways, so that the neighbours of either end are found alike
    middle = rest.join(known.select(F.col("src").alias("_near"), F.col("dst").alias("_mid")), "_near").where("_mid <> src and _mid <> dst")
    joined = middle.join(known.select(F.col("src").alias("_mid"), F.col("dst").alias("_far")), ["_mid", "_far"], "left_semi").select("src", "dst").distinct().withColumn("_path", F.lit(0.5))
    return rows.join(joined, ["src", "dst"], "left").select("src", "rel", "dst", F.coalesce("_known", "_path", F.lit(0.0)).alias("confidence"))
