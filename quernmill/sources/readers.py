"""Sources: samples, instruction sets, knowledge-graph dumps and vectors, read without a driver-side loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernmill.functions.text import first_truthy
from quernmill.operators import conversion as C

RAW_SAMPLE = "text string, entities array<string>, entity_spans array<array<int>>, concepts array<string>, relations array<array<string>>, should_respond int, response string, _metadata map<string,string>"
INSTRUCTION = "instruction string, prompt string, input string, context string, response string, output string, completion string, source string, category string"
MARKUP = "context string, triplets string"
DOCUMENT = "title string, sents array<array<string>>, vertexSet array<array<struct<name:string,type:string,sent_id:int,pos:array<int>>>>, labels array<struct<h:int,t:int,r:string>>"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON lines.  Blank lines are skipped; a relation's places are numbers where they are, else null beside its names."""
    raw = spark.read.schema(RAW_SAMPLE).json(path).where("text is not null")
    pair = lambda s: F.struct(F.get(s, F.lit(0)).alias("start"), F.get(s, F.lit(1)).alias("end"))
    number = lambda x: x.try_cast("int")
    rel = lambda r: F.struct(number(F.get(r, F.lit(0))).alias("head"), number(F.get(r, F.lit(1))).alias("tail"), F.get(r, F.lit(0)).alias("head_name"), F.get(r, F.lit(1)).alias("tail_name"), F.get(r, F.lit(2)).alias("rel"))
    return raw.select("text", "entities", F.transform("entity_spans", pair).alias("entity_spans"), C.normal_concepts("concepts").alias("concepts"), F.transform("relations", rel).alias("relations"), F.coalesce("should_respond", F.lit(0)).alias("should_respond"), "response", F.col("_metadata").alias("metadata"))


def default_samples(spark: SparkSession) -> DataFrame:
    """The five built-in samples."""
    schema = "text string, entities array<string>, entity_spans array<struct<start:int,end:int>>, concepts array<array<string>>, relations array<struct<head:int,tail:int,rel:string>>, should_respond int, response string"
    one = [
        ("cat mouse", "The {0} chased the {1}.", [["animal", "predator"], ["animal", "prey"]], "chases"),
        ("Paris France", "{0} is the capital of {1}.", [["city", "location"], ["country", "location"]], "capital_of"),
        ("Alice Bob", "{0} loves {1}.", [["person"], ["person"]], "loves"),
        ("dog mailman", "The {0} barked at the {1}.", [["animal"], ["person"]], "barks_at"),
        ("sky Blue", "{1} is the colour of the {0}.", [["location"], ["attribute"]], "has_attribute"),
    ]
    rows = []
    for i, (names, pattern, concepts, rel) in enumerate(one):
        ents = names.split()
        text = pattern.format(*ents)
        spans = [(text.index(e), text.index(e) + len(e)) for e in ents]
        rows.append((text, ents, spans, concepts, [(0, 1, rel)], int(i < 4), None))
    return spark.createDataFrame(rows, schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value) of the lines of text files, n from 0 in each file, whatever the splits they are read in.

    Lines come in order within a split.  A first pass counts those of each split; the sums of what comes
    before, one row a split, are joined to the lines.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m")]
    lines = spark.read.text(path).select("value", *place)
    blocks = lines.groupBy("file", "block").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("m") - F.col("first") + F.col("before")).alias("n"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """Rows of JSON lines; ``most`` caps lines, the first in the order of files and lines."""
    if most is None:
        return spark.read.schema(schema).json(path)
    lines = numbered_lines(spark, path).orderBy("file", "n").limit(most)
    return lines.select(F.from_json("value", schema).alias("j")).where("j is not null").select("j.*")


def instruction_set(spark: SparkSession, path: str, most: int | None = None, format: str = "json") -> DataFrame:
    """Rows that have instruction and response, in any of their spellings; an empty context is null.  ``most`` caps raw rows."""
    raw = spark.read.parquet(path) if format == "parquet" else json_lines(spark, path, INSTRUCTION, most)
    raw = raw.limit(most) if most is not None and format == "parquet" else raw
    have = set(raw.columns)
    pick = lambda *names: first_truthy(*[n for n in names if n in have]) if have & set(names) else F.lit(None).cast("string")
    return raw.select(pick("instruction", "prompt").alias("instruction"), pick("response", "output", "completion").alias("response"), pick("context", "input").alias("context")).where("instruction is not null and response is not null")


def triplet_set(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Samples of linearised triples; ``most`` caps converted rows, the first in the order of files and lines."""
    if most is None:
        return C.triplet_samples(spark.read.schema(MARKUP).json(path))
    rows = numbered_lines(spark, path).select("file", "n", F.from_json("value", MARKUP).alias("j")).select("file", "n", "j.*")
    return C.triplet_samples(rows).orderBy("file", "n").limit(most).drop("file", "n")


def document_set(spark: SparkSession, path: str) -> DataFrame:
    """Samples of documents from JSON files that hold one list each; a file that can't be parsed is skipped."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return C.document_relations(raw.where("sents is not null"))


def vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """(entity, id, vec) from lines ``name x1 ... xd`` under a header ``n d``; short lines are skipped, ids are line numbers, so they may have gaps; the last of equal names wins.

    Each file has a header of its own; the lines of several files are numbered on, in the order of their paths.
    """
    lines = numbered_lines(spark, path)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("c"), F.max(F.when(F.col("n") == 0, F.get(parts, F.lit(1)))).cast("int").alias("d"))
    earlier = F.coalesce(F.sum(F.col("c") - 1).over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", "d", earlier.alias("before"))
    full = lines.where("n > 0").join(files, "file").withColumn("p", parts).where(F.size("p") >= F.col("d") + 1)
    rows = full.select(F.get("p", F.lit(0)).alias("entity"), (F.col("before") + F.col("n") - 1).alias("id"), F.transform(F.slice("p", F.lit(2), F.col("d")), lambda x: x.cast("double")).alias("vec"))
    return rows.groupBy("entity").agg(F.max("id").alias("id"), F.max_by("vec", "id").alias("vec"))


def graph_triples(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(src, rel, dst) from JSON lines with start, rel and end uris; lines that aren't JSON are skipped.

    ``most`` caps lines, not triples: the first in the order of files and lines.
    """
    lines = numbered_lines(spark, path).orderBy("file", "n").limit(most) if most is not None else spark.read.text(path)
    parsed = lines.select(F.from_json("value", "start struct<uri:string>, rel struct<uri:string>, end struct<uri:string>").alias("j"))
    return parsed.select(F.col("j.start.uri").alias("src"), F.col("j.rel.uri").alias("rel"), F.col("j.end.uri").alias("dst")).where("src is not null and rel is not null and dst is not null")


def graph_data(spark: SparkSession, vectors: str | None, triples: str | None, kind: str = "conceptnet", most: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Vectors and triples of a knowledge graph; triples only for one kind; what has no path is None."""
    return (vectors_text(spark, vectors) if vectors else None), (graph_triples(spark, triples, most) if triples and kind == "conceptnet" else None)


#: Readers by kind of set; others can be added.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"samples": samples, "instructions": instruction_set, "triplets": triplet_set, "documents": document_set, "vectors": vectors_text, "triples": graph_triples}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A set by its kind; an unknown kind is a ValueError."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown kind of set: {kind}")
    return REGISTRY[kind](spark, path, **options)


def save_splits(samples_: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines by split."""
    samples_.write.mode("overwrite").partitionBy(split).json(path)


def prepare(spark: SparkSession, kind: str, path: str, folder: str, split: Column, convert: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """A set read by its kind, converted, split, saved below a folder, and read back."""
    rows = load(spark, kind, path, **options)
    rows = (convert(rows) if convert else rows).withColumn("split", split)
    save_splits(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


METRIC = "step bigint, value double, text string, tag string, kind string"


def write_metrics(rows: DataFrame, path: str, kind: str = "scalar") -> None:
    """Appends (tag, step, value or text) of one kind of metric: scalar, histogram (a row a value) or text."""
    have = set(rows.columns)
    pick = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    rows.select(pick("step", "bigint"), pick("value", "double"), pick("text", "string"), "tag", F.lit(kind).alias("kind")).write.mode("append").partitionBy("kind").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC).parquet(path)


def save_memory(rows: DataFrame, path: str) -> None:
    """Memory entries as Parquet, without vectors."""
    rows.drop("embedding").write.mode("overwrite").parquet(path)
