"""Queries over configuration, state, sinks and what is left of the surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernmill.operators import conversion as C
from quernmill.operators import facade as Z
from quernmill.operators import graph as G
from quernmill.operators import memory as Y
from quernmill.operators import safety as S
from quernmill.plans.base import Book
from quernmill.plans.conversion import PAIRS_SQL, _markup, _markup_sql, pairs
from quernmill.plans.graph import BOTH_SQL, SMALL_SQL, small_triples
from quernmill.plans.safety import _ethical_category, docs
from quernmill.session import shared_folder, table
from quernmill.sources import readers as R

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query


@query("s3_registry", "select p_name as text from part")
def registry(spark, sf_dir):
    folder = shared_folder(spark)
    table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).write.json(folder)
    return R.load(spark, "samples", folder).select("text")


@query("s4_local_json", "select title, n from (select n_name as title, 4::int as n from nation where exists (select 1 from supplier where s_nationkey = n_nationkey))")
def local_json(spark, sf_dir):
    """Documents from files of one JSON list over many lines, one of which is broken."""
    from quernmill.plans.conversion import _documents

    folder = shared_folder(spark)
    rows = _documents(spark, sf_dir)
    lists = rows.groupBy(F.length("title").alias("k")).agg(F.collect_list(F.struct(*rows.columns)).alias("l")).select("k", F.to_json("l", {"pretty": "true"}).alias("value"))
    lists.unionByName(spark.createDataFrame([(0, '[{"title": "broken", ')], "k int, value string")).write.partitionBy("k").text(folder)
    return R.load(spark, "documents", f"{folder}/*").select("title", F.size("entities").alias("n"))


def _dealt(rows, spark):
    """Rows as JSON lines over several files, in an order that file names and lines tell."""
    folder = shared_folder(spark)
    rows.write.json(folder)
    return folder


@query("s5_capped_raw_rows", f"select instruction, response from (select *, row_number() over (order by conv_id, turn) as n from {PAIRS_SQL}) where n <= 40 and n % 3 <> 0 and instruction <> '' and response <> ''")
def capped_raw_rows(spark, sf_dir):
    """The first forty raw rows, of which every third lacks a response."""
    rows = pairs(spark, sf_dir).orderBy("conv_id", "turn")
    n = F.row_number().over(Window.orderBy("conv_id", "turn"))
    rows = rows.select("conv_id", "turn", "instruction", F.when(n % 3 == 0, "").otherwise(F.col("response")).alias("response")).repartitionByRange(3, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    return R.load(spark, "instructions", _dealt(rows.select("instruction", "response"), spark), most=40).select("instruction", "response")


@query("s6_triplet_set", f"select text, n from (select lower(n_name) || ' hosts ' || s_name as text, 2::int as n, row_number() over (order by s_suppkey) as k from {_markup_sql} where s_suppkey % 2 = 1) where k <= 30")
def triplet_set(spark, sf_dir):
    """The first thirty converted rows of a set, half of which has no triple."""
    rows = _markup(spark, sf_dir).repartitionByRange(3, "s_suppkey").sortWithinPartitions("s_suppkey")
    folder = _dealt(rows.select("context", F.when(F.col("s_suppkey") % 2 == 1, F.col("triplets")).otherwise("none").alias("triplets")), spark)
    return R.load(spark, "triplets", folder, most=30).select("text", F.size("relations").alias("n"))


@query("s8_alpaca_rows", f"select instruction, response, nullif(context, '') as context from {PAIRS_SQL} where instruction <> '' and response <> ''")
def alpaca_rows(spark, sf_dir):
    folder = shared_folder(spark)
    pairs(spark, sf_dir).select("instruction", F.col("response").alias("output"), F.col("context").alias("input")).write.json(folder)
    return R.instruction_set(spark, folder)


@query("s12_graph_data", "select (select count(*) from nation) as triples, (select count(*) from embeddings) as vectors, 0::bigint as others, (select sum(vec_id) from embeddings)::bigint as ids")
def graph_data(spark, sf_dir):
    """Vectors and triples of one kind of graph; of another kind no triples."""
    from quernmill.plans.streams import in_one_file, vector_lines

    triples, vectors = shared_folder(spark), in_one_file(vector_lines(spark, sf_dir))
    uri = lambda c: F.struct(F.col(c).alias("uri"))
    table(spark, sf_dir, "nation").select(uri("n_name").alias("start"), F.struct(F.lit("/r/IsA").alias("uri")).alias("rel"), uri("n_name").alias("end")).write.json(triples)
    v, t = R.graph_data(spark, vectors, triples)
    _, none = R.graph_data(spark, vectors, triples, "wikidata")
    counts = t.agg(F.count(F.lit(1)).alias("triples")).crossJoin(v.agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.substring("entity", 2, 20).cast("long")).alias("ids")))
    return counts.select("triples", "vectors", F.lit(0 if none is None else 1).cast("long").alias("others"), "ids")


@query("s15_prepared", f"select split, count(*) as n from (select case when length(instruction) % 5 = 0 then 'test' else 'train' end as split from {PAIRS_SQL} where instruction <> '' and response <> '') group by 1")
def prepared(spark, sf_dir):
    """Read by kind, converted, split, saved, and read again."""
    folder = shared_folder(spark)
    pairs(spark, sf_dir).select("instruction", "response", F.length("instruction").cast("string").alias("context")).write.json(folder)
    convert = lambda rows: C.instructions(rows.withColumn("size", F.col("context").cast("int")))
    rows = R.prepare(spark, "instructions", folder, shared_folder(spark), F.when(F.col("size") % 5 == 0, "test").otherwise("train"), convert)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s17_saved_config", "select 'high' as strictness, ['bad', 'worse'] as block, ['fine'] as allow")
def saved_config(spark, sf_dir):
    folder = shared_folder(spark)
    config = Z.SafetyConfig("high")
    config.add_terms(["bad", "worse"], ["fine"])
    config.save(spark, folder)
    back = Z.SafetyConfig.load(spark, folder)
    return spark.createDataFrame([(back.strictness, back.keywords.block, back.keywords.allow)], "strictness string, block array<string>, allow array<string>")


@query("s18_audit_sink", f"select left(sha256(text), 16) as text_hash from documents where {_ethical_category} <> 'safe'")
def audit_sink(spark, sf_dir):
    folder = shared_folder(spark)
    S.write_audit(S.audit(S.regulate(docs(spark, sf_dir)), "sink"), folder)
    return spark.read.schema("text_hash string").json(folder)


@query("s19_saved_state", "select count(*) as seen, count(*) filter (value > 0.5) as learned, 0::bigint as rejected, count(*) filter (value <= 0.5) as skipped from events")
def saved_state(spark, sf_dir):
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "events").select(Z.decision(F.col("value")).alias("decision"))
    Z.LearnerState().add(rows).save(spark, folder)
    s = Z.LearnerState.load(spark, folder)
    return spark.createDataFrame([(s.seen, s.learned, s.rejected, s.skipped)], "seen long, learned long, rejected long, skipped long")


@query("p21_extraction_samples", "select p_partkey, [p_brand] as entities, [[p_size::varchar]] as concepts from part")
def extraction_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.array(F.struct(F.col("p_brand").alias("text"), F.col("p_size").alias("type"), F.lit(0.9).alias("conf"))).alias("entities"), F.array().cast(C.RELATIONS).alias("relations"))
    samples = Z.to_samples(rows.withColumn("text", F.col("p_partkey").cast("string")))
    return samples.select(F.col("text").cast("long").alias("p_partkey"), "entities", "concepts")


@query("p25_converter", "select lower(text) as text, doc_id from documents")
def converter(spark, sf_dir):
    return table(spark, sf_dir, "documents").transform(Z.guarded(lambda d: d.select(F.lower("text").alias("text"), "doc_id")))


@query("f2_added_patterns", r"select doc_id, not regexp_matches(text, '\bthe\b', 'i') as safe from documents")
def added_patterns(spark, sf_dir):
    config = Z.SafetyConfig()
    config.add_pattern(r"\bthe\b", "bias")
    config.add_pattern("(broken", "bias")
    return config.keywords.check(docs(spark, sf_dir)).select("doc_id", "safe")


@query("r17_valid_rules", "select o_orderkey as id from orders where o_orderkey % 20 < 16 and o_orderkey % 7 < 5")
def valid_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 20).alias("a"), F.lit(0).alias("b"), (F.col("o_orderkey") % 7).alias("r"), F.lit(1).alias("polarity"))
    return Z.valid_rules(rows, 16, 5).select("id")


@query("k11_path_vectors", f"with e as (select * from {BOTH_SQL.format(SMALL_SQL)}), p as (select distinct x.src, x.dst as mid, y.dst from e x join e y on x.dst = y.src where x.rel = 'based_in' and y.rel = 'part_of') select src, dst, 0 as place, mid as entity from p union all select src, dst, 1, dst from p")
def path_vectors(spark, sf_dir):
    supplier, region = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region")
    ends = supplier.crossJoin(region).select(F.col("s_name").alias("src"), F.col("r_name").alias("dst"))
    found = G.paths(small_triples(spark, sf_dir), ends, 2)
    vectors = region.select(F.col("r_name").alias("entity"), F.array(F.lit(1.0)).alias("vec"))
    return Z.path_vectors(found, vectors).select("src", "dst", "place", "entity")


@query("m8_memory_counts", "select event_type as concept, count(*) filter (event_type <> 'purchase' and event_id % 3 <> 0) as n from events group by 1 union all select 'none', 0")
def memory_counts(spark, sf_dir):
    """Entries by concept after all purchases and a third of the rest are removed: a concept without any stays at zero."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("concept"))
    known = spark.createDataFrame([("none",)], "concept string")
    gone = F.col("event_id") % 3 == 0
    before = Y.concept_counts(events.where(~gone), "concept", known)
    return Y.changed_counts(before, events.where(gone), events.where(gone | (F.col("concept") == "purchase")), "concept")


@query("m11_cleared_memory", "select event_id, value as uncertainty from events where event_id % 7 = 0")
def cleared_memory(spark, sf_dir):
    """A memory saved, cleared and filled again: only what came after is there."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("uncertainty"))
    R.save_memory(events, folder)
    none = Y.cleared(spark, folder, events.schema)
    if not none.isEmpty():
        raise RuntimeError("memory isn't empty")
    events.where("event_id % 7 = 0").write.mode("append").parquet(folder)
    return spark.read.schema(events.schema).parquet(folder)
