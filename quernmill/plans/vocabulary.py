"""Queries over vocabularies, mixtures, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.operators import conversion as C
from quernmill.operators import stages as G
from quernmill.operators import vocabulary as V
from quernmill.plans.base import FACTS_SQL, Book, facts
from quernmill.plans.conversion import EXPANDED_SQL, PAIRS_SQL, _markup, _samples, instruction_pairs, pairs
from quernmill.session import shared_folder, table

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query

_concepts_sql = f"(select head_concept as name from {FACTS_SQL} union select tail_concept from {FACTS_SQL})"


def _concepts(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return rows.select(F.explode(F.array("head_concept", "tail_concept")).alias("name"))


@query(
    "a1_vocabulary",
    f"select 'concept' as kind, name, (row_number() over (order by name) - 1)::int as id from {_concepts_sql} union all select 'relation', relation, (row_number() over (order by relation) - 1)::int from (select distinct relation from {FACTS_SQL})",
)
def vocabulary(spark, sf_dir):
    concepts = V.vocabulary(_concepts(spark, sf_dir), "name").select(F.lit("concept").alias("kind"), "name", "id")
    return concepts.unionByName(V.vocabulary(facts(spark, sf_dir), "relation").select(F.lit("relation").alias("kind"), "name", "id"))


@query(
    "a2_vocabulary_capacities",
    f"select n_concepts, n_relations, greatest(16, 0 + 4)::int as types, greatest(64, n_relations + 10) as relations, greatest(256, n_concepts + 50) as concepts from (select (select count(*) from {_concepts_sql}) as n_concepts, (select count(distinct relation) from {FACTS_SQL}) as n_relations)",
)
def capacities(spark, sf_dir):
    counts = facts(spark, sf_dir).agg(F.size(F.array_union(F.collect_set("head_concept"), F.collect_set("tail_concept"))).cast("long").alias("n_concepts"), F.countDistinct("relation").alias("n_relations"))
    return counts.select("n_concepts", "n_relations", V.capacities(F.col("n_concepts"), F.col("n_relations")).alias("c")).select("n_concepts", "n_relations", F.col("c.types").cast("int").alias("types"), "c.relations", "c.concepts")


@query("a3_merged_vocabulary", "select name, row_number() over (order by name)::int as id from (select p_type as name from part union select p_brand from part union select c_mktsegment from customer)")
def merged(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    names = part.select(F.explode(F.array("p_type", "p_brand")).alias("name")).unionByName(customer.select(F.col("c_mktsegment").alias("name")))
    return V.vocabulary(names, "name", 1)


@query("a4_relation_map", f"select relation as name, row_number() over (order by relation)::int as id from (select distinct relation from {FACTS_SQL})")
def relation_map(spark, sf_dir):
    return V.vocabulary(facts(spark, sf_dir), "relation", 1)


_types_sql = "select source as concept, count(*) as n, min(doc_id) as first from documents group by 1"


@query("a5_type_map", f"select concept, (row_number() over (order by case concept when 'src3' then 1 when 'src1' then 2 else 9 end, case when concept in ('src3', 'src1') then null else -n end, first) - 1)::int as id from ({_types_sql}) qualify id < 12")
def type_map(spark, sf_dir):
    return V.type_map(table(spark, sf_dir, "documents").select(F.col("source").alias("concept"), F.col("doc_id").alias("position")), 12, ["src3", "nowhere", "src1"])


@query("a6_distinct_names", f"select distinct 'relation' as kind, relation as name from {FACTS_SQL} union all select distinct 'head_concept', head_concept from {FACTS_SQL}")
def distinct_names(spark, sf_dir):
    return V.distinct_names(facts(spark, sf_dir), "relation", "head_concept")


_key = T.order_key_sql("doc_id", seed="split")


@query("a7_splits", f"select doc_id, case when n <= floor(total * 0.8) then 'train' when n <= floor(total * 0.8) + floor(total * 0.1) then 'val' else 'test' end as split from (select doc_id, row_number() over (order by {_key}, doc_id) as n, count(*) over () as total from documents)")
def splits(spark, sf_dir):
    return V.splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_mix = T.order_key_sql("doc_id", seed="mix")


@query("a8_mixture", f"select doc_id, lang from (select *, row_number() over (partition by lang order by {_mix}, doc_id) as n, (select count(*) from documents) as total from documents) where (lang = 'en' and n <= floor(total * 0.3)) or (lang = 'de' and n <= floor(total * 0.5)) or (lang = 'fr' and n <= floor(total * 0.05))")
def mixture(spark, sf_dir):
    return V.mixture(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 0.3, "de": 0.5, "fr": 0.05}, "doc_id")


_order = T.order_key_sql("source", "key", seed="stage2")
_conv = f"(select 'conversations' as source, conv_id || ':' || turn as key, instruction, response, nullif(context, '') as context, row_number() over (order by conv_id, turn) as n from {PAIRS_SQL} where instruction <> '' and response <> '')"
_bench = "(select 'benchmark' as source, item_id::varchar as key, 'Say: ' || text as instruction, text as response, null::varchar as context, row_number() over (order by item_id) as n from benchmark where text <> '')"


def _sources(spark, sf_dir):
    """Two instruction sets with a key and an order each."""
    conv = instruction_pairs(spark, sf_dir).select(F.concat("conv_id", F.lit(":"), "turn").alias("key"), "instruction", "response", "context", F.struct("conv_id", "turn").alias("order"))
    bench = table(spark, sf_dir, "benchmark").where("text <> ''").select(F.col("item_id").cast("string").alias("key"), F.concat(F.lit("Say: "), "text").alias("instruction"), F.col("text").alias("response"), F.lit(None).cast("string").alias("context"), F.struct("item_id").alias("order"))
    return {"conversations": conv, "benchmark": bench}


@query("a9_sources_union", f"select source, key, instruction, response, context, row_number() over (order by {_order}, source, key) as place from (select * from {_conv} where n <= 150 union all select * from {_bench} where n <= 150)")
def sources_union(spark, sf_dir):
    """Stage 2: of each known source at most 150 rows, all in shuffled order; an unknown source is skipped."""
    return G.instruction_stage(_sources(spark, sf_dir), ["conversations", "nowhere", "benchmark"], 150)


@query("a10_stage_counts", f"select 'entity_relation' as stage, least(30, count(*)) as samples from supplier join nation on s_nationkey = n_nationkey union all select 'instruction', (select least(150, count(*)) from {_conv}) + (select least(150, count(*)) from {_bench})")
def stage_counts(spark, sf_dir):
    """Both stages prepared, saved, read back and counted."""
    folder = shared_folder(spark)
    one = G.entity_stage(_markup(spark, sf_dir), 30, "s_suppkey")
    two = G.instruction_stage(_sources(spark, sf_dir), ["conversations", "benchmark"], 150)
    return G.prepare_all(spark, {"entity_relation": one.select("text", "entities", "concepts"), "instruction": two.drop("place")}, folder)


@query("a11_convert_by_split", f"select split, count(*) as n, sum(length(text))::bigint as chars from (select case when conv_id % 5 = 0 then 'test' else 'train' end as split, instruction || case when context <> '' and context <> instruction then chr(10) || chr(10) || 'Context: ' || context else '' end as text from {PAIRS_SQL} where instruction <> '' and response <> '') group by 1")
def convert_by_split(spark, sf_dir):
    """A converter run on each split of a set."""
    rows = pairs(spark, sf_dir)
    splits = {"train": rows.where("conv_id % 5 <> 0"), "test": rows.where("conv_id % 5 = 0")}
    return G.convert_splits(splits, C.instructions).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a12_first_rows", f"with e as ({EXPANDED_SQL}) select conv_id, turn, form, text from e order by conv_id, turn, case form when 'question' then 1 else 0 end limit 100")
def first_rows(spark, sf_dir):
    """The first hundred samples after statements are expanded."""
    return G.load_samples(_samples(spark, sf_dir), 100, "conv_id", "turn").select("conv_id", "turn", "form", "text")


_batch = T.order_key_sql("doc_id", seed="batch")


@query("b6_batches", f"select doc_id, batch from (select doc_id, ((row_number() over (order by {_batch}, doc_id) - 1) // 64)::bigint as batch, count(*) over () as total from documents) where batch < total // 64")
def batches(spark, sf_dir):
    return V.batches(table(spark, sf_dir, "documents").select("doc_id"), 64, "doc_id")
