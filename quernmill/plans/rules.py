"""Queries over rule mining, rule updates and concept vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernmill.operators import rules as R
from quernmill.plans.base import FACTS_SQL, Book, facts, rounded
from quernmill.session import table

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query

PAIRS_SQL = f"(select head_concept as concept_a, tail_concept as concept_b, relation, sample_id from {FACTS_SQL})"
VECTORS_SQL = "(select vec_id as id, label, cast(embedding as double[]) as vec from embeddings)"
COSINE = "list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-8)"


def pairs(spark, sf_dir) -> DataFrame:
    return facts(spark, sf_dir).select(F.col("head_concept").alias("concept_a"), F.col("tail_concept").alias("concept_b"), "relation", "sample_id")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


_positive = f"""select concept_a, concept_b, relation, n as frequency, n / t as confidence, least(1.0, n / 10) * (n / t) as weight, 1 as polarity from
 (select *, sum(n) over (partition by relation) as t from (select concept_a, concept_b, relation, count(*) as n from {PAIRS_SQL} group by all)) where n >= 5 and n / t >= 0.005 order by n desc, concept_a, concept_b, relation limit 50"""


@query("r1_positive_rules", f"select concept_a, concept_b, relation, frequency, round(confidence, 9) as confidence, round(weight, 9) as weight, polarity from ({_positive})")
def positive_rules(spark, sf_dir):
    return R.mine_positive(pairs(spark, sf_dir), 5, 0.005).withColumns({c: rounded(c, 9) for c in ("confidence", "weight")})


@query(
    "r2_negative_rules",
    """with c as (select p_brand as concept_a, p_type as concept_b, 'size ' || p_size as relation, count(*) as n from part group by all),
 t as (select concept_a, concept_b, sum(n)::bigint as total from c group by 1, 2 having sum(n) >= 2 order by 1, 2 limit 20)
 select t.concept_a, t.concept_b, r.relation, 0.3::double as weight, -1 as polarity from t cross join (select distinct relation from c) r left join c using (concept_a, concept_b, relation) where (coalesce(n, 0) = 0 or (n = 1 and total >= 3)) and total > coalesce(n, 0)""",
)
def negative_rules(spark, sf_dir):
    return R.mine_negative(table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept_a"), F.col("p_type").alias("concept_b"), F.concat(F.lit("size "), "p_size").alias("relation")))


@query(
    "r3_configured_rules",
    f"""with r as ({_positive}), a as (select c_mktsegment as concept, (row_number() over (order by c_mktsegment) - 1)::int as id from (select distinct c_mktsegment from customer)), b as (select n_name as concept, (4 + row_number() over (order by n_name))::int as id from (select distinct n_name from nation)), m as (select * from a union all select * from b), v as (select relation as name, row_number() over (order by relation)::int as id from (select distinct relation from {FACTS_SQL}))
 select x.id as a, y.id as b, v.id - 1 as r, round(weight, 9) as weight, polarity from r join m x on x.concept = concept_a join m y on y.concept = concept_b join v on v.name = relation where x.id < 16 and y.id < 16 and v.id - 1 < 2""",
)
def configured_rules(spark, sf_dir):
    from quernmill.operators.vocabulary import vocabulary

    segments = vocabulary(table(spark, sf_dir, "customer"), "c_mktsegment")
    nations = vocabulary(table(spark, sf_dir, "nation"), "n_name", 5)
    types = segments.unionByName(nations).select(F.col("name").alias("concept"), "id")
    rules = R.configure(R.mine_positive(pairs(spark, sf_dir), 5, 0.005), types, vocabulary(facts(spark, sf_dir), "relation", 1), 16, 2)
    return rules.withColumn("weight", rounded("weight", 9))


_observed = f"""(select concept_a, concept_b, relation, n as frequency, greatest(p / n, 1 - p / n) as confidence, greatest(p / n, 1 - p / n) as weight, case when p / n >= 0.5 then 1 else -1 end as polarity from (select concept_a, concept_b, relation, count(*) as n, count(*) filter (sample_id % 3 = 0) as p from {PAIRS_SQL} group by all) where n >= 3 and (p / n >= 0.6 or 1 - p / n >= 0.6))"""


@query("r5_observed_rules", f"select * replace (round(confidence, 9) as confidence, round(weight, 9) as weight) from {_observed}")
def observed_rules(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("positive", F.col("sample_id") % 3 == 0)
    return R.observed(rows, 3, 0.6).withColumns({c: rounded(c, 9) for c in ("confidence", "weight")})


def _raw_rules(spark, sf_dir):
    return pairs(spark, sf_dir).select("concept_a", "concept_b", "relation", F.col("sample_id").alias("rule_id"), ((F.col("sample_id") % 100) / 100).alias("confidence"), F.when(F.col("sample_id") % 5 == 0, -1).otherwise(1).alias("polarity"))


_raw_sql = f"(select concept_a, concept_b, relation, sample_id as rule_id, (sample_id % 100) / 100 as confidence, case when sample_id % 5 = 0 then -1 else 1 end as polarity from {PAIRS_SQL})"


@query("r6_upserted_rules", f"select concept_a, concept_b, relation, max(rule_id) as rule_id, arg_max(confidence, rule_id) as confidence, arg_max(polarity, rule_id) as polarity from {_raw_sql} group by all")
def upserted_rules(spark, sf_dir):
    return R.upsert(_raw_rules(spark, sf_dir), "rule_id")


@query("r7_pruned_rules", f"select * from (select concept_a, concept_b, relation, max(rule_id) as rule_id, arg_max(confidence, rule_id) as confidence, arg_max(polarity, rule_id) as polarity from {_raw_sql} group by all) order by confidence desc, concept_a, concept_b, relation limit 190")
def pruned_rules(spark, sf_dir):
    return R.prune(R.upsert(_raw_rules(spark, sf_dir), "rule_id"), 200)


@query("r8_conflicting_rules", f"select concept_a, concept_b, relation, count(*) filter (polarity = 1) as positive, count(*) filter (polarity = -1) as negative, min(rule_id) filter (polarity = 1) as first_positive, min(rule_id) filter (polarity = -1) as first_negative from {_raw_sql} group by all having count(distinct polarity) = 2")
def conflicting_rules(spark, sf_dir):
    return R.conflicts(_raw_rules(spark, sf_dir))


@query("r4_config_rows", f"select concept_a, concept_b, relation, round(weight, 9) as weight, polarity from ({_positive}) where weight > 0")
def config_rows(spark, sf_dir):
    return R.config_rows(R.mine_positive(pairs(spark, sf_dir), 5, 0.005)).select(*R.KEY, rounded("weight", 9).alias("weight"), "polarity")


@query("r9_rules_for_concepts", f"select * from {_raw_sql} where concept_a = 'BUILDING' or concept_b in (select n_name from nation where n_regionkey = 1)")
def rules_for_concepts(spark, sf_dir):
    concepts = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("concept")).unionByName(spark.createDataFrame([("BUILDING",)], "concept string"))
    return R.for_concepts(_raw_rules(spark, sf_dir), concepts)


@query("r10_added_concepts", "with k as (select n_name as name, n_nationkey as id from nation) select name, id from k union all select name, (24 + row_number() over (order by name))::int as id from (select distinct p_type as name from part where p_type not in (select name from k)) qualify id < 28")
def added_concepts(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return R.add_concepts(known, table(spark, sf_dir, "part").select(F.col("p_type").alias("name")), 28)


@query(
    "r11_moved_embeddings",
    f"with v as (select id, list_transform(list_zip(vec, list_reverse(vec)), lambda z: z[1] * 0.9 + z[2] * 0.1) as m from {VECTORS_SQL}) select id, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6)) as vec from v",
)
def moved_embeddings(spark, sf_dir):
    moved = vectors(spark, sf_dir).select("id", R.moved_embedding("vec", F.reverse("vec")).alias("v"))
    return moved.select("id", F.transform("v", lambda x: rounded(x, 6)).alias("vec"))


_unit = "list_transform({0}, lambda x: x / greatest(sqrt(list_dot_product({0}, {0})), 1e-12))"


@query(
    "r12_kept_concepts",
    f"""with recursive v as (select id, vec from {VECTORS_SQL}), p as (select b.id as j, min(a.id) as i from v a join v b on a.id < b.id where {COSINE.format('a.vec', 'b.vec')} > 0.3 group by 1),
 l as (select i, vec, row_number() over (partition by i order by j) as n from p join v on v.id = j),
 f as (select id, vec, 0 as n from v where id not in (select j from p) union all select f.id, {_unit.format('list_transform(list_zip(f.vec, l.vec), lambda z: (z[1] + z[2]) / 2)')}, f.n + 1 from f join l on l.i = f.id and l.n = f.n + 1)
 select id, list_transform(arg_max(vec, n), lambda x: round(x, 5)) as vec from f group by id""",
)
def kept_concepts(spark, sf_dir):
    return R.merged_concepts(vectors(spark, sf_dir).drop("label"), 0.3).select("id", F.transform("vec", lambda x: rounded(x, 5)).alias("vec"))


@query("r10_grown_bank", f"with v as (select id, vec from {VECTORS_SQL} where label = 0), w as (select id, vec from {VECTORS_SQL} where label = 1), p as (select distinct b.id as j from v a join v b on a.id < b.id where {COSINE.format('a.vec', 'b.vec')} > 0.3), k as (select id from v where id not in (select j from p)), f as (select 'w' || id as name, row_number() over (order by 'w' || id) as n from w), b as (select 'v' || id as name, (row_number() over (order by id) - 1)::int as id from k union all select name, (select count(*) from k)::int + n::int - 1 from f) select name, id, case when name like 'w%' then 'root' end as parent from b where id < 60")
def grown_bank(spark, sf_dir):
    """A bank that has no room for all new concepts: similar ones are merged, then new ones added up to its capacity."""
    v = vectors(spark, sf_dir)
    bank = v.where("label = 0").select("id", F.concat(F.lit("v"), "id").alias("name"), "vec")
    bank, tree = R.grow_bank(bank, v.where("label = 1").select(F.concat(F.lit("w"), "id").alias("name"), "vec", F.lit("root").alias("parent")), 60, 0.3)
    return bank.join(tree, "name", "left").select("name", "id", "parent").where("id < 60")


@query("r13_similar_concepts", f"select a.id as of_id, b.id as id, round({COSINE.format('a.vec', 'b.vec')}, 6) as similarity from {VECTORS_SQL} a join {VECTORS_SQL} b on a.id <> b.id qualify row_number() over (partition by a.id order by {COSINE.format('a.vec', 'b.vec')} desc, b.id) <= 5")
def similar_concepts(spark, sf_dir):
    return R.similar_concepts(vectors(spark, sf_dir), 5).withColumn("similarity", rounded("similarity", 6))


def _facts_as_samples(spark, sf_dir):
    """Facts as samples of two entities and one relation."""
    rows = facts(spark, sf_dir)
    one = lambda c: F.array(F.col(c))
    rel = F.array(F.struct(F.lit(0).alias("head"), F.lit(1).alias("tail"), F.col("relation").alias("rel")), F.struct(F.lit(0).alias("head"), F.lit(9).alias("tail"), F.lit("nothing").alias("rel")))
    return rows.select(F.array(F.concat(F.lit("order "), "sample_id"), F.col("tail_concept")).alias("entities"), F.array(one("head_concept"), one("tail_concept")).alias("concepts"), rel.alias("relations"))


def _known(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("name"), (F.row_number().over(Window.orderBy("n_name")) - 1).alias("id"))


_known_sql = "(select n_name as name, row_number() over (order by n_name) - 1 as id from nation where n_regionkey = 0)"
_names_sql = f"(select head_concept as name from {FACTS_SQL} union select tail_concept from {FACTS_SQL})"


@query(
    "r14_sample_updates",
    f"""select 'concept' as part, name as a, '' as b, '' as relation, id as n from (select name, id from {_known_sql} union all select name, (select count(*) from {_known_sql}) - 1 + row_number() over (order by name) from {_names_sql} where name not in (select name from {_known_sql})) where id < 20
 union all select 'rule', concept_a, concept_b, relation, count(*) from {PAIRS_SQL} group by all having count(*) >= 3
 union all select 'edge', '', tail_concept, relation, count(*) from {FACTS_SQL} group by all""",
)
def sample_updates(spark, sf_dir):
    """Concepts, rules and edges that all samples together give, edges counted by target."""
    concepts, rules, edges = R.process_samples(_facts_as_samples(spark, sf_dir), _known(spark, sf_dir), 20)
    no = F.lit("")
    parts = concepts.select(F.lit("concept").alias("part"), F.col("name").alias("a"), no.alias("b"), no.alias("relation"), F.col("id").cast("long").alias("n"))
    parts = parts.unionByName(rules.select(F.lit("rule").alias("part"), F.col("concept_a").alias("a"), F.col("concept_b").alias("b"), "relation", F.col("frequency").alias("n")))
    by = edges.groupBy(F.col("dst").alias("b"), F.col("rel").alias("relation")).agg(F.count(F.lit(1)).alias("n"))
    return parts.unionByName(by.select(F.lit("edge").alias("part"), no.alias("a"), "b", "relation", "n"))


@query("r15_rule_statistics", f"select count(*) as rules, count(*) filter (polarity = 1) as positive, count(*) filter (polarity = -1) as negative, round(avg(confidence), 9) as mean_confidence, (select count(*) from {_names_sql}) as concepts, (select count(*) from orders join customer on o_custkey = c_custkey) as pending from {_observed}")
def rule_statistics(spark, sf_dir):
    rules = R.observed(pairs(spark, sf_dir).withColumn("positive", F.col("sample_id") % 3 == 0), 3, 0.6)
    names = facts(spark, sf_dir).select(F.explode(F.array("head_concept", "tail_concept")).alias("name"))
    return R.statistics(rules, names, pairs(spark, sf_dir)).withColumn("mean_confidence", rounded("mean_confidence", 9))
