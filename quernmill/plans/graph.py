"""Queries over the knowledge graph that the star schema spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.operators import graph as G
from quernmill.plans.base import Book
from quernmill.session import shared_folder, table

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query

TRIPLES_SQL = "(select s_name as src, 'based_in' as rel, n_name as dst from supplier join nation on s_nationkey = n_nationkey union all select c_name, 'lives_in', n_name from customer join nation on c_nationkey = n_nationkey union all select n_name, 'part_of', r_name from nation join region on n_regionkey = r_regionkey)"
SMALL_SQL = "(select s_name as src, 'based_in' as rel, n_name as dst from supplier join nation on s_nationkey = n_nationkey union all select n_name, 'part_of', r_name from nation join region on n_regionkey = r_regionkey)"
BOTH_SQL = "(select src, rel, dst from {0} union all select dst, '~' || rel, src from {0})"


def small_triples(spark, sf_dir) -> DataFrame:
    """Suppliers, nations and regions."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    based = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.lit("based_in").alias("rel"), F.col("n_name").alias("dst"))
    return based.unionByName(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("part_of").alias("rel"), F.col("r_name").alias("dst")))


def triples(spark, sf_dir) -> DataFrame:
    """Those and customers."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    lives = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.lit("lives_in").alias("rel"), F.col("n_name").alias("dst"))
    return small_triples(spark, sf_dir).unionByName(lives)


@query("k1_embeddings", "select c_custkey as entity, coalesce(cast(embedding as double[]), list_transform(range(64), lambda x: 0.0::double)) as vec from customer left join embeddings on c_custkey = vec_id")
def embeddings(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("vec"))
    return G.embeddings_of(entities, vectors, 64)


@query("k2_link_entities", """with n as (select distinct 'The ' || p_type as name, lower(p_type) as normal from part union select distinct p_brand, lower(p_brand) from part union select 'Ghost ' || r_name, 'ghost ' || lower(r_name) from region),
 mapping as (select distinct lower(p_brand) as key, '/m/' || p_brand as node from part where p_brand like '%1'),
 nodes as (select distinct '/c/en/' || replace(lower(p_type), ' ', '_') as node from part union select distinct '/c/en/' || lower(p_brand) from part)
 select name, coalesce(m.node, d.node) as node, case when m.node is not null then 'mapping' else 'spelling' end as stage from n left join mapping m on m.key = n.normal left join nodes d on d.node = '/c/en/' || replace(normal, ' ', '_') where coalesce(m.node, d.node) is not null""")
def link_entities(spark, sf_dir):
    part, region = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    names = part.select(F.explode(F.array(F.concat(F.lit("The "), "p_type"), F.col("p_brand"))).alias("name")).unionByName(region.select(F.concat(F.lit("Ghost "), "r_name").alias("name")))
    mapping = part.where("p_brand like '%1'").select(F.lower("p_brand").alias("key"), F.concat(F.lit("/m/"), "p_brand").alias("node")).distinct()
    nodes = part.select(F.explode(F.array(F.concat(F.lit("/c/en/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))), F.concat(F.lit("/c/en/"), F.lower("p_brand")))).alias("node")).distinct().withColumn("place", F.lit(0))
    return G.link(names, mapping, nodes, fuzzy=False)


@query("k3_fuzzy_links", """with n as (select distinct lower(n_name) || 's' as name from nation union select lower(r_name) || 'n' from region),
 nodes as (select '/c/en/' || replace(lower(n_name), ' ', '_') as node, n_nationkey as place, lower(n_name) as l from nation union all select '/c/en/' || replace(lower(r_name), ' ', '_'), 100 + r_regionkey, lower(r_name) from region),
 p as (select name, node, place, len(list_intersect(list_distinct(list_filter(string_split(name, ''), lambda x: x <> '')), list_distinct(list_filter(string_split(replace(l, ' ', '_'), ''), lambda x: x <> '')))) / greatest(length(name), length(l)) as score from n join nodes on contains(replace(l, ' ', '_'), replace(name, ' ', '_')) or contains(replace(name, ' ', '_'), replace(l, ' ', '_')))
 select name, arg_min(node, place + (1 - score) * 1000000) as node, 'fuzzy' as stage from p where score > 0.5 group by name""")
def fuzzy_links(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(F.concat(F.lower("n_name"), F.lit("s")).alias("name")).unionByName(region.select(F.concat(F.lower("r_name"), F.lit("n")).alias("name")))
    nodes = nation.select(F.concat(F.lit("/c/en/"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))).alias("node"), F.col("n_nationkey").alias("place")).unionByName(region.select(F.concat(F.lit("/c/en/"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("_"))).alias("node"), (F.col("r_regionkey") + 100).alias("place")))
    mapping = nation.limit(0).select(F.col("n_name").alias("key"), F.col("n_name").alias("node"))
    return G.link(names, mapping, nodes)


@query("k4_entity_mapping", "select distinct p_brand as name, '/c/en/' || lower(p_brand) as node from part")
def entity_mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.concat(F.lit("/c/en/"), F.lower("p_brand")).alias("node")).distinct().withColumn("place", F.lit(0))
    none = part.limit(0).select(F.col("p_name").alias("key"), F.col("p_name").alias("node"))
    return G.link(part.select(F.col("p_brand").alias("name")), none, nodes, fuzzy=False).select("name", "node")


@query("k5_edges", f"select rel, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from {BOTH_SQL.format(TRIPLES_SQL)} group by 1")
def edges(spark, sf_dir):
    return G.edges_both_ways(triples(spark, sf_dir)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


_ends_sql = "(select a.s_name as src, b.r_name as dst from supplier a, region b union all select s_name, s_name from supplier union all select a.n_name, b.n_name from nation a, nation b where a.n_name <> b.n_name)"


@query(
    "k6_paths",
    f"""with recursive e as (select * from {BOTH_SQL.format(SMALL_SQL)}), ends as {_ends_sql},
 g as (select src, dst, src as cur, [src] as seen, '' as path, 0 as steps from ends where src <> dst
  union all select g.src, g.dst, e.dst, g.seen || [e.dst], g.path || case when g.path <> '' then '|' else '' end || e.rel || '>' || e.dst, steps + 1 from g join e on e.src = g.cur where steps < 3 and g.cur <> g.dst and not list_contains(g.seen, e.dst)),
 f as (select src, dst, path, steps from g where cur = dst union all select src, dst, 'self>' || src, 1 from ends where src = dst)
 select src, dst, path, steps from f qualify row_number() over (partition by src, dst order by steps, path) <= 10""",
)
def paths(spark, sf_dir):
    supplier, region, nation = (table(spark, sf_dir, t) for t in ("supplier", "region", "nation"))
    some = supplier.crossJoin(region).select(F.col("s_name").alias("src"), F.col("r_name").alias("dst"))
    same = supplier.select(F.col("s_name").alias("src"), F.col("s_name").alias("dst"))
    far = nation.select(F.col("n_name").alias("src")).crossJoin(nation.select(F.col("n_name").alias("dst"))).where("src <> dst")
    return G.paths(small_triples(spark, sf_dir), some.unionByName(same).unionByName(far))


@query("k7_neighbours", "select l_orderkey as src, l_shipdate::date::varchar as rel, l_partkey as dst from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate::date::varchar, l_partkey) <= 3")
def neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_shipdate").cast("date").cast("string").alias("rel"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("place"))
    return G.neighbours(rows, most=3).drop("place")


@query(
    "k8_verify_facts",
    f"""with e as (select distinct * from {BOTH_SQL.format(SMALL_SQL)}), c as (select distinct * from (select s_name as src, 'based_in' as rel, n_name as dst from supplier, nation union all select n_name, 'based_in', s_name from supplier, nation union all select s_name, 'part_of', r_name from supplier, region))
 select src, rel, dst, case when exists (select 1 from e where e.src = c.src and e.rel = c.rel and e.dst = c.dst) then 1.0 when exists (select 1 from e where e.src = c.src and e.rel = '~' || c.rel and e.dst = c.dst) then 0.9
  when exists (select 1 from e where e.src = c.src and e.dst = c.dst) or exists (select 1 from e x join e y on x.dst = y.src where x.src = c.src and y.dst = c.dst and x.dst <> c.src and x.dst <> c.dst) then 0.5 else 0.0 end::double as confidence from c""",
)
def verify_facts(spark, sf_dir):
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    row = lambda s, r, d: (F.col(s).alias("src"), F.lit(r).alias("rel"), F.col(d).alias("dst"))
    claims = supplier.crossJoin(nation).select(*row("s_name", "based_in", "n_name"))
    claims = claims.unionByName(supplier.crossJoin(nation).select(*row("n_name", "based_in", "s_name")))
    claims = claims.unionByName(supplier.crossJoin(region).select(*row("s_name", "part_of", "r_name")))
    return G.verify(claims, small_triples(spark, sf_dir))


@query(
    "k9_query_paths",
    f"""with e as (select * from {BOTH_SQL.format(TRIPLES_SQL)}), ends as (select c_name as src, n_name as dst from customer, nation), p as (
 select src, dst, rel || '>' || dst as path, 1 as steps from e join ends using (src, dst)
 union all select x.src, y.dst, x.rel || '>' || x.dst || '|' || y.rel || '>' || y.dst, 2 from e x join e y on x.dst = y.src join ends on ends.src = x.src and ends.dst = y.dst where x.dst <> x.src and x.dst <> y.dst and y.dst <> x.src)
 select src, dst, path, steps from p qualify row_number() over (partition by src, dst order by steps, path) <= 10""",
)
def query_paths(spark, sf_dir):
    """Paths of at most two steps from every customer to every nation, over all edges; none without a graph."""
    ends = table(spark, sf_dir, "customer").select(F.col("c_name").alias("src")).crossJoin(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_name").alias("dst"))))
    return G.query_paths(triples(spark, sf_dir), ends, 2).unionByName(G.query_paths(None, ends))


@query("k10_append_edges", f"select rel, count(*) as n, count(distinct (src, dst)) as n_distinct from (select * from {TRIPLES_SQL} union all select s_name, 'supplies', p_name from supplier join part on s_suppkey = p_partkey union all select * from {SMALL_SQL}) group by 1")
def append_edges(spark, sf_dir):
    """Relations added in two goes to a graph that is kept, one of them there before."""
    folder = shared_folder(spark)
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    new = supplier.join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_name").alias("src"), F.lit("supplies").alias("rel"), F.col("p_name").alias("dst"))
    G.add_relations(spark, folder, triples(spark, sf_dir))
    kept = G.add_relations(spark, folder, G.commit(new, small_triples(spark, sf_dir)))
    return kept.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src", "dst").alias("n_distinct"))
