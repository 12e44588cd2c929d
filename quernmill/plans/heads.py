"""Queries over extraction from predictions, encoding, and model heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.operators import extraction as X
from quernmill.operators import linalg as L
from quernmill.operators import metrics as M
from quernmill.operators.vocabulary import vocabulary
from quernmill.plans.base import Book, rounded
from quernmill.plans.rules import VECTORS_SQL, vectors
from quernmill.session import table

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query

#: Sixteen tokens of four classes from a vector's 64 numbers.
CELLS_SQL = f"(select id, l as position, k as class, vec[l * 4 + k + 1] as x, exp(3 * vec[l * 4 + k + 1]) / (exp(3 * vec[l * 4 + 1]) + exp(3 * vec[l * 4 + 2]) + exp(3 * vec[l * 4 + 3]) + exp(3 * vec[l * 4 + 4])) as p from {VECTORS_SQL}, range(16) b(l), range(4) c(k))"


def cells(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    rows = v.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("vec", i * 4 + 1, F.lit(4)))).alias("position", "xs"))
    rows = rows.withColumn("ps", M.softmax(F.transform("xs", lambda x: 3 * x)))
    return rows.select("id", "position", F.posexplode(F.arrays_zip("xs", "ps")).alias("class", "z")).select("id", "position", "class", F.col("z.xs").alias("x"), F.col("z.ps").alias("p"))


_best = f"(select id, position, arg_max(class, p - class * 1e-12) as type, max(p) as conf from {CELLS_SQL} group by all)"
_ents = f"""(with r as (select *, position - row_number() over (partition by id, type order by position) as run from {_best} where type > 0 and conf >= 0.3),
 q as (select *, (row_number() over (partition by id, type, run order by position) - 1) // 2 as part from r)
 select id, min(position) as start, max(position) as "end", type, avg(conf) as conf from q group by id, type, run, part)"""


def _entities(spark, sf_dir):
    return X.entities(X.best_classes(cells(spark, sf_dir), "id", "position"), "id", "position", 0.3, 1, 2)


@query("e1_entities", f'select id, start::int as start, "end"::int as "end", type::int as type, round(conf, 6) as conf from {_ents}')
def entities(spark, sf_dir):
    return _entities(spark, sf_dir).select("id", "start", "end", F.col("type").cast("int").alias("type"), rounded("conf", 6).alias("conf"))


_tokens_sql = f"(select id, list_transform(range(1, 17), lambda i: 't' || floor(abs(vec[i]) * 1000)::int) as tokens from {VECTORS_SQL})"


def _tokens(spark, sf_dir) -> DataFrame:
    """Sixteen words of a vector."""
    v = vectors(spark, sf_dir)
    return v.select("id", F.transform(F.slice("vec", 1, 16), lambda x: F.concat(F.lit("t"), F.floor(F.abs(x) * 1000).cast("int"))).alias("tokens"))


_texts = f"""(select e.*, array_to_string(tokens[e.start + 1:e."end" + 1], ' ') as text, case when e.start > 0 then length(array_to_string(tokens[1:e.start], ' ')) + 1 else 0 end as char_start from {_ents} e join {_tokens_sql} using (id))"""


@query("e2_entity_texts", f'select id, start::int as start, text, char_start::int as char_start, (char_start + length(text))::int as char_end from {_texts}')
def entity_texts(spark, sf_dir):
    return X.entity_texts(_entities(spark, sf_dir), _tokens(spark, sf_dir), "id").select("id", "start", "text", "char_start", "char_end")


@query("e3_top_concepts", f"select id, position::int as concept, place::int as place from (select *, row_number() over (partition by id order by round(p, 9) desc, position) as place from (select id, position, max(p) as p from {CELLS_SQL} group by 1, 2)) where place <= 3 and (p >= 0.4 or place = 1)")
def top_concepts(spark, sf_dir):
    rows = cells(spark, sf_dir).groupBy("id", F.col("position").alias("concept")).agg(rounded(F.max("p"), 9).alias("p"))
    return X.top_concepts(rows, "id", "concept", "p", 3, 0.4).select("id", "concept", F.col("place").cast("int").alias("place"))


_rel = f"(select id, position // 4 as i, position % 4 as j, class as relation, p from {CELLS_SQL})"
_rels = f"(select id, i, j, arg_max(relation, p - relation * 1e-12) as type, max(p) as conf from {_rel} where i < j group by all having arg_max(relation, p - relation * 1e-12) > 0 and max(p) >= 0.3)"


def _pairs(spark, sf_dir):
    return cells(spark, sf_dir).select("id", F.floor(F.col("position") / 4).cast("int").alias("i"), (F.col("position") % 4).alias("j"), F.col("class").alias("relation"), "p", "x")


@query("e4_relations", f"select id, i::int as i, j::int as j, type::int as type, round(conf, 6) as conf from {_rels}")
def relations(spark, sf_dir):
    return X.relations(_pairs(spark, sf_dir), "id", 0.3).select("id", "i", "j", F.col("type").cast("int").alias("type"), rounded("conf", 6).alias("conf"))


_numbered = f"(select *, row_number() over (partition by id order by start, type) - 1 as n from {_texts})"


@query(
    "e5_extracted",
    f"""with e as {_numbered}, r as (select x.* from {_rels} x where exists (select 1 from e where e.id = x.id and e.n = x.i) and exists (select 1 from e where e.id = x.id and e.n = x.j)),
 c as (select id, position, row_number() over (partition by id order by p desc, position) as place, p from (select id, position, max(p) as p from {CELLS_SQL} group by 1, 2))
 select v.id, (select coalesce(list(text order by n), []) from e where e.id = v.id) as entities, (select list(position::int order by place) from c where c.id = v.id and place <= 3) as concepts, (select coalesce(list([i::int, j::int, type::int] order by i, j), []) from r where r.id = v.id) as relations from {VECTORS_SQL} v""",
)
def extracted(spark, sf_dir):
    """Entities, concepts and relations of each sample in one go."""
    c = cells(spark, sf_dir)
    concepts = c.groupBy("id", F.col("position").alias("concept")).agg(F.max("p").alias("p"))
    rows = X.extract(_tokens(spark, sf_dir), c.select("id", "position", "class", "p"), concepts, _pairs(spark, sf_dir), "id", 0.3, 0.3, 2)
    return rows.select("id", F.transform("entities", lambda e: e["text"]).alias("entities"), "concepts", F.transform("relations", lambda r: F.array(r["i"].cast("int"), r["j"].cast("int"), r["type"].cast("int"))).alias("relations"))


@query("b1_padded_batches", "with p as (select p_partkey, p_partkey // 64 as batch, list_transform(string_split(p_name, ' '), lambda w: length(w)::int) as ids from part), m as (select *, max(len(ids)) over (partition by batch) as n from p) select p_partkey, list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0::int)) as ids, list_concat(list_transform(ids, lambda x: 1::int), list_transform(range(n - len(ids)), lambda x: 0::int)) as attention from m")
def padded_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 64).alias("batch"), F.transform(F.split("p_name", " "), lambda w: F.length(w)).alias("ids"))
    return X.padded(rows, "batch", "ids").select("p_partkey", "ids", "attention")


_labels = f"""(with e as (select id, row_number() over (partition by id order by start) - 1 as n, conf from {_ents}), s as (select *, row_number() over (partition by id order by n) - 1 as k from e where conf >= 0.4),
 r as (select x.id, count(*) as n_relations from {_rels} x join s a on a.id = x.id and a.n = x.i join s b on b.id = x.id and b.n = x.j group by 1)
 select id, count(*) as n_entities, coalesce(max(n_relations), 0) as n_relations, avg(conf) as confidence from s left join r using (id) group by id having count(*) >= 2)"""


def _pseudo(spark, sf_dir):
    from pyspark.sql import Window

    ents = _entities(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1)
    return X.pseudo_labels(ents, X.relations(_pairs(spark, sf_dir), "id", 0.3), "id", 0.4, 2, 0.5)


@query("e6_pseudo_labels", f"select id, n_entities, n_relations, round(confidence, 6) as confidence from {_labels}")
def pseudo_labels(spark, sf_dir):
    return _pseudo(spark, sf_dir).select("id", "n_entities", "n_relations", rounded("confidence", 6).alias("confidence"))


@query("e7_taken_labels", f"select round(confidence, 6) >= 0.5 as taken, count(*) as n from {_labels} group by 1")
def taken_labels(spark, sf_dir):
    return _pseudo(spark, sf_dir).groupBy((rounded("confidence", 6) >= 0.5).alias("taken")).agg(F.count(F.lit(1)).alias("n"))


@query("b2_multi_hot", "with v as (select name, row_number() over (order by name) - 1 as id from (select distinct p_brand as name from part union select distinct p_type from part)) select p_partkey, list_sort([a.id::int, b.id::int]) as hot, case when p_type like 'E%' then 2 else 0 end::int as type from part join v a on a.name = p_brand join v b on b.name = p_type")
def multi_hot(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.lit(1).alias("entity"), F.posexplode(F.array("p_brand", "p_type")).alias("position", "concept"))
    words = vocabulary(rows, "concept", 1)
    types = part.where("p_type like 'E%'").select(F.col("p_type").alias("concept"), F.lit(2).alias("id")).distinct()
    return X.multi_hot(rows, words, "p_partkey", types).select("p_partkey", "hot", F.coalesce("type", F.lit(0)).alias("type"))


@query("b3_indexed_relations", "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 0 else 1 end::int as head, 2::int as tail, case l_returnflag when 'A' then 0 else 1 end::int as rel from lineitem where l_returnflag in ('A', 'N') and l_linestatus = 'O' or l_returnflag = 'A'")
def indexed_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("key"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("entities"), F.when(F.col("l_linenumber") % 2 == 0, "0").otherwise("y").alias("head"), F.when(F.col("l_linestatus") == "O", "z").when(F.col("l_returnflag") == "A", "2").otherwise("9").alias("tail"), F.col("l_returnflag").alias("rel"))
    known = spark.createDataFrame([("A", 1), ("N", 2)], "name string, id int")
    return X.indexed_relations(rows, "key", "entities", known).select("key.l_orderkey", "key.l_linenumber", "head", "tail", "rel")


@query("b5_token_spans", "select p_partkey, case when strpos(p_name, ' ') > 0 then 1 else 0 end::int as first, (len(string_split(p_name, ' ')) - 1)::int as last from part")
def token_spans(spark, sf_dir):
    at = F.when(F.instr("p_name", " ") > 0, F.instr("p_name", " ")).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", X.token_span(X.token_offsets("p_name"), at, F.length("p_name")).alias("s")).select("p_partkey", "s.*")


@query("b4_entity_token_spans", "select p_partkey, case when strpos(lower(p_name), lower(split_part(p_name, ' ', 1))) > 0 then 0 end::int as first, 0::int as last from part")
def entity_token_spans(spark, sf_dir):
    from quernmill.functions.text import find_span

    span = find_span("p_name", F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return table(spark, sf_dir, "part").select("p_partkey", X.token_span(X.token_offsets("p_name"), span["start"], span["end"]).alias("s")).select("p_partkey", "s.*")


@query("l1_linear", f"select v.id, b.label as out, round(list_dot_product(v.vec, b.vec) + b.label, 6) as value from {VECTORS_SQL} v, (select label, arg_min(vec, id) as vec from {VECTORS_SQL} group by 1) b")
def linear(spark, sf_dir):
    v = vectors(spark, sf_dir)
    weights = v.groupBy(F.col("label").alias("out")).agg(F.min_by("vec", "id").alias("w")).withColumn("b", F.col("out").cast("double"))
    return L.linear(v, weights, "id").select("id", "out", rounded("value", 6).alias("value"))


_assign = f"(select id, label, e / sum(e) over (partition by id) as weight from (select v.id, b.label, exp(list_dot_product(v.vec, b.c) / greatest(sqrt(list_dot_product(v.vec, v.vec)) * sqrt(list_dot_product(b.c, b.c)), 1e-8)) as e from {VECTORS_SQL} v, (select label, arg_min(vec, id) as c from {VECTORS_SQL} group by 1) b))"


@query("l2_soft_assign", f"select id, label as concept, round(weight, 6) as weight from {_assign}")
def soft_assign(spark, sf_dir):
    v = vectors(spark, sf_dir)
    bank = v.groupBy(F.col("label").alias("concept")).agg(F.min_by("vec", "id").alias("c"))
    return L.soft_assign(v.drop("label"), bank, "id").select("id", "concept", rounded("weight", 6).alias("weight"))


@query(
    "l3_attention_pool",
    f"""with t as (select id, l as position, vec[l * 4 + 1:l * 4 + 4] as v, l < 12 as mask from {VECTORS_SQL}, range(16) b(l)), q as (select * from (values (0, [1.0::double, 0, 0, 0]), (1, [0.5::double, -0.5, 1, 0])) x(query, q)),
 s as (select id, query, v, case when mask then list_dot_product(v, q) / 2 else -10000 end as s from t, q), e as (select *, exp(s - max(s) over (partition by id, query)) as e from s), w as (select *, e / sum(e) over (partition by id, query) as w from e)
 select id, query, [round(sum(w * v[1]), 6), round(sum(w * v[2]), 6), round(sum(w * v[3]), 6), round(sum(w * v[4]), 6)] as pooled from w group by all""",
)
def attention_pool(spark, sf_dir):
    tokens = vectors(spark, sf_dir).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("vec", i * 4 + 1, F.lit(4)))).alias("position", "vec")).withColumn("mask", F.col("position") < 12)
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.5, -0.5, 1.0, 0.0])], "query int, q array<double>")
    return L.attention_pool(tokens, queries, "id", 4).select("id", "query", F.transform("pooled", lambda x: rounded(x, 6)).alias("pooled"))


@query("l4_span_mean", f"with t as (select id, label, i - 1 as position, vec[i] as value from {VECTORS_SQL}, range(1, 65) r(i)) select id, round(case when label < 5 then (avg(value) filter (position between 0 and 3) + avg(value) filter (position between 10 and 19)) / 2 else avg(value) end, 6) as value from t group by id, label")
def span_mean(spark, sf_dir):
    v = vectors(spark, sf_dir)
    tokens = v.select("id", F.posexplode("vec").alias("position", "value"))
    spans = v.where("label < 5").select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((0, 3), (10, 19))])).alias("s")).select("id", "s.*")
    return L.span_mean(tokens, spans, "id").select("id", rounded("value", 6).alias("value"))


@query("l5_top_nodes", f"select id, position::int as position, place::int as place from (select *, row_number() over (partition by id order by score desc, position) as place from (select id, position, max(x) as score from {CELLS_SQL} group by 1, 2)) where place <= 5")
def top_nodes(spark, sf_dir):
    return L.top_nodes(cells(spark, sf_dir).select("id", "position", F.col("x").alias("p")), "id", 5).select("id", "position", F.col("place").cast("int").alias("place"))


@query(
    "l6_node_types",
    f"""with n as (select id, position, place - 1 as node from (select *, row_number() over (partition by id order by score desc, position) as place from (select id, position, max(x) as score from {CELLS_SQL} group by 1, 2)) where place <= 5),
 g as (select id, node, class, coalesce(x, 0) as x from (select id, k as node, c as class from {VECTORS_SQL}, range(7) a(k), range(4) b(c)) left join (select n.id, node, class, x from n join {CELLS_SQL} c on c.id = n.id and c.position = n.position) using (id, node, class))
 select id, node::int as node, class::int as class, round(exp(x) / sum(exp(x)) over (partition by id, node), 6) as p from g""",
)
def node_types(spark, sf_dir):
    """Type probabilities of the five best nodes, and of two that only fill up."""
    c = cells(spark, sf_dir)
    nodes = L.top_nodes(c.select("id", "position", F.col("x").alias("p")), "id", 5)
    return L.node_types(c.select("id", "position", "class", "x"), nodes, "id", 7).select("id", "node", "class", rounded("p", 6).alias("p"))


#: Layers (weights by output, bias) of a scorer over two vectors of two numbers, and of graph networks without and with a relation's.
SCORER = [([[1.0, -2.0, 0.5, 1.5], [-1.0, 0.3, 2.0, -0.7], [0.2, 0.4, -0.6, 0.8]], [0.1, -0.2, 0.05]), ([[30.0, -20.0, 10.0], [-15.0, 25.0, 40.0]], [0.5, -0.25])]
PAIR = [([[0.5, -1.0, 1.5, 0.25], [1.0, 0.75, -0.5, 2.0]], [0.1, 0.2]), ([[1.0, -0.5], [0.3, 1.2]], [0.05, -0.1])]
PAIR2 = [([[-0.4, 0.9, 0.6, -1.1], [0.7, 0.2, 1.3, -0.8]], [0.0, 0.3]), ([[0.8, 0.4], [-1.0, 0.6]], [0.2, 0.1])]
TRIPLE = [([[0.5, -1.0, 1.5, 0.25, 0.7], [1.0, 0.75, -0.5, 2.0, -0.9]], [0.1, 0.2]), ([[1.0, -0.5], [0.3, 1.2]], [0.05, -0.1])]


def _dense_sql(xs: list[str], layer, act: bool) -> list[str]:
    out = ["(" + " + ".join(f"{x} * {w}" for x, w in zip(xs, ws, strict=True)) + f" + {b})" for ws, b in zip(*layer, strict=True)]
    return [f"greatest({x}, 0)" for x in out] if act else out


@query(
    "l7_pair_scores",
    f"""with t as (select id, l as position, 60 * vec[l * 2 + 1] as a, 60 * vec[l * 2 + 2] as b from {VECTORS_SQL}, range(6) b(l)), p as (select x.id, x.position as i, y.position as j, greatest(-4, least(4, x.a)) as f1, greatest(-4, least(4, x.b)) as f2, greatest(-4, least(4, y.a)) as f3, greatest(-4, least(4, y.b)) as f4 from t x join t y on x.id = y.id and x.position < y.position),
 h as (select id, i, j, {', '.join(f'{x} as h{k}' for k, x in enumerate(_dense_sql(['f1', 'f2', 'f3', 'f4'], SCORER[0], True)))} from p) select id, i::int as i, j::int as j, [{', '.join(f'round(greatest(-50, least(50, {x})), 6)' for x in _dense_sql(['h0', 'h1', 'h2'], SCORER[1], False))}] as scores from h""",
)
def pair_scores(spark, sf_dir):
    """A scorer over the vectors of both nodes, features clamped to 4 and scores to 50."""
    nodes = vectors(spark, sf_dir).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.transform(F.slice("vec", i * 2 + 1, F.lit(2)), lambda x: 60 * x))).alias("position", "vec"))
    return L.pair_scores(nodes, "id", SCORER, 4.0).select("id", "i", "j", F.transform("scores", lambda x: rounded(x, 6)).alias("scores"))


_nodes_sql = f"(select id, l as node, vec[l * 2 + 1] as a, vec[l * 2 + 2] as b from {VECTORS_SQL}, range(4) b(l))"
_edges_sql = f"(select id, x as src, y as dst, vec[20 + x * 4 + y] as r from {VECTORS_SQL}, range(4) p(x), range(4) q(y) where vec[20 + x * 4 + y] > 0)"


def _graph(spark, sf_dir):
    """Four nodes of two numbers a vector, and edges where other of its numbers are above 0, with these as relations."""
    v = vectors(spark, sf_dir)
    nodes = v.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vec", i * 2 + 1, F.lit(2)))).alias("node", "vec"))
    edges = v.select("id", F.posexplode(F.slice("vec", 20, 16)).alias("k", "r")).where("r > 0")
    return nodes, edges.select("id", F.floor(F.col("k") / 4).cast("int").alias("src"), (F.col("k") % 4).alias("dst"), F.array("r").alias("relation"))


def _round_sql(nodes: str, layers, how: str) -> str:
    inputs = ["u.a", "u.b", "v.a", "v.b"] + (["e.r"] if len(layers[0][0][0]) == 5 else [])
    sent = f"(select e.id, src as node, {', '.join(f'{x} as h{k}' for k, x in enumerate(_dense_sql(inputs, layers[0], True)))} from {_edges_sql} e join {nodes} u on u.id = e.id and u.node = src join {nodes} v on v.id = e.id and v.node = dst)"
    m = _dense_sql(["h0", "h1"], layers[1], False)
    by = "/ 4" if how == "mean" else ""
    got = f"(select id, node, sum({m[0]}) {by} as ma, sum({m[1]}) {by} as mb from {sent} group by 1, 2)"
    added = f"(select n.id, n.node, n.a + coalesce(ma, 0) as a, n.b + coalesce(mb, 0) as b from {nodes} n left join {got} g on g.id = n.id and g.node = n.node)"
    return f"(select id, node, (a - (a + b) / 2) / sqrt(pow((a - b) / 2, 2) + 1e-5) as a, (b - (a + b) / 2) / sqrt(pow((a - b) / 2, 2) + 1e-5) as b from {added})"


@query("l8_mean_messages", f"select id, node::int as node, [round(a, 5), round(b, 5)] as vec from {_round_sql(_round_sql(_nodes_sql, PAIR, 'mean'), PAIR2, 'mean')}")
def mean_messages(spark, sf_dir):
    """Two rounds of averaged messages over masked edges."""
    nodes, edges = _graph(spark, sf_dir)
    return L.message_passing(nodes, edges.drop("relation"), "id", [PAIR, PAIR2]).select("id", "node", F.transform("vec", lambda x: rounded(x, 5)).alias("vec"))


@query("l9_sum_messages", f"select id, node::int as node, [round(a, 5), round(b, 5)] as vec from {_round_sql(_nodes_sql, TRIPLE, 'sum')}")
def sum_messages(spark, sf_dir):
    """A round of summed messages that know the relation of their edge."""
    nodes, edges = _graph(spark, sf_dir)
    return L.message_passing(nodes, edges, "id", [TRIPLE], "sum").select("id", "node", F.transform("vec", lambda x: rounded(x, 5)).alias("vec"))


@query("l10_pair_index", "select a.n_nationkey as i, b.n_nationkey as j, (row_number() over (order by a.n_nationkey, b.n_nationkey) - 1)::int as place from nation a join nation b on a.n_nationkey < b.n_nationkey")
def pair_index(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("i")), nation.select(F.col("n_nationkey").alias("j"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", L.pair_index(F.col("i"), F.col("j"), 25).cast("int").alias("place"))


@query("l11_token_labels", "with s as (select o_orderkey as id, n, (o_orderkey % 5 + n)::int as first, (o_orderkey % 5 + n * 2 + 1)::int as last, least((o_orderkey + n) % 7, 5)::int as type from orders, range(3) t(n)) select id, p::int as position, arg_max(type, n) as type from s, unnest(range(first, last + 1)) u(p) where p < 8 group by all")
def token_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("n"))
    spans = rows.select("id", "n", (F.col("id") % 5 + F.col("n")).cast("int").alias("first"), (F.col("id") % 5 + F.col("n") * 2 + 1).cast("int").alias("last"), ((F.col("id") + F.col("n")) % 7).cast("int").alias("type"))
    return X.token_labels(spans, "id", 8, 6)


_label = "case when (id + position) % 5 = 0 then -100 else (id + position) % 4 end"


@query("l12_losses", f"with e as (select 0.5 * avg(-ln(greatest(p, 1e-12))) as loss from {CELLS_SQL} where class = {_label}), c as (select 2.0 * avg(-ln(greatest(p, 1e-12))) as loss from {CELLS_SQL} where position = 0 and class = id % 4) select part, round(loss, 6)::double as loss from (select 'entity' as part, loss from e union all select 'concept', loss from c union all select 'total', e.loss + c.loss from e, c)")
def losses(spark, sf_dir):
    """Weighted losses of tokens, some labels ignored, and of concepts; a part without labels is left out; and their sum."""
    c = cells(spark, sf_dir).select("id", "position", "class", "p")
    at = F.col("id") + F.col("position")
    labels = c.select("id", "position").distinct().withColumn("label", F.when(at % 5 == 0, L.IGNORED).otherwise(at % 4))
    concept = c.where("position = 0").select("id", "class", "p")
    parts = {"entity": L.mean_cross_entropy(c, labels, "id", "position"), "concept": L.mean_cross_entropy(concept, concept.select("id").distinct().withColumn("label", F.col("id") % 4), "id"), "lm": L.mean_cross_entropy(c, labels.withColumn("label", F.lit(L.IGNORED)), "id", "position")}
    return L.total_loss(parts, {"entity": 0.5, "concept": 2.0}).select("part", rounded("loss", 6).alias("loss"))


_rules_sql = "(select * from (values (1, 0, 1, 2, 1.0::double, 1), (2, 1, 1, 3, 0.5, -1), (3, 2, 3, 0, 2.0, 1)) r(rule_id, a, b, r, weight, polarity))"


@query(
    "r16_soft_logic_loss",
    f"""with t as (select id, position, class, p from {CELLS_SQL} where position < 4), l as (select id, position // 4 as i, position % 4 as j, class as relation, x from {CELLS_SQL}),
 s as (select rule_id, weight, polarity, l.id, sum(pa.p * pb.p * x) / greatest(sum(pa.p * pb.p), 1e-6) as x from l join {_rules_sql} r on relation = r join t pa on pa.id = l.id and pa.position = i and pa.class = a join t pb on pb.id = l.id and pb.position = j and pb.class = b group by all)
 select rule_id, round(avg((greatest(x, 0) - x * (polarity > 0)::int + ln(1 + exp(-abs(x)))) * weight), 6) as loss from s group by 1""",
)
def soft_logic_loss(spark, sf_dir):
    rules = spark.createDataFrame([(1, 0, 1, 2, 1.0, 1), (2, 1, 1, 3, 0.5, -1), (3, 2, 3, 0, 2.0, 1)], "rule_id int, a int, b int, r int, weight double, polarity int")
    c = cells(spark, sf_dir)
    return L.soft_logic_loss(rules, c.where("position < 4").select("id", "position", "class", "p"), _pairs(spark, sf_dir).select("id", "i", "j", "relation", "x"), "id").select("rule_id", rounded("loss", 6).alias("loss"))


@query("r18_symmetric_pairs", f"select id, i::int as i, j::int as j, type::int as type from {_rels} union all select id, j, i, type from {_rels}")
def symmetric_pairs(spark, sf_dir):
    found = X.relations(_pairs(spark, sf_dir), "id", 0.3)
    return L.symmetric(found, "id", "type").select("id", "i", "j", F.col("type").cast("int").alias("type"))


@query("x5_ewc_penalty", f"select round(0.4 * sum(abs(vec[1]) * pow(vec[2] - vec[3], 2)), 6) as penalty from {VECTORS_SQL}")
def ewc_penalty(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.abs(F.get("vec", F.lit(0))).alias("fisher"), F.get("vec", F.lit(1)).alias("now"), F.get("vec", F.lit(2)).alias("best"))
    return L.ewc_penalty(rows, 0.4).select(rounded("penalty", 6).alias("penalty"))


@query("x6_path_importance", f"select label as parameter, round(sum(-vec[1] * vec[2]) / (pow(sum(vec[2]), 2) + 0.1), 6) as omega from {VECTORS_SQL} group by 1")
def path_importance(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").alias("parameter"), F.get("vec", F.lit(0)).alias("gradient"), F.get("vec", F.lit(1)).alias("delta"))
    return L.path_importance(rows).select("parameter", rounded("omega", 6).alias("omega"))


_soft = lambda at, t: f"list_transform(range({at}, {at + 4}), lambda k: exp(vec[k] / {t}) / (exp(vec[{at}] / {t}) + exp(vec[{at + 1}] / {t}) + exp(vec[{at + 2}] / {t}) + exp(vec[{at + 3}] / {t})))"
_distilled = f"(select 0.5 * (4 * avg(list_sum(list_transform(range(1, 5), lambda k: p[k] * (ln(p[k]) - ln(q[k]))))) + sum(list_sum(list_transform(range(1, 5), lambda k: pow(c[k] - d[k], 2)))) / (4 * count(*))) as penalty from (select {_soft(1, 2.0)} as p, {_soft(5, 2.0)} as q, {_soft(9, 1.0)} as c, {_soft(13, 1.0)} as d from {VECTORS_SQL}))"


def _distillation(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.slice("vec", 1, 4).alias("t"), F.slice("vec", 5, 4).alias("s"), M.softmax(F.slice("vec", 9, 4)).alias("c"), M.softmax(F.slice("vec", 13, 4)).alias("d"))
    return L.distillation(rows, "t", "s", "c", "d")


@query("x7_distillation", f"select round(penalty, 6) as penalty from {_distilled}")
def distillation(spark, sf_dir):
    return _distillation(spark, sf_dir).select(rounded("penalty", 6).alias("penalty"))


@query("x8_combined_penalty", f"select round((select 0.4 * sum(abs(vec[1]) * pow(vec[2] - vec[3], 2)) from {VECTORS_SQL}) + (select 0.2 * sum(omega * pow(label, 2)) from (select label, sum(-vec[1] * vec[2]) / (pow(sum(vec[2]), 2) + 0.1) as omega from {VECTORS_SQL} group by 1)) + (select penalty from {_distilled}), 5) as penalty")
def combined_penalty(spark, sf_dir):
    """All three penalties, the second by the importance of what was passed."""
    rows = vectors(spark, sf_dir)
    at = lambda k: F.get("vec", F.lit(k))
    ewc = L.ewc_penalty(rows.select(F.abs(at(0)).alias("fisher"), at(1).alias("now"), at(2).alias("best")), 0.4)
    omega = L.path_importance(rows.select(F.col("label").alias("parameter"), at(0).alias("gradient"), at(1).alias("delta")))
    si = L.path_penalty(omega.select("omega", F.col("parameter").alias("now"), F.lit(0).alias("best")), 0.2)
    return L.combined_penalty(ewc=ewc, si=si, lwf=_distillation(spark, sf_dir), none=None).select(rounded("penalty", 5).alias("penalty"))
