"""Queries over the conversion of texts and relations to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.operators import conversion as C
from quernmill.operators import stages
from quernmill.session import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_starter = f"'^(?:{'|'.join(T.STARTERS)}) '"
_any = lambda x, terms: "(" + " or ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"
_question_sql = f"""case when s = '' then s
 when regexp_matches(s, {_starter}) then case when ends_with(s, '?') then s else regexp_replace(s, '\\.+$', '') || '?' end
 when regexp_matches(b, '^(?:The|A|An) ') and contains(b, ' is ') then 'Is ' || split_part(b, ' is ', 1) || ' ' || substr(b, strpos(b, ' is ') + 4) || '?'
 when regexp_matches(b, '^(?:The|A|An) ') and {_any('b', T.PAST)} then 'Did ' || lower(b) || '?'
 when regexp_matches(b, '^(?:The|A|An) ') and {_any('b', T.PRESENT)} then 'Does ' || lower(b) || '?'
 when regexp_matches(b, '^(?:The|A|An) ') then 'Did ' || lower(b) || '?'
 when regexp_matches(b, '^\\p{{Lu}}') and contains(b, ' is ') then 'Is ' || split_part(b, ' is ', 1) || ' ' || substr(b, strpos(b, ' is ') + 4) || '?'
 when {_any('b', T.PAST)} then 'Did ' || lower(b) || '?' else 'Does ' || lower(b) || '?' end"""
_stripped = f"(select *, {STRIP.format('text')} as s, case when ends_with({STRIP.format('text')}, '.') then left({STRIP.format('text')}, length({STRIP.format('text')}) - 1) else {STRIP.format('text')} end as b from {{0}})"
_is_question_sql = f"(regexp_matches(s, {_starter}) or ends_with(s, '?'))"
_clean = r"regexp_replace(regexp_replace(regexp_extract(p, '[^.?! ] (\p{{Lu}}[^ ].*)$', 1), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '^\s+|\s+$', '', 'g')".replace("{{", "{").replace("}}", "}")
#: Names by windows over words, not by splitting: the oracle goes another way than the operator.
NAMES_SQL = r"""with w as (select {id}, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as word, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) as pos from {src}),
 f as (select *, regexp_matches(word, '^\p{Lu}') as cap, lag(word) over (partition by {id} order by pos) as prev from w),
 g as (select *, sum(case when cap then 0 else 1 end) over (partition by {id} order by pos) as run, cap and pos > 1 and not regexp_matches(prev, '[.?!]$') and length(word) > 1 as fit from f),
 h as (select *, min(case when fit then pos end) over (partition by {id}, run) as begin_pos from g where cap),
 j as (select {id}, begin_pos, regexp_replace(regexp_replace(string_agg(word, ' ' order by pos), '[^\p{L}\p{N}_\s]', '', 'g'), '^\s+|\s+$', '', 'g') as name from h where pos >= begin_pos group by {id}, run, begin_pos),
 k as (select {id}, name, min(begin_pos) as first_pos from j where length(name) > 1 group by {id}, name),
 l as (select *, row_number() over (partition by {id} order by first_pos) as place from k)
 select {id}, list(name order by place) as names from l where place <= 20 group by {id}"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as samples: text, a few entities, and whether to respond."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("p3_is_question", f"select conv_id, turn, {_is_question_sql} as is_question from {_stripped.format('conversations')}")
def is_question(spark, sf_dir):
    return sentences(spark, sf_dir).select("conv_id", "turn", T.is_question("text").alias("is_question"))


@query("p4_statement_to_question", f"select conv_id, turn, {_question_sql} as question from {_stripped.format('conversations')} union all select -1 - doc_id, -1, {_question_sql} from {_stripped.format('documents')}")
def statement_to_question(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text")
    return sentences(spark, sf_dir).select("conv_id", "turn", "text").unionByName(docs).select("conv_id", "turn", T.statement_to_question("text").alias("question"))


@query("p6_affirmation", r"select conv_id, turn, 'Yes, ' || regexp_replace(lower(text), '\.+$', '') || '.' as response from conversations")
def affirmation(spark, sf_dir):
    return sentences(spark, sf_dir).select("conv_id", "turn", T.affirmation("text").alias("response"))


EXPANDED_SQL = f"""with c as (select *, case when role = 'user' then 1 else 0 end as r from {_stripped.format('conversations')}),
 e as (select *, r = 1 and not {_is_question_sql} as split from c)
 select conv_id, turn, 'statement' as form, text, 0 as should_respond, null::varchar as response from e where split
 union all select conv_id, turn, 'question', {_question_sql}, 1, 'Yes, ' || regexp_replace(lower(text), '\\.+$', '') || '.' from e where split
 union all select conv_id, turn, 'as_is', text, r, null from e where not split"""


def _samples(spark, sf_dir) -> DataFrame:
    """Turns as samples without entities."""
    return sentences(spark, sf_dir).select("conv_id", "turn", "text", F.array().cast("array<string>").alias("entities"), F.array().cast(C.SPANS).alias("entity_spans"), F.when(F.col("role") == "user", 1).otherwise(0).alias("should_respond"), F.lit(None).cast("string").alias("response"))


@query("p7_expand_entries", EXPANDED_SQL)
def expand_entries(spark, sf_dir):
    return C.expand_entries(_samples(spark, sf_dir)).select("conv_id", "turn", "form", "text", "should_respond", "response")


@query("p5_recalculated_spans")
def recalculated_spans(spark, sf_dir):
    """The spans, in its question, of each name of a turn."""
    rows = sentences(spark, sf_dir).select("conv_id", "turn", T.statement_to_question("text").alias("question"), T.capitalised_words("text").alias("entities"), F.array().cast(C.SPANS).alias("original"))
    return rows.select("conv_id", "turn", F.posexplode(T.recalculated_spans("question", "entities", "original")).alias("place", "span")).select("conv_id", "turn", "place", "span.start", "span.end")


@query("p2_normal_concepts", "select p_partkey, [[p_type], [p_brand, p_type]] as concepts from part")
def normal_concepts(spark, sf_dir):
    mixed = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_type"), F.to_json(F.array("p_brand", "p_type"))).alias("c"))
    return mixed.select("p_partkey", C.normal_concepts("c").alias("concepts"))


@query("p13_names_documents", NAMES_SQL.replace("{id}", "doc_id").replace("{src}", "documents"))
def names_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.capitalised_runs("text").alias("names"))
    return rows.where("size(names) > 0")


def _documents(spark, sf_dir):
    """Document-relation rows from the star schema: a nation, its region and its first supplier."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    mention = lambda name, kind: F.array(F.struct(F.col(name).alias("name"), F.lit(kind).alias("type")))
    rel = lambda h, t, r: F.struct(F.lit(h).alias("h"), F.lit(t).alias("t"), F.lit(r).alias("r"))
    return (
        nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(F.broadcast(supplier), F.col("n_nationkey") == F.col("s_nationkey"))
        .select(
            F.col("n_name").alias("title"),
            F.array(F.array("n_name", F.lit("lies"), F.lit("in"), "r_name"), F.array("s_name", F.lit("sells"))).alias("sents"),
            F.array(mention("n_name", "LOC"), mention("r_name", "LOC"), mention("s_name", "ORG"), F.array(F.struct(F.lit("x").alias("name"), F.lit("ODD").alias("type")))).alias("vertexSet"),
            F.array(rel(0, 1, "P30"), rel(2, 0, "P17"), rel(2, 0, "P159"), rel(0, 2, "P999"), rel(2, 1, "P276"), rel(0, 1, "P131")).alias("labels"),
        )
    )


_docs_sql = "(select n_name, r_name, (select min(s_name) from supplier where s_nationkey = n_nationkey) as s_name from nation join region on n_regionkey = r_regionkey) where s_name is not null"


@query(
    "p8_document_relations",
    "select n_name as title, n_name || ' lies in ' || r_name || ' ' || s_name || ' sells' as text, [n_name, r_name, s_name, 'x'] as entities, [['location'], ['location'], ['organization'], ['object']] as concepts, ['continent', 'country', 'headquarters_location', 'P999', 'location', 'located_in_admin_territory'] as rels from " + _docs_sql,
)
def document_relations(spark, sf_dir):
    return C.document_relations(_documents(spark, sf_dir)).select("title", "text", "entities", "concepts", F.transform("relations", lambda r: r["rel"]).alias("rels"))


@query(
    "p9_relation_questions",
    f"""with d as (select * from {_docs_sql})
 select n_name as title, 0 as place, 'country' as relation, 'What country is ' || s_name || ' in?' as question, s_name || ' is in ' || n_name || '.' as answer from d
 union all select n_name, 1, 'headquarters_location', 'Where is the headquarters of ' || s_name || '?', 'The headquarters of ' || s_name || ' is in ' || n_name || '.' from d
 union all select n_name, 2, 'location', 'Where is ' || s_name || ' located?', s_name || ' is located at ' || r_name || '.' from d""",
)
def relation_questions(spark, sf_dir):
    return C.relation_questions(C.document_relations(_documents(spark, sf_dir)))


@query(
    "p10_graph_questions",
    """with a as (select n_regionkey, list(n_name order by n_name) as answers, list(n_name order by n_name) || [min(n_name)] as twice from nation group by 1),
 q as (select r_regionkey as qid, 'Which nations lie in ' || r_name || '?' as text, [r_name] || twice as entities, twice as answers from region join a on r_regionkey = n_regionkey)
 select qid, text, entities, [[case when i = 1 then 'region' else 'nation' end] for i in range(1, len(entities) + 1)] as concepts,
 array_to_string(answers[:-2], ', ') || ' and ' || answers[-1] as response, (len(entities) - 1)::int as n_relations from q""",
)
def graph_questions(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lists = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l")).withColumn("answers", F.concat("l", F.slice("l", 1, 1)))
    asked = region.join(lists, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("Which nations lie in "), "r_name", F.lit("?")).alias("question"), "answers", F.array("r_name").alias("entities"))
    triples = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("located_in").alias("relation"), F.col("r_name").alias("object"), F.col("n_nationkey").alias("position"))
    kinds = nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.lit(1).alias("rank")).unionByName(region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(0).alias("rank")))
    return C.graph_questions(asked, triples, kinds).select("qid", "text", "entities", "concepts", "response", F.size("relations").alias("n_relations"))


@query(
    "p11_first_relation",
    "select c_custkey, arg_min(o_orderpriority, o_orderkey) as relation from customer left join orders on c_custkey = o_custkey group by 1",
)
def first_relation(spark, sf_dir):
    triples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.lit(1).alias("object"), F.col("o_orderpriority").alias("relation"), F.col("o_orderkey").alias("position"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.lit(1).alias("object"))
    return C.find_relations(asked, triples).select(F.col("subject").alias("c_custkey"), "relation")


def pairs(spark, sf_dir) -> DataFrame:
    """Instruction rows: each user turn with the assistant turn that follows it."""
    from pyspark.sql import Window

    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("instruction"), F.lead("text").over(turns).alias("response"), F.lead("role").over(turns).alias("next_role"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "instruction", "response", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")).alias("context"))


PAIRS_SQL = "(select * from (select conv_id, turn, role, text as instruction, lead(text) over w as response, lead(role) over w as next_role, case when turn % 2 = 0 then '' else role end as context from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant')"


@query(
    "p12_instructions",
    f"select conv_id, turn, instruction || case when context <> '' and context <> instruction then chr(10) || chr(10) || 'Context: ' || context else '' end as text, response, 'instruction' as source, 'general' as category from {PAIRS_SQL} where instruction <> '' and response <> ''",
)
def instructions(spark, sf_dir):
    return C.instructions(pairs(spark, sf_dir))


@query("p18_instruction_pairs", f"select conv_id, turn, instruction, response, nullif(context, '') as context from {PAIRS_SQL} where instruction <> '' and response <> ''")
def instruction_pairs(spark, sf_dir):
    return stages.instruction_projection(pairs(spark, sf_dir)).select("conv_id", "turn", "instruction", "response", "context")


def _markup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    markup = F.concat(F.lit("<triplet> "), "s_name", F.lit(" <subj> based in <obj> "), "n_name", F.lit(" <triplet> "), "n_name", F.lit(" <subj> part of <obj> "), "r_name", F.lit("<triplet> broken <subj> x"), F.lit("<triplet>  <subj> y <obj> z"))
    return rows.select("s_suppkey", F.concat(F.lower("n_name"), F.lit(" hosts "), "s_name").alias("context"), markup.alias("triplets"), "s_name", "n_name", "r_name")


_markup_sql = "supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query(
    "p14_parse_triplets",
    f"select s_suppkey, s_name as subject, 'based in' as relation, n_name as object from {_markup_sql} union all select s_suppkey, n_name, 'part of', r_name from {_markup_sql}",
)
def parse_triplets(spark, sf_dir):
    return _markup(spark, sf_dir).select("s_suppkey", F.explode(C.parse_triplets("triplets")).alias("t")).select("s_suppkey", "t.*")


@query(
    "p16_triplet_samples",
    f"""select s_suppkey, lower(n_name) || ' hosts ' || s_name as text, [s_name, n_name, r_name] as entities, ['entity', 'entity', 'entity'] as entity_types,
 [(length(n_name) + 7)::int, 0, 0] as starts, [(length(n_name) + 7 + length(s_name))::int, length(n_name)::int, least(length(r_name), length(n_name) + 7 + length(s_name))::int] as ends, [0, 1] as heads, [1, 2] as tails from {_markup_sql}""",
)
def triplet_samples(spark, sf_dir):
    rows = C.triplet_samples(_markup(spark, sf_dir).drop("s_name", "n_name", "r_name"))
    pick = lambda c, f: F.transform(c, lambda x: x[f])
    return rows.select("s_suppkey", "text", "entities", "entity_types", pick("entity_spans", "start").alias("starts"), pick("entity_spans", "end").alias("ends"), pick("relations", "head").alias("heads"), pick("relations", "tail").alias("tails"))


@query(
    "p15_find_span",
    "select doc_id, case when strpos(lower(text), source) > 0 then strpos(lower(text), source) - 1 else 0 end as span_start, case when strpos(lower(text), source) > 0 then strpos(lower(text), source) - 1 + length(source) else least(length(source), length(text)) end as span_end from documents",
)
def find_span(spark, sf_dir):
    span = T.find_span("text", "source")
    return table(spark, sf_dir, "documents").select("doc_id", span["start"].cast("long").alias("span_start"), span["end"].cast("long").alias("span_end"))


@query("p17_entity_samples", "select p_partkey, p_name as text, [p_brand, p_type] as entities, [['brand'], ['type']] as concepts from part")
def entity_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.array("p_brand", "p_type").alias("entities"), F.array(F.lit("brand"), F.lit("type")).alias("entity_types"))
    return stages.entity_projection(rows)


@query(
    "p19_mentioned_names",
    r"select conv_id, turn, list_filter(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: regexp_matches(x, '^\p{Lu}') and length(x) > 1) as names, list_filter(['The', 'of', 'zz'], lambda x: contains(lower(text), lower(x))) as listed from conversations",
)
def mentioned_names(spark, sf_dir):
    return sentences(spark, sf_dir).select("conv_id", "turn", T.capitalised_words("text").alias("names"), T.mentioned("text", F.array(F.lit("The"), F.lit("of"), F.lit("zz"))).alias("listed"))


@query(
    "p20_normal_name",
    r"select p_partkey, replace(replace(replace(regexp_replace(lower('  The ' || p_name || ' of an ' || p_type || ' a B '), '^\s+|\s+$', '', 'g'), 'the ', ''), ' a ', ' '), ' an ', ' ') as name from part",
)
def normal_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_name(F.concat(F.lit("  The "), "p_name", F.lit(" of an "), "p_type", F.lit(" a B "))).alias("name"))


@query("p22_needs_labels", "select p_partkey, p_size % 2 = 0 or p_size % 3 = 0 as needs from part")
def needs_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 != 0, F.array("p_name")).alias("entities"), F.when(F.col("p_size") % 3 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("entity_type_labels"))
    return rows.select("p_partkey", C.needs_labels().alias("needs"))


@query("p23_responding", r"select conv_id, turn, text as response from conversations where role = 'assistant' and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def responding(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("conv_id", "turn", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("should_respond"), F.col("text").alias("response"))
    return rows.where(C.responds()).select("conv_id", "turn", "response")


@query("p24_preview", "select doc_id, case when length(text) > 50 then left(text, 50) || '...' else text end as preview, left(text, 100) as example from documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"), F.substring("text", 1, 100).alias("example"))


@query("p1_sample_json", """select p_partkey, '{"text":"' || p_name || '","entities":["' || p_brand || '"]' || case when p_size % 2 = 0 then ',"response":"' || p_type || '"' else '' end || '}' as sample from part""")
def sample_json(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.array("p_brand").alias("entities"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("response"), F.array().cast("array<string>").alias("spans"))
    return rows.select("p_partkey", C.sample_json(rows, ["text", "entities"], ["response", "spans"]).alias("sample"))


@query("p26_decoder_targets", "select l_orderkey, l_linenumber, case when l_returnflag = 'R' then [l_partkey::int, l_suppkey::int, 1, -100] else [1, -100, -100, -100] end as targets from lineitem")
def decoder_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", C.decoder_targets(F.array(F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")), F.when(F.col("l_returnflag") == "R", 1).otherwise(0), 4).alias("targets"))
