"""Queries over content safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.operators import safety as S
from quernmill.plans.base import Book, lit, rounded
from quernmill.plans.conversion import pairs as instruction_pairs
from quernmill.plans.conversion import PAIRS_SQL
from quernmill.plans.rules import COSINE, VECTORS_SQL, vectors
from quernmill.operators.facade import SafetyConfig
from quernmill.session import shared_folder, table

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query

KEYWORDS = S.Keywords(allow=["licensed under"], block=["worthless", "Trash", "scum"], patterns={"violence": [r"\bmor\w+", "attack"], "privacy_violation": [r"@mail\d"]})
_any = lambda x, terms: "(" + " or ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"
_allowed = _any("lower(text)", ["licensed under"])
_blocked = "list_filter(['worthless', 'trash', 'scum'], lambda t: contains(lower(text), t))"
_v, _p = r"regexp_matches(text, '\bmor\w+', 'i') or regexp_matches(text, 'attack', 'i')", r"regexp_matches(text, '@mail\d', 'i')"
_category = f"case when {_allowed} then 'safe' when len({_blocked}) > 0 then 'unknown' when {_v} then 'violence' when {_p} then 'privacy_violation' else 'safe' end"
_group = f"({_any('lower(text)', S.GROUPS)} and {_any('lower(text)', S.SLURS)})"
_deceptive = f"regexp_matches(lower(text), {lit(S.DECEPTIVE)})"
_private = f"regexp_matches(text, {lit(S.PRIVATE)})"
#: A text's entities are its capitalised words.
ENTITIES = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '^\p{Lu}') and length(x) > 1)"
_low, _at = "lower(text)", "strpos(lower(text), lower(e))"
_insulted = f"({_at} > 0 and " + _any(f"substr({_low}, greatest({_at} - 50, 1), {_at} - greatest({_at} - 50, 1) + length(e) + 50)", S.INSULTS) + ")"
_person = _any("lower(e)", S.TITLES)
_attacks = f"(len(list_filter({ENTITIES}, lambda e: {_person} and {_insulted})) > 0)"


def docs(spark, sf_dir) -> DataFrame:
    """Documents with their capitalised words as entities."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", T.capitalised_words("text").alias("entities"))


_violations = f"list_filter([case when {_attacks} then 'no_personal_attacks' end, case when {_group} then 'no_group_denigration' end, case when {_deceptive} then 'no_deceptive_claims' end, case when {_private} then 'respect_privacy' end], lambda v: v is not null)"
_ethical_category = f"case when {_group} then 'hate_speech' when {_attacks} then 'harassment' when {_deceptive} then 'misinformation' when {_private} then 'privacy_violation' else 'safe' end"


@query("f1_keywords", f"select doc_id, ({_category}) = 'safe' as safe, {_category} as category, case when ({_category}) = 'unknown' then list_transform({_blocked}, lambda t: 'blocklist:' || t) when ({_category}) = 'safe' then [] else ['pattern:' || ({_category})] end as rules from documents")
def keywords(spark, sf_dir):
    return KEYWORDS.check(docs(spark, sf_dir)).select("doc_id", "safe", "category", "rules")


@query("f3_closest_harmful", f"select v.id, round(greatest(max({COSINE.format('v.vec', 'h.vec')}), 0.0), 6) as similarity from {VECTORS_SQL} v, (select * from {VECTORS_SQL} where label = 0) h where v.label <> 0 group by v.id")
def closest_harmful(spark, sf_dir):
    v = vectors(spark, sf_dir)
    harmful = v.where("label = 0").select("vec", F.concat(F.lit("c"), "label").alias("category"), F.col("id").alias("example"))
    return S.closest(v.where("label <> 0"), harmful, "id").select("id", rounded("similarity", 6).alias("similarity"))


@query("f4_harmful_examples", f"select vec_id as example, 'c' || label as category, len(embedding)::int as n from embeddings where label < 2")
def harmful_examples(spark, sf_dir):
    """Examples added in two goes and read back."""
    folder = shared_folder(spark)
    bank = vectors(spark, sf_dir).select(F.col("id").alias("example"), F.concat(F.lit("c"), "label").alias("category"), "vec", "label")
    S.add_harmful(spark, folder, bank.where("label = 0"))
    return S.add_harmful(spark, folder, bank.where("label = 1")).select("example", "category", F.size("vec").alias("n"))


@query("f5_constraints", f"select doc_id, {_attacks} as attacks, {_group} as denigrates, {_deceptive} as deceives, {_private} as exposes from documents")
def constraints(spark, sf_dir):
    return S.lowered(docs(spark, sf_dir)).select("doc_id", *[c.broken("text", "_low", "_names").alias(n) for c, n in zip(S.CONSTRAINTS, ("attacks", "denigrates", "deceives", "exposes"), strict=True)])


@query("f6_insulted", f"select doc_id, e as entity, {_person} as person, {_insulted} as insulted from (select doc_id, text, unnest(list_distinct({ENTITIES})) as e from documents)")
def insulted(spark, sf_dir):
    # texts without insults aren't copied to each of their entities
    rows = docs(spark, sf_dir).withColumn("low", F.lower("text"))
    rows = rows.select("doc_id", F.when(S.with_insults("low"), F.col("low")).otherwise("").alias("low"), F.explode(F.array_distinct("entities")).alias("entity"))
    return rows.select("doc_id", "entity", S.names_a_person(F.lower("entity")).alias("person"), S.insulted("low", F.lower("entity")).alias("insulted"))


@query("f10_ethical", f"select doc_id, len({_violations}) = 0 as safe, {_ethical_category} as category, {_violations} as rules from documents")
def ethical(spark, sf_dir):
    return S.ethical(docs(spark, sf_dir)).select("doc_id", "safe", "category", "rules")


@query("f11_own_constraint", "select doc_id, contains(text, '***') as broken from documents")
def own_constraint(spark, sf_dir):
    mine = S.Constraint("no_stars", "bias", lambda text, low, entities: F.contains(F.col(text), F.lit("***")))
    return S.ethical(docs(spark, sf_dir), [mine]).select("doc_id", (~F.col("safe")).alias("broken"))


_strict = f"""(select doc_id, text, {_category} as kw, {_ethical_category} as eth, {_violations} as broken from documents)"""


@query(
    "f13_verdicts",
    f"""select doc_id, kw = 'safe' and eth = 'safe' as is_safe, case when eth <> 'safe' then eth else kw end as category, case when kw <> 'safe' then 0.9 when eth <> 'safe' then 0.8 else 1.0 end::double as confidence,
 (case when kw <> 'safe' then 1 else 0 end + case when eth <> 'safe' then 1 else 0 end)::int as n_reasons from {_strict}""",
)
def verdicts(spark, sf_dir):
    rows = S.regulate(docs(spark, sf_dir), KEYWORDS, "high")
    return rows.select("doc_id", "verdict.is_safe", "verdict.category", "verdict.confidence", F.size("verdict.reasons").alias("n_reasons"))


_near = f"(select v.id as doc_id, greatest(max(sim), 0.0) as similarity, case when max(sim) > 0 then arg_max(cat, sim) else 'safe' end as nearest from (select v.id, {COSINE.format('v.vec', 'h.vec')} as sim, 'c' || h.label as cat from {VECTORS_SQL} v, (select * from {VECTORS_SQL} where label < 2) h where v.label >= 2) v group by v.id)"


@query(
    "f13_semantic_verdicts",
    f"""select doc_id, kw = 'safe' and not alike and eth = 'safe' as is_safe, case when eth <> 'safe' then eth when alike then nearest else kw end as category,
 round(case when kw = 'safe' and not alike and eth = 'safe' then 1.0 else greatest(case when kw <> 'safe' then 0.9 else 0 end, case when alike then similarity else 0 end, case when eth <> 'safe' then 0.8 else 0 end) end, 6)::double as confidence,
 (case when kw <> 'safe' then 1 else 0 end + alike::int + case when eth <> 'safe' then 1 else 0 end)::int as n_reasons from (select *, similarity >= 0.5 as alike from {_strict} join {_near} using (doc_id))""",
)
def semantic_verdicts(spark, sf_dir):
    """All three layers at the highest strictness: documents with the vector of their number, judged against two labels' vectors."""
    v = vectors(spark, sf_dir)
    harmful = v.where("label < 2").select("vec", F.concat(F.lit("c"), "label").alias("category"), F.col("id").alias("example"))
    near = S.closest(v.where("label >= 2").select(F.col("id").alias("doc_id"), "vec"), harmful, "doc_id")
    rows = S.regulate(docs(spark, sf_dir).join(near, "doc_id"), KEYWORDS, "maximum")
    return rows.select("doc_id", "verdict.is_safe", "verdict.category", rounded("verdict.confidence", 6).alias("confidence"), F.size("verdict.reasons").alias("n_reasons"))


@query("f17_configured", f"select category, count(*) as n, sum(is_safe::int)::bigint as safe from (select case when contains(lower(text), 'the') then 'unknown' when contains(text, '***') then 'bias' else 'safe' end as category, not contains(lower(text), 'the') and not contains(text, '***') as is_safe from documents) group by 1")
def configured(spark, sf_dir):
    """A configuration with a term and a constraint of its own, by its own check and statistics."""
    config = SafetyConfig(constraints=[])
    config.add_terms(["the"])
    config.add_constraint("no_stars", "bias", lambda text, low, entities: F.contains(F.col(text), F.lit("***")))
    found = config.statistics(docs(spark, sf_dir))
    passed = config.check_batch(docs(spark, sf_dir))[0].groupBy("verdict.category").agg(F.count(F.lit(1)).alias("passed"))
    return found.join(passed, "category", "left").select("category", "n", F.coalesce("passed", F.lit(0)).alias("safe"))


@query("f14_safe_rows", f"select doc_id, lang from (select *, {_category} as kw, {_ethical_category} as eth from documents) where kw = 'safe' and eth = 'safe'")
def safe_rows(spark, sf_dir):
    return S.split_safe(S.regulate(docs(spark, sf_dir), KEYWORDS, "medium"))[0].select("doc_id", "lang")


@query("f15_audit", f"select doc_id, left(sha256(text), 16) as text_hash, case when length(text) > 50 then left(text, 50) || '...' else text end as text_preview, 'batch' as source, kw = 'safe' and eth = 'safe' as is_safe from {_strict}")
def audit(spark, sf_dir):
    return S.audit(S.regulate(docs(spark, sf_dir), KEYWORDS), "batch").select("doc_id", "text_hash", "text_preview", "source", "verdict.is_safe")


@query("f16_audit_statistics", f"select category, count(*) as n, (select count(*) from documents) as total, (select count(*) from {_strict} where kw = 'safe' and eth = 'safe') as safe, round((select count(*) from {_strict} where kw = 'safe' and eth = 'safe') / (select count(*) from documents), 9) as safe_rate from (select case when kw <> 'safe' then kw else eth end as category from {_strict}) group by 1")
def audit_statistics(spark, sf_dir):
    return S.audit_statistics(S.audit(S.regulate(docs(spark, sf_dir), KEYWORDS), "batch")).withColumn("safe_rate", rounded("safe_rate", 9))


@query("f12_strictness", "select * from (values ('high', 0.6::double, true), ('low', 0.85, false), ('maximum', 0.5, true), ('medium', 0.7, false)) t(level, threshold, all_layers)")
def strictness(spark, sf_dir):
    return spark.createDataFrame([(k, *v) for k, v in S.STRICTNESS.items()], "level string, threshold double, all_layers boolean")


_flag = "(select conv_id, turn, instruction || chr(10) || response as text from " + PAIRS_SQL + " where instruction <> '' and response <> '')"


@query(
    "flagship_instruction_safety",
    f"select {_ethical_category} as category, count(*) as n, count(distinct conv_id) as conversations, sum(length(text))::bigint as chars from {_flag} group by 1",
)
def flagship(spark, sf_dir):
    """Instruction pairs, judged and counted by category."""
    rows = instruction_pairs(spark, sf_dir).where("instruction <> '' and response <> ''")
    rows = rows.select("conv_id", F.concat("instruction", F.lit("\n"), "response").alias("text"))
    rows = rows.withColumn("entities", T.capitalised_words("text"))
    judged = S.regulate(rows, strictness="high")
    return judged.groupBy("verdict.category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))
