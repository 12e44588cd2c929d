"""Queries over metrics, uncertainty, run logs and replay memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.operators import facade as Z
from quernmill.operators import memory as Y
from quernmill.operators import metrics as M
from quernmill.plans.base import Book, rounded
from quernmill.plans.conversion import PAIRS_SQL
from quernmill.plans.conversion import pairs as instruction_pairs
from quernmill.plans.rules import VECTORS_SQL, vectors
from quernmill.session import table

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query

_tokens = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"
_bleu = f"""with p as (select conv_id, turn, {_tokens.format('response')} as r, {_tokens.format('instruction')} as h from {PAIRS_SQL}),
 g as (select conv_id, turn, n, 0 as side, array_to_string(r[i:i + n - 1], chr(1)) as gram from p, range(1, 5) t(n), unnest(range(1, greatest(len(r) - n + 2, 1))) u(i) union all select conv_id, turn, n, 1, array_to_string(h[i:i + n - 1], chr(1)) from p, range(1, 5) t(n), unnest(range(1, greatest(len(h) - n + 2, 1))) u(i)),
 c as (select conv_id, turn, n, gram, count(*) filter (side = 0) as a, count(*) filter (side = 1) as b from g group by all),
 q as (select conv_id, turn, n, sum(least(a, b)) / nullif(sum(b), 0) as pr from c group by all),
 s as (select conv_id, turn, count(*) filter (pr > 0) as k, exp(avg(ln(case when pr > 0 then pr end))) as gm from q group by all)
 select conv_id, turn, round(case when k = 4 and len(h) > 0 then least(1.0, exp(1 - len(r) / len(h))) * gm else 0 end, 6)::double as bleu from p left join s using (conv_id, turn)"""


def _scored(spark, sf_dir) -> DataFrame:
    return M.bleu(instruction_pairs(spark, sf_dir), "response", "instruction")


@query("v1_bleu", _bleu)
def bleu(spark, sf_dir):
    return _scored(spark, sf_dir).select("conv_id", "turn", rounded("bleu", 6).alias("bleu"))


@query("v2_ngrams", f"select conv_id, turn, len(t) as tokens, greatest(len(t) - 1, 0)::bigint as bigrams, (select count(distinct t[i] || chr(1) || t[i + 1]) from unnest(range(1, greatest(len(t), 1))) u(i)) as distinct_bigrams from (select conv_id, turn, {_tokens.format('text')} as t from conversations)")
def ngrams(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.lower("text")).alias("t"))
    b = M.ngrams("t", 2)
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("tokens"), F.size(b).cast("long").alias("bigrams"), F.size(F.array_distinct(b)).cast("long").alias("distinct_bigrams"))


_sets = "list_distinct(list_transform(list_filter(string_split({0}, ' '), lambda x: x <> ''), lambda x: trim(lower(x))))"


@query(
    "v3_entity_f1",
    f"with p as (select conv_id, turn, {_sets.format('response')} as r, {_sets.format('instruction')} as h from {PAIRS_SQL}), q as (select *, len(list_intersect(r, h)) as k from p) select conv_id, turn, round(k / len(h), 9) as precision, round(k / len(r), 9) as recall, round(2.0::double * k / (len(r) + len(h)), 9) as f1 from q where len(r) > 0 and len(h) > 0",
)
def entity_f1(spark, sf_dir):
    names = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = instruction_pairs(spark, sf_dir).select("conv_id", "turn", names("response").alias("r"), names("instruction").alias("h")).where("size(r) > 0 and size(h) > 0")
    return rows.select("conv_id", "turn", M.entity_f1("r", "h").alias("f")).select("conv_id", "turn", *[rounded(f"f.{c}", 9).alias(c) for c in ("precision", "recall", "f1")])


def _samples(spark, sf_dir) -> DataFrame:
    """Instruction pairs as samples: what was generated is the instruction, for every fifth nothing; entities are the response's capitalised words."""
    rows = instruction_pairs(spark, sf_dir).withColumn("side", F.when(F.col("conv_id") % 4 == 0, "eval").otherwise("train"))
    generated = F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("instruction"))
    return rows.select("conv_id", "turn", "side", F.lit(1).alias("should_respond"), "response", T.capitalised_words("response").alias("entities"), generated.alias("generated"))


_names = r"list_filter(regexp_split_to_array(response, '\s+'), lambda x: regexp_matches(x, '^\p{Lu}') and length(x) > 1)"
_evaluated = f"""with s as (select conv_id, turn, case when conv_id % 4 = 0 then 'eval' else 'train' end as side, conv_id % 5 = 0 as silent, instruction, {_names} as names from {PAIRS_SQL} where regexp_replace(response, '^\\s+|\\s+$', '', 'g') <> ''),
 b as ({_bleu}), t as (select s.*, bleu, list_distinct(list_transform(names, lambda x: trim(lower(x)))) as r, list_distinct(list_transform(list_filter(names, lambda x: contains(lower(instruction), lower(x))), lambda x: trim(lower(x)))) as p from s join b using (conv_id, turn)),
 u as (select *, case when silent then null when len(r) = 0 and len(p) = 0 then 1.0 when len(r) = 0 or len(p) = 0 then 0.0 else 2.0::double * len(list_intersect(r, p)) / (len(r) + len(p)) end::double as f1, case when not silent then bleu end as score from t)"""


@query("v4_evaluated", f"{_evaluated} select conv_id, turn, score as bleu, round(f1, 6) as f1 from u order by conv_id, turn limit 200")
def evaluated(spark, sf_dir):
    rows = M.evaluate(_samples(spark, sf_dir), "conv_id", "turn", most=200)
    return rows.select("conv_id", "turn", rounded("bleu", 6).alias("bleu"), rounded("entity.f1", 6).alias("f1"))


@query("v5_mean_metrics", f"{_evaluated} select side, count(*) as n, round(avg(score), 5) as avg_bleu, round(avg(f1), 6) as avg_f1 from u group by 1")
def mean_metrics(spark, sf_dir):
    means = M.mean_metrics(M.evaluate(_samples(spark, sf_dir)), "side")
    return means.select("side", "n", rounded("avg_bleu", 5).alias("avg_bleu"), rounded("avg_f1", 6).alias("avg_f1"))


@query("v6_train_against_eval", f"{_evaluated}, m as (select avg(score) filter (side = 'train') as bt, avg(score) filter (side = 'eval') as be, avg(f1) filter (side = 'train') as ft, avg(f1) filter (side = 'eval') as fe from u) select metric, round(train, 5) as train, round(eval, 5) as eval, round(difference, 5) as difference from (select 'avg_bleu' as metric, coalesce(bt, 0) as train, coalesce(be, 0) as eval, coalesce(be, 0) - coalesce(bt, 0) as difference from m union all select 'avg_f1', coalesce(ft, 0), coalesce(fe, 0), coalesce(fe, 0) - coalesce(ft, 0) from m)")
def train_against_eval(spark, sf_dir):
    found = M.compared(M.mean_metrics(M.evaluate(_samples(spark, sf_dir)), "side"))
    return found.select("metric", *[rounded(c, 5).alias(c) for c in ("train", "eval", "difference")])


@query("v8_report", f"{_evaluated} select count(*) as n, round(avg(score), 5) as bleu from u")
def report(spark, sf_dir):
    """The report's means, beside its first results."""
    rows = M.evaluate(_samples(spark, sf_dir))
    *first, last = Z.report(rows.select("response", "generated", "bleu"))
    return spark.createDataFrame([(rows.count(), round(last["means"]["bleu"], 5))], "n long, bleu double") if len(first) <= 3 else None


@query(
    "v7_early_stopping",
    """with recursive e as (select user_id, value, row_number() over (partition by user_id order by event_id) as i from events),
 f as (select user_id, i, value as best, 0 as waited, null::int as stopped_at from e where i = 1
  union all select e.user_id, e.i, case when value < best then value else best end, case when value < best then 0 else waited + 1 end, case when value >= best and waited + 1 >= 3 then e.i end from f join e on e.user_id = f.user_id and e.i = f.i + 1 where stopped_at is null)
 select user_id, arg_max(best, i) as best, arg_max(waited, i)::int as waited, max(stopped_at)::int as stopped_at from f group by 1""",
)
def early_stopping(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("scores"))
    return runs.select("user_id", M.early_stop("scores", 3).alias("s")).select("user_id", "s.*")


@query("s20_kept_checkpoints", "with b as (select user_id, event_id, value, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events) select user_id, event_id, value from (select * from b where before is null or value < before) qualify row_number() over (partition by user_id order by event_id desc) <= 2")
def kept_checkpoints(spark, sf_dir):
    return M.kept_checkpoints(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", "value", 2, run="user_id")


#: Four passes over four positions of four classes, from a vector's 64 numbers.
_passes = f"(select id, s as pass, l as position, k as class, exp(2 * vec[s * 16 + l * 4 + k + 1]) / (exp(2 * vec[s * 16 + l * 4 + 1]) + exp(2 * vec[s * 16 + l * 4 + 2]) + exp(2 * vec[s * 16 + l * 4 + 3]) + exp(2 * vec[s * 16 + l * 4 + 4])) as p from {VECTORS_SQL}, range(4) a(s), range(4) b(l), range(4) c(k))"


def passes(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    rows = v.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: M.softmax(F.transform(F.slice("vec", i * 4 + 1, F.lit(4)), lambda x: 2 * x)))).alias("cell", "ps"))
    rows = rows.select("id", F.floor(F.col("cell") / 4).alias("pass"), (F.col("cell") % 4).alias("position"), F.posexplode("ps").alias("class", "p"))
    return rows


_mc = f"(select id, avg(v) as variance, avg(t) as entropy, avg(a) as aleatoric, avg(t) - avg(a) as epistemic from (select id, position, avg(v) as v, sum(-m * ln(m + 1e-10)) as t, sum(h) as a from (select id, position, class, avg(p) as m, var_samp(p) as v, avg(-p * ln(p + 1e-10)) as h from {_passes} group by all) group by 1, 2) group by 1)"
_round6 = lambda *c: ", ".join(f"round({x}, 6) as {x}" for x in c)


@query("u1_monte_carlo", f"select id, {_round6('variance', 'entropy', 'aleatoric', 'epistemic')}, round(0.4 * epistemic + 0.3 * variance + 0.2 * variance + 0.1 * variance, 6) as overall from {_mc}")
def monte_carlo(spark, sf_dir):
    rows = M.monte_carlo(passes(spark, sf_dir), "id", "position", "class", "p")
    v = F.col("variance")
    return rows.select("id", *[rounded(c, 6).alias(c) for c in ("variance", "entropy", "aleatoric", "epistemic")], rounded(M.overall(F.col("epistemic"), v, v, v), 6).alias("overall"))


@query("u2_entropy", f"select id, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))), 6) as entropy from (select id, list_transform(e, lambda x: x / list_sum(e)) as p from (select id, list_transform(vec, lambda x: exp(x - list_max(vec))) as e from {VECTORS_SQL}))")
def entropy(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", M.softmax("vec").alias("p")).select("id", rounded(M.entropy("p"), 6).alias("entropy"))


#: Passes from vectors: read backwards they stand for concepts, rotated for relations, and scaled for those of an ensemble.


def _passes_of(spark, sf_dir, scale: float = 2.0, backwards: bool = False, shift: int = 0) -> DataFrame:
    vec = F.reverse("vec") if backwards else F.col("vec")
    vec = F.concat(F.slice(vec, shift + 1, 64), F.slice(vec, 1, shift)) if shift else vec
    rows = vectors(spark, sf_dir).select("id", vec.alias("vec")).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: M.softmax(F.transform(F.slice("vec", i * 4 + 1, F.lit(4)), lambda x: scale * x)))).alias("cell", "ps"))
    return rows.select("id", F.floor(F.col("cell") / 4).alias("pass"), (F.col("cell") % 4).alias("position"), F.posexplode("ps").alias("class", "p"))


def _passes_sql(scale: float = 2.0, backwards: bool = False, shift: int = 0) -> str:
    vec = "list_reverse(vec)" if backwards else "vec"
    vec = f"list_concat({vec}[{shift + 1}:64], {vec}[1:{shift}])" if shift else vec
    e = lambda k: f"exp({scale} * vec[s * 16 + l * 4 + {k}])"
    return f"(select id, s as pass, l as position, k as class, {e('k + 1')} / ({e('1')} + {e('2')} + {e('3')} + {e('4')}) as p from (select id, {vec} as vec from {VECTORS_SQL}), range(4) a(s), range(4) b(l), range(4) c(k))"


def _stats_sql(passes: str) -> str:
    return f"(select id, avg(v) as variance, avg(t) as entropy, avg(a) as aleatoric, avg(t) - avg(a) as epistemic from (select id, position, avg(v) as v, sum(-m * ln(m + 1e-10)) as t, sum(h) as a from (select id, position, class, avg(p) as m, var_samp(p) as v, avg(-p * ln(p + 1e-10)) as h from {passes} group by all) group by 1, 2) group by 1)"


_one = f"(select e.id, e.entropy, e.epistemic, e.aleatoric, e.variance as entity, c.variance as concept, r.variance as relation, 0.4 * e.epistemic + 0.3 * e.variance + 0.2 * c.variance + 0.1 * r.variance as overall from {_stats_sql(_passes_sql())} e join {_stats_sql(_passes_sql(backwards=True))} c using (id) join {_stats_sql(_passes_sql(shift=8))} r using (id))"
_two = f"(select e.id, e.entropy, e.variance as epistemic, 0.0::double as aleatoric, e.variance as entity, c.variance as concept, 0.0::double as relation, e.variance as overall from {_stats_sql(_passes_sql(4.0))} e join {_stats_sql(_passes_sql(4.0, True))} c using (id))"


def _estimated(spark, sf_dir, method: str, with_ensemble: bool = True) -> DataFrame:
    dropout = {"entities": _passes_of(spark, sf_dir), "concepts": _passes_of(spark, sf_dir, backwards=True), "relations": _passes_of(spark, sf_dir, shift=8)}
    ensemble = {"entities": _passes_of(spark, sf_dir, 4.0), "concepts": _passes_of(spark, sf_dir, 4.0, True)}
    rows = M.estimate(method, dropout, ensemble if with_ensemble else None, "id")
    return rows.select("id", *[rounded(c, 6).alias(c) for c in M.ESTIMATE])


_all6 = _round6(*M.ESTIMATE)


@query("u3_ensemble", f"select id, {_all6} from {_two}")
def ensemble(spark, sf_dir):
    return _estimated(spark, sf_dir, "ensemble")


@query("u4_combined", f"select a.id, {', '.join(f'round(a.{c}, 6) as {c}' if c in ('aleatoric', 'relation') else f'round((a.{c} + b.{c}) / 2, 6) as {c}' for c in M.ESTIMATE)} from {_one} a join {_two} b using (id)")
def combined(spark, sf_dir):
    return _estimated(spark, sf_dir, "combined")


@query("u4_without_ensemble", f"select id, {_all6} from {_one}")
def without_ensemble(spark, sf_dir):
    """What is asked of an ensemble that isn't there is estimated by dropout."""
    return _estimated(spark, sf_dir, "combined", False)


@query("u5_ranked_samples", f"select id, round(entropy, 6) as entropy, row_number() over (order by round(entropy, 6) desc, id)::int as place from {_mc}")
def ranked_samples(spark, sf_dir):
    from quernmill.operators.vocabulary import ranked

    rows = M.monte_carlo(passes(spark, sf_dir), "id", "position", "class", "p").select("id", rounded("entropy", 6).alias("entropy"))
    return ranked(rows, F.col("entropy").desc(), F.col("id"), name="place").select("id", "entropy", F.col("place").cast("int").alias("place"))


@query("u6_uncertain", "select event_id, value > 0.5 as uncertain from events")
def uncertain(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.uncertain("value").alias("uncertain"))


def _entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("concept"), F.col("value").alias("uncertainty"), (F.col("value") + 1).alias("importance"))


_entries_sql = "(select event_id, ts, event_type as concept, value as uncertainty, value + 1 as importance from events)"


@query("m2_reservoir", f"select event_id, concept from {_entries_sql} order by {T.order_key_sql('event_id', seed='reservoir')}, event_id limit 1000")
def reservoir(spark, sf_dir):
    return Y.reservoir(_entries(spark, sf_dir), 1000, "event_id").select("event_id", "concept")


@query("m3_most_uncertain", f"select event_id, uncertainty from {_entries_sql} order by uncertainty desc, event_id limit 1000")
def most_uncertain(spark, sf_dir):
    return Y.most_uncertain(_entries(spark, sf_dir), 1000, "uncertainty", "event_id").select("event_id", "uncertainty")


_dist = "1 - list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-12)"
_memory_sql = f"(select * from {VECTORS_SQL} order by {T.order_key_sql('id', seed='reservoir')}, id limit 100)"


@query("m4_nearest_in_memory", f"select v.id as id, round(min({_dist.format('v.vec', 'm.vec')}), 6) as distance from {VECTORS_SQL} v join {_memory_sql} m on v.id <> m.id group by 1")
def nearest_in_memory(spark, sf_dir):
    v = vectors(spark, sf_dir).drop("label")
    return Y.nearest_distance(v, Y.reservoir(v, 100, "id"), "id", "vec").select("id", rounded("distance", 6).alias("distance"))


@query("m5_diversity_threshold", f"with s as (select * from {VECTORS_SQL} order by {T.order_key_sql('id', seed='diversity')}, id limit 50) select round(quantile_cont({_dist.format('a.vec', 'b.vec')}, 0.25), 6) as threshold from s a join s b on a.id < b.id")
def diversity_threshold(spark, sf_dir):
    return Y.diversity_threshold(vectors(spark, sf_dir), "id", "vec").select(rounded("threshold", 6).alias("threshold"))


@query("m6_balanced", f"select event_id, concept from {_entries_sql} qualify row_number() over (partition by concept order by {T.order_key_sql('event_id', seed='balanced')}, event_id) <= 1000 // (select count(distinct event_type) from events)")
def balanced(spark, sf_dir):
    return Y.balanced(_entries(spark, sf_dir), 1000, "concept", "event_id").select("event_id", "concept")


@query("m7_hybrid", f"with m as {_memory_sql}, h as (select a.id, 0.5 * (a.label / 10) + 0.5 * min({_dist.format('a.vec', 'b.vec')}) as score from m a join m b on a.id <> b.id group by a.id, a.label) select id from {VECTORS_SQL} where id not in (select id from m) and label / 10 > (select min(score) from h)")
def hybrid(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "vec", (F.col("label") / 10).alias("uncertainty"))
    return Y.hybrid(v, Y.reservoir(v, 100, "id"), "id", "vec", "uncertainty").select("id")


@query("m9_weighted_draw", f"select event_id from {_entries_sql} order by ln((({T.order_key_sql('event_id', seed='draw')}) + 0.5::double) / 4294967296.0::double) / importance desc, event_id limit 64")
def weighted_draw(spark, sf_dir):
    return Y.draw(_entries(spark, sf_dir), 64, "weighted", "event_id").select("event_id")


@query("m9_recent_draw", f"select event_id, ts from {_entries_sql} order by ts desc, event_id limit 64")
def recent_draw(spark, sf_dir):
    return Y.draw(_entries(spark, sf_dir), 64, "recent", "event_id").select("event_id", "ts")


@query("m10_memory_statistics", f"select count(*) as size, round(avg(uncertainty), 6) as mean_uncertainty, min(uncertainty) as least, max(uncertainty) as most, (select list(concept || ':' || n order by concept) from (select concept, count(*) as n from {_entries_sql} group by 1)) as concepts from {_entries_sql}")
def memory_statistics(spark, sf_dir):
    out = Y.statistics(_entries(spark, sf_dir), "uncertainty", "concept")
    return out.select("size", rounded("mean_uncertainty", 6).alias("mean_uncertainty"), "least", "most", F.transform("concepts", lambda c: F.concat(c["concept"], F.lit(":"), c["n"].cast("string"))).alias("concepts"))


@query(
    "m12_mixed_batch",
    f"""(select event_id, false as replayed from {_entries_sql} where concept = 'purchase' order by {T.order_key_sql('event_id', seed='new')}, event_id limit 45) union all (select event_id, true from {_entries_sql} where concept <> 'purchase' order by {T.order_key_sql('event_id', seed='replay')}, event_id limit (64 - least(45, (select count(*) from events where event_type = 'purchase'))))""",
)
def mixed_batch(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return Y.mixed_batch(e.where("concept = 'purchase'"), e.where("concept <> 'purchase'"), 64, 0.3, "event_id").select("event_id", "replayed")


@query("t3_decisions", "select event_type, case when value > 0.5 then 'learn' else 'skip_confident' end as decision, count(*) as n, round(avg(value), 6) as mean_uncertainty from events group by all")
def decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("decision", M.decision(F.col("value")))
    return rows.groupBy("event_type", "decision").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value"), 6).alias("mean_uncertainty"))
