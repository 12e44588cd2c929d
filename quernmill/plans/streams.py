"""Queries over the online loop, sources and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.operators.stages import prepare_all
from quernmill.plans.base import Book, rounded
from quernmill.session import shared_folder, table
from quernmill.sources import readers as S
from quernmill.streaming import learner as N
from quernmill.streaming import loop as L

book = Book()
QUERIES, SQL, query = book.queries, book.sql, book.query


def event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a stream, in one pass over what is there."""
    name = f"{sf_dir}/[e]vents.parquet"
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(name)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream gives until it is through, written to a table and read again."""
    folder = shared_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("t1_stream_decisions", "select decision, count(*) as n from (select case when regexp_matches(props, '\\b\\d{16}\\b') then 'reject_unsafe' when value > 0.5 then 'learn' else 'skip_confident' end as decision from events) group by 1")
def stream_decisions(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("event_id", F.col("props").alias("text"), F.col("value").alias("uncertainty"))
    return N.counts(_drain(N.decide(rows).select("event_id", "decision"), spark))


@query("t2_text_stream", "select event_id, value > 0.5 as learned from events")
def text_stream(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("event_id", F.col("event_type").alias("text"), F.col("value").alias("uncertainty"))
    return _drain(N.decide(rows).select("event_id", (F.col("decision") == "learn").alias("learned")), spark)


@query("m1_stream_memory")
def stream_memory(spark, sf_dir):
    """Kept arrivals by buffer, through stateful streaming."""
    vector = F.array("value", F.sin("event_id"), F.cos("event_id"))
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("buffer"), "event_id", F.col("value").alias("uncertainty"), F.col("event_type").alias("concept"), vector.alias("vector"))
    return _drain(N.remember(rows, 100, "hybrid"), spark)


_log_sql = "(select ts::date as batch, count(*) filter (value > 0.5) as learned, count(*) as n from events group by 1)"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("batch")).agg(F.count_if(F.col("value") > 0.5).alias("learned"), F.count(F.lit(1)).alias("n"))


@query("t5_consolidations", f"with l as (select *, count(*) over w as events, sum(learned) over w as samples from {_log_sql} where learned > 0 window w as (order by batch)) select batch::varchar as batch, events, samples::bigint as samples from l where events % 3 = 0 and samples >= 50")
def consolidations(spark, sf_dir):
    return N.consolidations(_log(spark, sf_dir), 3, 50).select(F.col("batch").cast("string").alias("batch"), "events", "samples")


@query(
    "t6_evaluations",
    f"""with recursive l as (select datediff('day', date '1970-01-01', batch) as day, n, row_number() over (order by batch) as i from {_log_sql}),
 f as (select i, day, case when n >= 1000 then 0 else n end as s, n >= 1000 as hit from l where i = 1 union all select l.i, l.day, case when s + n >= 1000 then 0 else s + n end, s + n >= 1000 from f join l on l.i = f.i + 1) select day::bigint as day from f where hit""",
)
def evaluations(spark, sf_dir):
    return N.evaluations(_log(spark, sf_dir).withColumn("day", F.unix_date("batch")), 1000, order="day")


def _labels(rows: DataFrame) -> DataFrame:
    """A labeller that is as sure as the tens of an event's number say."""
    return rows.withColumns({"label_entities": F.array(F.concat(F.lit("user "), "user_id")), "label_concepts": F.array(F.array(F.lit("user"))), "label_confidence": F.floor(F.col("sample_id") / 10) % 10 / 10})


LOOP = L.Loop(labeller=_labels, memory_size=50, memory_strategy="uncertainty", rule_frequency=100, consolidate_every=1, consolidate_least=10)


def _ran(spark, sf_dir) -> str:
    """The folder of a loop over the events as a stream: purchases come with labels, all others are to be labelled."""
    e = event_stream(spark, sf_dir)
    labelled = F.col("event_type") == "purchase"
    rel = F.array(F.struct(F.lit(0).alias("head"), F.lit(1).alias("tail"), F.lit("buys").alias("rel")))
    rows = e.select(
        F.col("event_id").alias("sample_id"), "user_id", F.col("props").alias("text"), F.col("value").alias("uncertainty"),
        F.when(labelled, F.array(F.concat(F.lit("user "), "user_id"), F.lit("thing"))).alias("entities"), F.when(labelled, F.array(F.array(F.lit("user")), F.array(F.lit("thing")))).alias("concepts"), F.when(labelled, rel).alias("relations"),
    )
    folder = shared_folder(spark)
    LOOP.start(rows, folder).awaitTermination()
    return folder


_unsafe = "regexp_matches(props, '\\b\\d{3}[.-]?\\d{2,3}[.-]?\\d{4}\\b|\\b\\d{16}\\b')"
_loop_sql = f"(select *, case when {_unsafe} then 'skip_unsafe' when event_type <> 'purchase' and event_id // 10 % 10 < 6 then 'defer' when value > 0.5 then 'learn' else 'skip_confident' end as decision from events)"


@query("t1_online_loop", f"select decision, count(*) as n, count(*) filter (event_type <> 'purchase' and decision in ('learn', 'skip_confident')) as self_labeled, round(sum(value), 4) as uncertainty from {_loop_sql} group by 1")
def online_loop(spark, sf_dir):
    """Decisions of the whole loop over a stream."""
    rows = spark.read.parquet(f"{_ran(spark, sf_dir)}/decided")
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_if("self_labeled").alias("self_labeled"), rounded(F.sum("uncertainty"), 4).alias("uncertainty"))


@query("t4_learning_log", f"select count(*) as total, count(*) filter (decision = 'learn') as learned, count(*) filter (decision = 'skip_confident') as skipped_confident, count(*) filter (decision = 'skip_unsafe') as skipped_unsafe, count(*) filter (decision = 'defer') as deferred, round(avg(value) filter (decision = 'learn'), 6) as mean_uncertainty, true as consolidates from {_loop_sql}")
def learning_log(spark, sf_dir):
    """The learning event of the stream's one batch."""
    rows = LOOP.events(spark, _ran(spark, sf_dir))
    return rows.select("total", "learned", "skipped_confident", "skipped_unsafe", "deferred", rounded("mean_uncertainty", 6).alias("mean_uncertainty"), "consolidates")


@query("t7_rollup", f"select count(*) as seen, count(*) filter (decision = 'learn') as learned, 1::bigint as events, least(50, count(*) filter (decision in ('learn', 'skip_confident'))) as memory, 3::bigint as concepts, 1::bigint as rules, count(*) filter (event_type = 'purchase' and decision in ('learn', 'skip_confident')) as relations from {_loop_sql}")
def rollup(spark, sf_dir):
    known = spark.createDataFrame([("known", 0)], "name string, id int")
    return LOOP.rollup(spark, _ran(spark, sf_dir), known)


@query("t9_frozen_parameters", "select p_name as name, not (contains(p_name, 'bl') or contains(p_name, 'ed')) as trained from part")
def frozen_parameters(spark, sf_dir):
    return L.freeze(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), ["bl", "ed"])


@query("s1_samples_json", "select p_name as text, [p_brand, p_type] as entities, [[p_type], ['a', 'b']] as concepts, [0, -1] as heads, ['0', p_brand] as head_names, 1 as should_respond from part")
def samples_json(spark, sf_dir):
    """Samples written as JSON lines with mixed concepts and relations, and read again."""
    folder = shared_folder(spark)
    line = F.concat(F.lit('{"text":"'), "p_name", F.lit('","entities":["'), "p_brand", F.lit('","'), "p_type", F.lit('"],"concepts":["'), "p_type", F.lit('",["a","b"]],"relations":[[0,1,"made_of"],["'), "p_brand", F.lit('","'), "p_type", F.lit('","is"]],"should_respond":1}'))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(folder)
    rows = S.samples(spark, folder)
    return rows.select("text", "entities", "concepts", F.transform("relations", lambda r: F.coalesce(r["head"], F.lit(-1))).alias("heads"), F.transform("relations", lambda r: r["head_name"]).alias("head_names"), "should_respond")


@query("s2_default_samples", "select * from (values ('The cat chased the mouse.', 1), ('Paris is the capital of France.', 1), ('Alice loves Bob.', 1), ('The dog barked at the mailman.', 1), ('Blue is the colour of the sky.', 0)) t(text, should_respond)")
def default_samples(spark, sf_dir):
    return S.default_samples(spark).select("text", "should_respond")


@query("s7_instruction_set", "select conv_id || ':' || turn as instruction, text as response, nullif(case when turn % 2 = 0 then role else '' end, '') as context from conversations where text <> ''")
def instruction_set(spark, sf_dir):
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "conversations")
    rows.select(F.concat("conv_id", F.lit(":"), "turn").alias("instruction"), F.col("text").alias("output"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("input")).write.json(folder)
    return S.instruction_set(spark, folder)


def vector_lines(spark, sf_dir) -> DataFrame:
    """The embeddings as lines of text (k, value), and a header with k -1."""
    rows = table(spark, sf_dir, "embeddings")
    lines = rows.select(F.col("vec_id").alias("k"), F.concat_ws(" ", F.concat(F.lit("e"), "vec_id"), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), " ")).alias("value"))
    return lines.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("0 64").alias("value")))


def in_one_file(lines: DataFrame) -> str:
    """The folder of one text file with the lines in the order of k."""
    folder = shared_folder(lines.sparkSession)
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(folder)
    return folder


_vectors = "select 'e' || vec_id as entity, {0} as id, list_transform(embedding, lambda x: round(x::double, 4) + 0.0::double) as vec from (select *, row_number() over (order by vec_id) - 1 as n from embeddings)"


@query("s9_vectors_text", _vectors.format("n"))
def vectors_text(spark, sf_dir):
    """One file, read in many splits: ids are line numbers."""
    return S.load(spark, "vectors", in_one_file(vector_lines(spark, sf_dir))).select("entity", "id", F.transform("vec", lambda x: x + 0.0).alias("vec"))


@query("s10_vectors_of_files", _vectors.format("3 * n + 1"))
def vectors_of_files(spark, sf_dir):
    """Several files with a header each; of three lines two are short, one of them of the same name."""
    folder = shared_folder(spark)
    rows = vector_lines(spark, sf_dir).where("k >= 0")
    # files are numbered on in the order of their paths, so that numbers in them have one length
    lines = rows.withColumn("part", F.lpad(F.floor(F.col("k") / 1000).cast("string"), 16, "0")).withColumn("l", F.array(F.struct(F.lit(0).alias("o"), F.lit("short 1 2").alias("v")), F.struct(F.lit(1).alias("o"), F.col("value").alias("v")), F.struct(F.lit(2).alias("o"), F.concat(F.lit("e"), F.col("k"), F.lit(" 1")).alias("v"))))
    lines = lines.select("part", "k", F.explode("l").alias("x")).select("part", F.struct("k", "x.o").alias("o"), F.col("x.v").alias("value"))
    heads = lines.groupBy("part").agg(F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0).alias("o")).alias("o"), F.lit("0 64").alias("value")).select("part", "o", "value")
    heads.unionByName(lines).repartitionByRange("part").sortWithinPartitions("part", "o").select("part", "value").write.partitionBy("part").text(folder)
    return S.load(spark, "vectors", f"{folder}/*").select("entity", "id", F.transform("vec", lambda x: x + 0.0).alias("vec"))


@query("s11_graph_triples", "select '/c/en/' || lower(n_name) as src, '/r/PartOf' as rel, '/c/en/' || lower(r_name) as dst from nation join region on n_regionkey = r_regionkey")
def graph_triples(spark, sf_dir):
    folder = shared_folder(spark)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    uri = lambda c: F.struct(F.concat(F.lit("/c/en/"), F.lower(c)).alias("uri"))
    good = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.struct(uri("n_name").alias("start"), F.struct(F.lit("/r/PartOf").alias("uri")).alias("rel"), uri("r_name").alias("end"))).alias("value"))
    good.unionByName(region.select(F.concat(F.lit("{broken "), "r_name").alias("value"))).write.text(folder)
    return S.graph_triples(spark, folder)


@query("s13_saved_splits", f"select split, count(*) as n from (select case when ({T.order_key_sql('doc_id', seed='s')}) % 10 < 8 then 'train' else 'test' end as split from documents) group by 1")
def saved_splits(spark, sf_dir):
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(T.order_key("doc_id", seed="s") % 10 < 8, "train").otherwise("test").alias("split"))
    S.save_splits(rows, folder)
    return spark.read.schema("doc_id bigint, text string, split string").json(folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s16_saved_memory", "select event_id, value as uncertainty from events")
def saved_memory(spark, sf_dir):
    folder = shared_folder(spark)
    S.save_memory(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("uncertainty"), F.array(F.lit(1.0)).alias("embedding")), folder)
    return spark.read.parquet(folder)


@query("s21_metric_log", "select event_type as tag, event_id as step, value, null::varchar as text, 'scalar' as kind from events union all select user_id::varchar, event_id, value, null, 'histogram' from events union all select 'props', event_id, null, props, 'text' from events")
def metric_log(spark, sf_dir):
    """Scalars, values of histograms and texts, appended to one log."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events").withColumn("step", F.col("event_id"))
    S.write_metrics(events.select(F.col("event_type").alias("tag"), "step", "value"), folder)
    S.write_metrics(events.select(F.col("user_id").cast("string").alias("tag"), "step", "value"), folder, "histogram")
    S.write_metrics(events.select(F.lit("props").alias("tag"), "step", F.col("props").alias("text")), folder, "text")
    return S.read_metrics(spark, folder).select("tag", "step", "value", "text", "kind")


@query("s14_stage_files", "select 'one' as stage, p_name as text from part union all select 'two', c_name from customer")
def stage_files(spark, sf_dir):
    """Two stages saved below one folder and read as one table."""
    folder = shared_folder(spark)
    stages = {"one": table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), "two": table(spark, sf_dir, "customer").select(F.col("c_name").alias("text"))}
    counts = {r["stage"]: r["samples"] for r in prepare_all(spark, stages, folder).collect()}
    if set(counts) != set(stages):
        raise RuntimeError("a stage is missing")
    return spark.read.schema("text string, stage string").json(folder).select("stage", "text")
