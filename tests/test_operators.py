"""Vocabularies, graph, rules, safety, metrics, memory and the online loop."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernmill.operators import extraction as X
from quernmill.operators import graph as G
from quernmill.operators import linalg as L
from quernmill.operators import memory as Y
from quernmill.operators import metrics as M
from quernmill.operators import rules as R
from quernmill.operators import safety as S
from quernmill.operators import vocabulary as V
from quernmill.sources import readers as D
from quernmill.streaming import learner as N
from quernmill.streaming import loop as P


def test_splits_have_exact_sizes(spark):
    out = V.splits(spark.range(103).withColumnRenamed("id", "doc_id"), "doc_id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 82, "val": 10, "test": 11}


def test_rows_are_numbered_across_partitions(spark):
    rows = V.ranked(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")), F.col("k"), name="n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(1, 5001))


def test_incomplete_batch_goes_unless_it_is_alone(spark):
    assert V.batches(spark.range(70), 32, "id").groupBy("batch").count().count() == 2
    assert V.batches(spark.range(10), 32, "id").count() == 10


def test_type_map_of_default_samples(spark):
    names = "animal predator animal prey city location country location person person animal person location attribute".split()
    rows = spark.createDataFrame(list(enumerate(names)), "position int, concept string")
    assert {r["concept"]: r["id"] for r in V.type_map(rows).collect()} == dict(animal=0, person=1, location=2, attribute=3, predator=4, prey=5, city=6, country=7)


def test_paths_are_simple_and_both_ways(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("b", "s", "c"), ("a", "q", "b"), ("c", "u", "a")], "src string, rel string, dst string")
    got = G.paths(t, spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "z")], "src string, dst string"), max_paths=None)
    assert sorted((r["dst"], r["path"]) for r in got.collect()) == [("a", "self>a"), ("c", "q>b|s>c"), ("c", "r>b|s>c"), ("c", "~u>c")]


def test_facts(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c")], "src string, rel string, dst string")
    claims = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("a", "r", "c"), ("c", "x", "d")], "src string, rel string, dst string")
    assert {(r["src"], r["dst"]): r["confidence"] for r in G.verify(claims, t).collect()} == {("a", "b"): 1.0, ("b", "a"): 0.9, ("a", "c"): 0.5, ("c", "d"): 0.0}


def test_fuzzy_links_against_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names, nodes = sorted({make(rng.randrange(1, 9)) for _ in range(60)}), sorted({make(rng.randrange(1, 9)) for _ in range(60)})
    want = {}
    for a in names:
        best = None
        for place, b in enumerate(nodes):
            if a != b and (a in b or b in a):
                score = len(set(a) & set(b)) / max(len(a), len(b))
                if score > 0.5 and (best is None or score > best[0]):
                    best = (score, b)
        if best and a not in nodes:
            want[a] = "/c/en/" + best[1]
    got = G.link(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([], "key string, node string"), spark.createDataFrame([("/c/en/" + b, i) for i, b in enumerate(nodes)], "node string, place int"))
    assert {r["name"]: r["node"] for r in got.where("stage = 'fuzzy'").collect()} == want


def _pairs(spark):
    rows = [("animal", "animal", "chases"), ("animal", "prey", "chases"), ("predator", "animal", "chases"), ("predator", "prey", "chases"), ("person", "person", "loves"), ("animal", "person", "barks_at")]
    return spark.createDataFrame(rows + rows[4:], "concept_a string, concept_b string, relation string")


def test_rules_of_few_samples(spark):
    got = {(r["concept_a"], r["relation"]): (r["frequency"], r["confidence"], r["weight"]) for r in R.mine_positive(_pairs(spark)).collect()}
    assert got == {("person", "loves"): (2, 1.0, 0.5), ("animal", "barks_at"): (2, 1.0, 0.5)}
    against = R.mine_negative(_pairs(spark)).collect()
    assert {(r["concept_a"], r["relation"]) for r in against} == {("animal", "chases"), ("animal", "loves"), ("person", "chases"), ("person", "barks_at")}


def test_opposite_rules_conflict(spark):
    rules = spark.createDataFrame([(1, "a", "b", "r", 1), (2, "a", "b", "r", -1), (3, "a", "b", "q", -1)], "rule_id int, concept_a string, concept_b string, relation string, polarity int")
    assert [(r["first_id"], r["second_id"]) for r in R.conflicting_pairs(rules).collect()] == [(1, 2)]
    assert [(r["first_positive"], r["first_negative"]) for r in R.conflicts(rules).collect()] == [(1, 2)]


def test_safety_layers(spark):
    text = "All members of [group] are stupid and should be hated."
    rows = spark.createDataFrame([(1, text, []), (2, "fine", []), (3, "worst Dr Who", ["Dr Who"]), (4, None, None), (5, "allowed bad", [])], "id int, text string, entities array<string>")
    got = {r["id"]: r["verdict"] for r in S.regulate(rows, S.Keywords(allow=["allowed"], block=["BAD"])).collect()}
    assert (got[1]["is_safe"], got[1]["category"], got[1]["confidence"]) == (False, "hate_speech", 0.8)
    assert got[2]["is_safe"] and got[2]["confidence"] == 1.0 and got[5]["is_safe"]
    assert got[3]["triggered_rules"] == ["ethical:no_personal_attacks"]
    safe, unsafe = S.split_safe(S.regulate(rows))
    assert unsafe.count() == 2


def plain_bleu(reference, hypothesis):
    r, h = reference.lower().split(), hypothesis.lower().split()
    total = 0.0
    for n in range(1, 5):
        a, b = Counter(zip(*[r[i:] for i in range(n)], strict=False)), Counter(zip(*[h[i:] for i in range(n)], strict=False))
        hit = sum((a & b).values())
        if not hit:
            return 0.0
        total += math.log(hit / sum(b.values())) / 4
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(total)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab ", max_size=40), st.text("ab ", max_size=40)), min_size=1, max_size=12))
def test_bleu_against_plain_python(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, r string, h string")
    got = {r["i"]: r["bleu"] for r in M.bleu(rows, "r", "h").collect()}
    assert all(abs(got[i] - plain_bleu(a, b)) < 1e-9 and 0 <= got[i] <= 1 for i, (a, b) in enumerate(pairs))


def test_early_stop(spark):
    got = spark.range(1).select(M.early_stop(F.array(*[F.lit(float(x)) for x in (5, 4, 4.5, 4.4, 4.3)]), 3).alias("s")).first()["s"]
    assert got["best"] == 4.0 and got["stopped_at"] == 5


def test_entities_are_cut_at_their_greatest_length(spark):
    tokens = spark.createDataFrame([(1, i, t, 0.9) for i, t in enumerate([1, 1, 1, 0, 2, 2, 1])], "id int, position int, type int, conf double")
    assert sorted((r["start"], r["end"], r["type"]) for r in X.entities(tokens, "id", "position", 0.5, 1, 2).collect()) == [(0, 1, 1), (2, 2, 1), (4, 5, 2), (6, 6, 1)]


def test_mixed_batch_is_filled_by_replay(spark):
    new, old = spark.range(3), spark.range(100, 200)
    got = Y.mixed_batch(new, old, 16, 0.25, "id").groupBy("replayed").count().collect()
    assert {r["replayed"]: r["count"] for r in got} == {False: 3, True: 13}


@pytest.mark.parametrize("strategy", ["reservoir", "uncertainty", "balanced", "diversity", "hybrid", "unknown"])
def test_memory_never_grows_beyond_its_size(strategy):
    rng = random.Random(3)
    memory = N.Memory(10, strategy)
    for i in range(200):
        memory.add(i, rng.random(), rng.choice("abc"), [rng.random() for _ in range(4)])
    assert len(memory.entries) == 10 and memory.seen == 200


def test_streamed_memory_keeps_the_most_uncertain(spark, tmp_path):
    rows = [("x", i, (i * 7919 % 1009) / 1009, "c") for i in range(500)]
    spark.createDataFrame(rows, "buffer string, event_id long, uncertainty double, concept string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("buffer string, event_id long, uncertainty double, concept string").parquet(str(tmp_path / "in"))
    N.remember(stream, 20).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    kept = spark.sql("select * from kept").collect()
    assert len(kept) == 500 and max(r["size"] for r in kept) == 20
    top = {r[1] for r in sorted(rows, key=lambda r: -r[2])[:20]}
    assert top <= {r["event_id"] for r in kept if r["kept"]}


def test_evaluations_start_again(spark):
    log = spark.createDataFrame([(i, 4) for i in range(10)], "batch int, n int")
    assert [r["batch"] for r in N.evaluations(log, 10).collect()] == [2, 5, 8]


def test_pair_index_counts_the_upper_triangle(spark):
    rows = spark.range(6).select(F.col("id").alias("i")).crossJoin(spark.range(6).select(F.col("id").alias("j"))).where("i < j")
    got = [r["x"] for r in rows.orderBy("i", "j").select(L.pair_index(F.col("i"), F.col("j"), 6).cast("int").alias("x")).collect()]
    assert got == list(range(15))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, lang string")
    assert V.splits(none, "doc_id").count() == 0
    assert V.vocabulary(none, "lang").count() == 0
    assert V.mixture(none, "lang", {"en": 0.5}, "doc_id").count() == 0


@pytest.mark.parametrize("strategy", ["reservoir", "uncertainty", "balanced", "diversity", "hybrid"])
def test_streamed_memory_is_the_sequential_one(spark, tmp_path, strategy):
    """Over three micro-batches, with vectors in the state."""
    rng = random.Random(4)
    kind = "buffer string, event_id long, uncertainty double, concept string, vector array<double>"
    rows = [("xy"[i % 2], i, rng.random(), rng.choice("abc"), [rng.random() for _ in range(3)]) for i in range(150)]
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    N.remember(stream, 10, strategy).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    memories = {b: N.Memory(10, strategy) for b in "xy"}
    want = {r[1]: memories[r[0]].add(*r[1:]) for r in rows}
    assert {r["event_id"]: r["kept"] for r in spark.read.parquet(out).collect()} == want


def _samples(spark, n=120):
    rows = [(i, "call 123-45-6789" if i % 10 == 0 else f"sample {i}", ["a", "b"] if i % 3 == 0 else None, [["x"], ["y"]] if i % 3 == 0 else None, [(0, 1, "r")] if i % 3 == 0 else None, (i % 7) / 7 if i % 11 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id long, text string, entities array<string>, concepts array<array<string>>, relations array<struct<head:int,tail:int,rel:string>>, uncertainty double")


def test_loop_over_a_stream_is_the_loop_over_a_batch(spark, tmp_path):
    rows, frame = _samples(spark)
    label = lambda d: d.withColumns({"label_entities": F.array(F.lit("e")), "label_concepts": F.array(F.array(F.lit("z"))), "label_confidence": F.col("sample_id") % 10 / 10})
    seen = []
    loop = P.Loop(labeller=label, memory_size=20, memory_strategy="uncertainty", rule_frequency=2, consolidate_every=2, consolidate_least=1, callback=lambda d, n: seen.append((n, d.count())))
    for k in range(3):
        frame.where(f"sample_id div 40 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "loop")
    loop.start(stream, folder).awaitTermination()
    assert seen == [(0, 40), (1, 40), (2, 40)]
    got = {r["sample_id"]: (r["decision"], r["self_labeled"]) for r in spark.read.parquet(f"{folder}/decided").collect()}
    assert got == {r["sample_id"]: (r["decision"], r["self_labeled"]) for r in loop.decided(frame).collect()}
    def plain(i, text, entities, concepts, relations, u):
        if "123-45" in text:
            return "skip_unsafe", False
        if entities is None and (i % 10) / 10 < 0.6:
            return "defer", False
        return "learn" if (u or 0) > 0.5 else "skip_confident", entities is None
    want = {r[0]: plain(*r) for r in rows}
    assert got == want
    passed = [r for r in rows if want[r[0]][0] in ("learn", "skip_confident")]
    learned = [sum(want[i][0] == "learn" for i in range(40 * k, 40 * k + 40)) for k in range(3)]
    assert [(r["batch"], r["learned"], r["consolidates"]) for r in loop.events(spark, folder).orderBy("batch").collect()] == [(k, learned[k], k == 1) for k in range(3)]
    top = sorted(passed, key=lambda r: (-(r[5] if r[5] is not None else -1), r[0]))[:20]
    assert {r["sample_id"] for r in spark.read.parquet(f"{folder}/memory/batch=2").collect()} == {r[0] for r in top}
    known = spark.createDataFrame([("x", 0)], "name string, id int")
    total = loop.rollup(spark, folder, known).first()
    pairs = sum(r[4] is not None for r in passed)
    assert (total["seen"], total["learned"], total["events"], total["memory"]) == (120, sum(learned), 3, 20)
    assert (total["concepts"], total["rules"], total["relations"]) == (3, 1, pairs)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    _, frame = _samples(spark, 30)
    loop, folder = P.Loop(), str(tmp_path)
    for _ in range(2):
        loop.step(folder)(frame, 0)
    assert spark.read.parquet(f"{folder}/decided").count() == 30
    assert loop.rollup(spark, folder, spark.createDataFrame([], "name string, id int")).first()["seen"] == 30


def test_samples_without_a_labeller_are_deferred(spark):
    out = P.Loop().decided(spark.createDataFrame([(1, "text", 0.9), (2, None, None)], "sample_id long, text string, uncertainty double"))
    assert {r["decision"] for r in out.collect()} == {"defer"}
    assert P.Loop().decided(out.limit(0).drop("verdict", "decision")).count() == 0


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.txt").write_text("".join(f"{k}:{i} {'x' * (i % 50)}\n" for i in range(3000 * k + 5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = D.numbered_lines(spark, str(tmp_path))
        assert lines.where("value not like concat('%:', n, ' %')").count() == 0 and lines.count() == 9015
        assert [r["a"] for r in D.json_lines(spark, str(tmp_path), "a int", 7).collect()] == [None] * 7  # lines that aren't JSON, as the reader has them
        (tmp_path / "v").mkdir()
        (tmp_path / "v" / "a.txt").write_text("2 2\nx 1 2\nshort 1\ny 3 4\n")
        (tmp_path / "v" / "b.txt").write_text("9 2\nx 5 6\n" + "".join(f"w{i} {i} 0\n" for i in range(2000)))
        got = {r["entity"]: (r["id"], r["vec"]) for r in D.vectors_text(spark, str(tmp_path / "v")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"x": (3, [5.0, 6.0]), "y": (2, [3.0, 4.0])} | {f"w{i}": (4 + i, [float(i), 0.0]) for i in range(2000)}


def test_mixture_takes_the_least_draws_of_each_source(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("lang"))
    got = V.mixture(rows, "lang", {"a": 0.1, "b": 0.5, "c": 0.0}, "doc_id").collect()
    from quernmill.functions.text import order_key

    drawn = sorted((r["k"], r["doc_id"]) for r in rows.where("lang = 'a'").select("doc_id", order_key("doc_id", seed="mix").alias("k")).collect())
    assert {r["doc_id"] for r in got if r["lang"] == "a"} == {d for _, d in drawn[:300]}
    assert sum(r["lang"] == "b" for r in got) == rows.where("lang = 'b'").count() and not any(r["lang"] == "c" for r in got)


@pytest.mark.parametrize("size", [1 << 26, 400])
def test_blocks_of_any_size_find_the_same(spark, size):
    from quernmill.operators import blocks as B

    rng = random.Random(8)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)] if i else None) for i in range(40)]
    frame = spark.createDataFrame(vecs, "id long, vec array<double>")
    bank = frame.withColumnsRenamed({"id": "j", "vec": "v"})
    dot = lambda a, b: sum(x * y for x, y in zip(a or [0] * 4, b or [0] * 4, strict=True))
    cos = lambda a, b: dot(a, b) / max(math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)), 1e-8)
    got = {(r["id"], r["other"]) for r in B.against(frame, bank, "id", "vec", "j", "v", B.above(0.6), size=size).collect()}
    assert got == {(i, j) for i, a in vecs for j, b in vecs if i < j and cos(a, b) > 0.6}
    assert B.against(frame.limit(0), bank, "id", "vec", "j", "v", B.greatest(2), size=size).count() == 0
    assert B.against(frame, bank.limit(0), "id", "vec", "j", "v", B.greatest(2), size=size).count() == 0


def plain_spans(question, entities, original):
    low, taken, out = question.lower(), [], []
    for i, e in enumerate(entities):
        n, hit = len(e), None
        for at in range(len(low) - n + 1 if n else 0):
            if low[at : at + n] == e.lower() and not any(t[0] <= at + n - 1 and t[1] >= at for t in taken):
                hit = (at, at + n - 1)
                break
        if hit:
            taken.append(hit)
        out.append(hit or ((original[i][0] + 4, original[i][0] + 3 + n) if i < len(original) else (0, n - 1)))
    return out


def test_recalculated_spans_against_plain_python(spark):
    from quernmill.functions.text import recalculated_spans

    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abAB ") for _ in range(n))
    rows = [(i, make(rng.randrange(30)), [make(rng.randrange(4)) for _ in range(rng.randrange(5))], [(rng.randrange(9), 0) for _ in range(rng.randrange(4))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "i int, q string, e array<string>, o array<struct<start:int,end:int>>")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in frame.select("i", recalculated_spans("q", "e", "o").alias("s")).collect()}
    assert got == {i: plain_spans(q, e, o) for i, q, e, o in rows}
    assert frame.limit(1).select(recalculated_spans(F.lit(None).cast("string"), "e", "o").alias("s")).first()["s"] is None


def test_merged_concepts_take_in_what_goes(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.8, 0.6]), (3, [1.0, 0.0])], "id int, vec array<double>")
    got = {r["id"]: r["vec"] for r in R.merged_concepts(v, 0.75).collect()}
    x = [0.9, 0.3]
    x = [a / math.hypot(*x) for a in x]
    x = [(x[0] + 1) / 2, x[1] / 2]
    assert set(got) == {0, 1} and got[1] == [0.0, 1.0] and got[0] == pytest.approx([a / math.hypot(*x) for a in x])


@pytest.mark.parametrize("best", ["above", "first", "greatest"])
def test_a_block_holds_few_columns_of_a_bank_and_keeps_ties(best):
    """Memory doesn't grow with the bank, and equal vectors are equally similar wherever they stand."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quernmill.operators import blocks as B

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 8))
    vectors[1::4] = vectors[::4]
    vectors[7] = 0
    bank = B.Bank(pa.array(np.arange(20_000)), vectors, 1e-8)
    pick = {"above": B.above(0.97), "first": B.first(0.9), "greatest": B.greatest(3)}[best]
    tracemalloc.start()
    got = [x for lo in range(0, 20_000, 10_000) for r, c, s in pick(B.Block(bank, pa.array(np.arange(lo, lo + 500)), vectors[lo : lo + 500])) for x in zip((r + lo).tolist(), c.tolist(), s.tolist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # a whole block of similarities, as it was held before, is 80 MB, and its copies as much each

    def cosines(i):
        total, own, other = np.zeros(20_000), 0.0, np.zeros(20_000)
        for d in range(8):
            total, own, other = total + vectors[i, d] * vectors[:, d], own + vectors[i, d] ** 2, other + vectors[:, d] ** 2
        return total / np.maximum(np.sqrt(own) * np.sqrt(other), 1e-8)

    want = []
    for i in [*range(500), *range(10_000, 10_500)]:
        c = cosines(i)
        if best == "above":
            want += [(i, j, c[j]) for j in np.flatnonzero(c > 0.97).tolist() if j > i]
        elif best == "first":
            want += [(i, j, c[j]) for j in np.flatnonzero(c[:i] > 0.9)[:1].tolist()]
        else:
            want += [(i, j, c[j]) for j in sorted((j for j in range(20_000) if j != i), key=lambda j: (-c[j], j))[:3]]
    assert sorted(got) == sorted(want)


def test_merging_folds_many_vectors_into_one(spark):
    rows = [(i, f"n{i}", [1.0, i / 1000]) for i in range(300)] + [(300, "far", [-1.0, 0.0]), (301, "none", None)]
    got = {r["id"]: r for r in R.merged_concepts(spark.createDataFrame(rows, "id int, name string, vec array<double>"), 0.9).collect()}
    x = rows[0][2]
    for _, _, v in rows[1:300]:
        x = [(a + b) / 2 for a, b in zip(x, v, strict=True)]
        x = [a / math.hypot(*x) for a in x]
    assert set(got) == {0, 300, 301} and got[0]["vec"] == pytest.approx(x) and got[0]["name"] == "n0"
    assert got[300]["vec"] == [-1.0, 0.0] and got[301]["vec"] is None
    # 1 goes into 0, and 2 into 1, which is gone; 3 stays as it is
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    got = {r["id"]: r["vec"] for r in R.merged_concepts(spark.createDataFrame([(0, turn(0)), (1, turn(20)), (2, turn(40)), (3, turn(90))], "id int, vec array<double>").coalesce(1), 0.9).collect()}
    assert set(got) == {0, 3} and got[0] == pytest.approx(turn(10)) and got[3] == turn(90)


def test_rounding_keeps_the_sign_of_what_rounds_to_nothing(spark):
    from quernmill.plans.base import rounded

    rows = spark.createDataFrame([(x,) for x in (-4e-7, 4e-7, -0.0, 0.0, -1.25, 2.5, -5e-7, None)], "x double")
    got = [r["y"] for r in rows.coalesce(1).select(rounded("x", 6).alias("y")).collect()]
    assert [str(x) for x in got] == ["-0.0", "0.0", "-0.0", "0.0", "-1.25", "2.5", "-1e-06", "None"]


def test_vectors_of_more_than_ten_files_are_numbered_in_their_order(spark, tmp_path):
    import __spark_entry__ as entry

    rows = spark.range(11_500).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i / 100).cast("float")).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["s10_vectors_of_files"](spark, str(tmp_path))
    assert got.where(F.col("id") != 3 * F.substring("entity", 2, 9).cast("long") + 1).count() == 0 and got.count() == 11_500


def plain_paths(edges, src, dst, most):
    if src == dst:
        return {(f"self>{src}", 1)}
    both = edges + [(c, "~" + r, a) for a, r, c in edges]
    out, grown = set(), [(src, (src,), "")]
    for step in range(1, most + 1):
        grown = [(c, (*seen, c), path + ("|" if path else "") + f"{r}>{c}") for at, seen, path in grown for a, r, c in both if a == at and c not in seen]
        out |= {(path, step) for at, _, path in grown if at == dst}
        grown = [g for g in grown if g[0] != dst]
    return out


@pytest.mark.parametrize("least", [0, 3, 64])
def test_paths_and_facts_from_either_end_against_plain_python(spark, least, monkeypatch):
    monkeypatch.setattr(G, "LEAST", least)
    rng = random.Random(least)
    nodes = "abcdefgh"
    edges = list({(rng.choice(nodes), rng.choice("rs"), rng.choice(nodes)) for _ in range(14)}) + [("a", "r", f"leaf{i}") for i in range(9)]
    triples = spark.createDataFrame(edges, "src string, rel string, dst string")
    pairs = [(a, b) for a in nodes[:4] for b in nodes] + [("leaf1", "leaf2"), ("b", "leaf3"), ("leaf4", "c"), ("a", "b")]
    frame = spark.createDataFrame(pairs, "src string, dst string")
    for most in (1, 2, 3, 4):
        got = sorted((r["src"], r["dst"], r["path"], r["steps"]) for r in G.paths(triples, frame, most, None).collect())
        assert got == sorted((a, b, *x) for a, b in set(pairs) for x in plain_paths(edges, a, b, most))
    both = set(edges) | {(c, "~" + r, a) for a, r, c in edges}
    claims = [(a, r, b) for a, b in pairs for r in ("r", "s", "~r")]

    def sure(a, r, b):
        if (a, r, b) in both or (a, "~" + r, b) in both:
            return 1.0 if (a, r, b) in both else 0.9
        two = any(x == a and z == b and y not in (a, b) for x, _, y in both for y2, _, z in both if y2 == y)
        return 0.5 if a == b or two or any((x, z) == (a, b) for x, _, z in both) else 0.0

    got = {(r["src"], r["rel"], r["dst"]): r["confidence"] for r in G.verify(spark.createDataFrame(claims, "src string, rel string, dst string"), triples).collect()}
    assert got == {c: sure(*c) for c in set(claims)}


def test_growth_of_paths_and_facts_passes_no_hub(spark):
    """Rows that joins give stay in proportion to the pairs, though all go by one node: its neighbours aren't paired."""
    n = 3000
    leaf = spark.range(n).select(F.concat(F.lit("leaf"), "id").alias("src"), F.lit("in").alias("rel"), F.lit("hub").alias("dst"))
    triples = leaf.unionByName(spark.createDataFrame([("hub", "part_of", "top")], "src string, rel string, dst string"))
    pairs = leaf.select("src", F.lit("top").alias("dst"))
    grown = G.cut
    rows = []
    try:
        G.cut = lambda df: rows.append(grown(df)) or rows[-1]
        assert G.paths(triples, pairs).count() == n
        assert G.verify(pairs.withColumn("rel", F.lit("in")).select("src", "rel", "dst"), triples).where("confidence = 0.5").count() == n
    finally:
        G.cut = grown
    assert max(r.count() for r in rows) <= 2 * n


def test_relations_are_indexed_without_a_shuffle(spark):
    from quernmill.operators import extraction as X

    rows = spark.range(1000).select("id", F.array(F.lit("x"), F.lit("y")).alias("e"), F.lit("x").alias("head"), F.lit("1").alias("tail"), F.lit("r").alias("rel"))
    got = X.indexed_relations(rows, "id", "e", spark.createDataFrame([("r", 3), ("s", 4)], "name string, id int"))
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 1, 2)} and got.count() == 1000


@pytest.mark.parametrize("nulls", [0.0, 0.01])
def test_memory_by_blocks_is_the_sequential_one_and_fast(nulls):
    import time

    import numpy as np

    rng = random.Random(12)
    rows = [(i, rng.random() * 3, rng.choice("ab"), None if rng.random() < nulls else [rng.gauss(0, 1) for _ in range(3)]) for i in range(1500)]
    one, all_ = N.Memory(60, "hybrid"), N.Memory(60, "hybrid")
    began = time.perf_counter()
    want = [one.add(*r) for r in rows]
    took = time.perf_counter() - began
    ids, sure, concepts = (np.array([r[k] for r in rows], object) for k in range(3))
    began = time.perf_counter()
    got = [x for at in range(0, 1500, 700) for x in all_.add_all(ids[at : at + 700], sure[at : at + 700], concepts[at : at + 700], [r[3] for r in rows[at : at + 700]])]
    assert got == want and all_.entries == one.entries and all_.seen == one.seen and 0 < sum(want) < 1500
    assert nulls or time.perf_counter() - began < took / 3


def test_texts_without_insults_are_told_from_others(spark):
    rows = spark.createDataFrame([("dr who is a fool",), ("dr who is kind",), (None,)], "low string").coalesce(1)
    assert [r[0] for r in rows.select(S.with_insults("low")).collect()] == [True, False, None]
