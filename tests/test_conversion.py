"""Texts, samples and their conversion, against values worked out by hand and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quernmill.functions import text as T
from quernmill.operators import conversion as C
from quernmill.sources import readers as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "statement, question",
    [
        ("The cat chased the mouse.", "Did the cat chased the mouse?"),
        ("Paris is the capital of France.", "Is Paris the capital of France?"),
        ("Alice loves Bob.", "Does alice loves bob?"),
        ("  ", ""),
        ("Is it so...", "Is it so?"),
        ("The sky is blue", "Is The sky blue?"),
        ("A dog barks at night", "Does a dog barks at night?"),
        ("The end", "Did the end?"),
        ("it is so", "Does it is so?"),
    ],
)
def test_questions(spark, statement, question):
    assert one(spark, T.statement_to_question(F.lit(statement))) == question


def test_spans_avoid_those_taken(spark):
    rows = spark.createDataFrame([("Did the cat chased the mouse?", ["cat", "mouse", "the", "the", "dog", "cow"], [(0, 2), (3, 7), (0, 0), (0, 0), (7, 9)])], "q string, e array<string>, o array<struct<start:int,end:int>>")
    got = [tuple(s) for s in rows.select(T.recalculated_spans("q", "e", "o").alias("s")).first()["s"]]
    assert got == [(8, 10), (23, 27), (4, 6), (19, 21), (11, 13), (0, 2)]


def names(text):
    found, w, i = [], text.split(), 0
    while i < len(w):
        if i == 0 or w[i - 1][-1] in ".?!" or not (w[i][0].isupper() and len(w[i]) > 1):
            i += 1
            continue
        j = i
        while j < len(w) and w[j][0].isupper():
            j += 1
        name = re.sub(r"[^\w\s]", "", " ".join(w[i:j])).strip()
        if len(name) > 1 and name not in found:
            found.append(name)
        i = j
    return found[:20]


def test_names_against_a_scan(spark):
    rng = random.Random(1)
    pool = ["Ab", "A", "cd", "Ef.", "gh!", "Éa", "été", "I?", "X-y", "(Zed)", "QQ"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["Big " * 20_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.capitalised_runs("t").alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [names(t) for t in texts]


def test_default_samples_expand_to_nine_rows(spark):
    out = C.expand_entries(S.default_samples(spark)).collect()
    assert len(out) == 9
    assert sorted(r["form"] for r in out) == ["as_is"] + ["question"] * 4 + ["statement"] * 4
    alice = next(r for r in out if r["form"] == "question" and "alice" in r["text"])
    assert alice["response"] == "Yes, alice loves bob." and alice["should_respond"] == 1


def test_mixed_json_samples(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"t","entities":["a"],"concepts":["x",["y","z"]],"relations":[[0,1,"r"],["a","b","s"]],"entity_spans":[[0,1]],"should_respond":1}\n\n{"text":"u"}\n')
    rows = {r["text"]: r for r in S.samples(spark, str(tmp_path)).collect()}
    assert rows["t"]["concepts"] == [["x"], ["y", "z"]]
    assert [(r["head"], r["head_name"], r["rel"]) for r in rows["t"]["relations"]] == [(0, "0", "r"), (None, "a", "s")]
    assert rows["u"]["should_respond"] == 0 and rows["u"]["concepts"] is None


def test_vectors_skip_short_lines_and_keep_the_last(spark, tmp_path):
    (tmp_path / "v.txt").write_text("4 2\na 1 2\nb 3\nc 5 6\na 7 8\n")
    assert {r["entity"]: (r["id"], r["vec"]) for r in S.vectors_text(spark, str(tmp_path)).collect()} == {"a": (3, [7.0, 8.0]), "c": (2, [5.0, 6.0])}


def test_unknown_kind_of_set(spark):
    with pytest.raises(ValueError):
        S.load(spark, "nothing", "x")


def test_triplets_need_all_three(spark):
    text = "<triplet> a <subj> r <obj> b <triplet> <subj> r <obj> b<triplet> c <subj> s <obj> d <e>"
    assert [tuple(t) for t in one(spark, C.parse_triplets(F.lit(text)))] == [("a", "r", "b"), ("c", "s", "d")]


def test_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string")
    out = rows.select(T.statement_to_question("t").alias("q"), T.is_question("t").alias("i"), T.capitalised_runs("t").alias("n"), T.preview("t").alias("p")).collect()
    assert out[0]["q"] is None and out[1]["q"] == "" and out[1]["i"] is False and out[1]["n"] == [] and out[0]["p"] is None
