"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quernmill.llm import bpe, decontaminate, fingerprints, langid, neardup, pii, quality, secretscan, substrings, toxicity

LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(30_000))
TEXT = " ".join(f"v{i * 31 % 1009}" for i in range(120))
ROWS = [(1, TEXT), (1, TEXT), (2, TEXT), (None, "a null id with some words"), (3, None), (4, ""), (5, "  \n "), (6, LONG), (7, LONG), (8, "!!!"), (9, "x" * 200_000), (10, "é"), (11, "tie"), (12, "tie")]
EXTRA = ["node", "row", "gone", "nth", "keys", "seg", "sig", "path", "blob", "pid", "item", "score", "_id", "_y", "_h", "key", "stays", "lang"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    return frame.select("doc_id", "text", "n_chars", *[F.lit("en").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "a"), (6, 0, 1, "b"), (None, 1, 1, "c"), (77, 0, None, "d"), (1, 1, 0, "a")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, TEXT[:200], "x"), (1, TEXT[:200], "x"), (None, None, "y"), (2, "", "z"), (3, "too short", "z")], "item_id long, text string, node string")


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect() if r["doc_id"]}
    assert len(got) == 12 and got[1] == got[2] and got[6] == got[7]
    assert got[3] is None and got[4] is None and got[5] is None and got[8] is None and len(got[9]) == 64
    assert fingerprints.fingerprint(docs).count() == len(ROWS)
    assert fingerprints.fingerprint(none).count() == 0


def test_decontamination(docs, none, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert got == {(1, 1), (2, 1)}
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert decontaminate.matches(none, benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(ROWS)


def test_near_duplicates(docs, none):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 8, 9, 10, 11]
    assert neardup.keep_one(none).count() == 0 and neardup.groups(none).count() == 0


def test_substrings(docs, none):
    got = sorted(tuple(r) for r in substrings.repeats(docs).collect())
    assert got == [(1, 0, 120), (2, 0, 120), (6, 0, 30_000), (7, 0, 30_000)]
    assert substrings.repeats(none).count() == 0


def test_bpe(docs, none):
    rows = bpe.encode_docs(docs).collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] or r["tokens"] is None for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["tokens"] is None and by[3]["n_tokens"] is None and by[4]["n_tokens"] == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode_docs(bpe.encode_docs(docs)).collect()}
    assert back[6] == LONG and back[3] is None and back[4] == ""
    assert bpe.encode_docs(none).count() == 0


def test_pii(docs, none):
    model = pii.train(pii.labelled(200), epochs=10)
    masked = pii.mask(docs, model)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert {r["text"] for r in masked.where("doc_id in (3, 4)").collect()} == {None, ""}
    assert pii.find(none, model).count() == 0 and pii.mask(none, model).count() == 0


def test_language(docs, none):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert got[3]["language"] == "und" and got[4]["language"] == "und" and got[3]["margin"] is None
    assert langid.identify(docs, langid.fit(none)).where("language <> 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r["p_toxic"] == 0.0 for r in rows if r["doc_id"] in (3, 4, 5, 8))
    empty = toxicity.fit(docs, labels.limit(0))
    kept = toxicity.keep_clean(docs, empty)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_quality(docs, none, labels):
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(r["p_good"] == 0.0 and not r["good"] for r in rows if r["doc_id"] in (3, 4))
    assert quality.score(docs, quality.fit(none, labels)).where("good").count() == 0
    assert quality.score(none, quality.fit(docs, labels)).count() == 0


def test_secrets(docs, none, tmp_path):
    scanned, found = secretscan.scan(docs)
    assert found.count() == 0 and scanned.select("blob").distinct().count() == 9
    scanned, found = secretscan.scan(none)
    assert scanned.count() == 0 and found.count() == 0
    assert secretscan.update(none, f"{tmp_path}/none").count() == 0
    own = (secretscan.Rule("long", 1, r"x{200000}"), secretscan.Rule("tie", 1, "tie", ("tie",)))
    got = secretscan.update(docs, f"{tmp_path}/some", own).collect()
    assert {(r["doc_id"], r["rule"], r["occurrences"]) for r in got} == {(9, "long", 1), (11, "tie", 1), (12, "tie", 1)} and len(got) == 3
