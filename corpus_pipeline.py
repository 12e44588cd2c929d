"""From raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again.  All stages but the last return the
columns of ``docs``, more than those of ``documents`` included.

Defined results: an empty table gives an empty one; a null or empty text isn't toxic, has no near
duplicate, no benchmark item and no personal data, and is encoded to null or nothing; rows that repeat
id and text count as one near-duplicate group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernmill.llm import bpe, decontaminate, neardup, pii, toxicity
from quernmill.session import shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones, doesn't hold toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even an edited one."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.mask(docs, pii.train(pii.labelled()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its text."""
    return bpe.encode_docs(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: SQL can express neither the classifiers nor the estimates of similarity; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; the rows of the last."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
