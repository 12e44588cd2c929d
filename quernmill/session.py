"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quernmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; a running one is returned as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master.startswith("local") and not master.startswith("local-cluster")


def _named_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is named and all is one process, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not _is_local(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quernmill-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{_named_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint in the folder that all executors share, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    ship(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_named_folder(spark))
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by PYTHONPATH or, on this machine, in the working folder."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _is_local(context.master):
        there.append(os.getcwd())
    if root in there or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quernmill-"), "quernmill"), "zip", root, "quernmill")
    context.addPyFile(archive)
