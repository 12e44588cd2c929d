"""Registration of queries, and the sample tables that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.session import table


class Book:
    """Queries of a module and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return add


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(x: Column | str, places: int) -> Column:
    """A double rounded as SQL does it: what is negative and rounds to nothing is -0.0, which Spark's own rounding makes 0.0."""
    value = F.col(x) if isinstance(x, str) else x
    return F.signum(value) * F.round(F.abs(value), places)


#: Relation instances of the star schema: a customer's order by segment, nation and priority.
FACTS_SQL = """(select o_orderkey as sample_id, c_mktsegment as head_concept, n_name as tail_concept, case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'urgent' when o_orderstatus = 'F' then 'filled' else 'placed' end as relation
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, head_concept, relation, tail_concept)."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("o_orderpriority").rlike("^[12]"), "urgent").when(F.col("o_orderstatus") == "F", "filled").otherwise("placed")
    return rows.select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("head_concept"), F.col("n_name").alias("tail_concept"), kind.alias("relation"))
