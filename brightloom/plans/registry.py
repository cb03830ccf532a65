"""name -> query, and name -> equivalent SQL. A query takes (spark, directory of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory, as attributes."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.directory, name)

    def sql(self, text: str, *names: str) -> DataFrame:
        """Spark SQL over the named tables."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(sql: str | None):
    """Register a function of Tables under its name, with the SQL that gives the same rows."""
    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, directory: f(Tables(spark, directory))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


from brightloom.plans import changes, relational, search  # noqa: E402, F401  they register their queries
