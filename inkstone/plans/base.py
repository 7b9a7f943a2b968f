"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MADE = 4000  # rows of which a task makes documents


ROWS = 250_000  # of a narrow table, that a task sorts and hashes


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows of a stored table by ``key``, in tasks whose number follows that of the rows: their memory does not grow with the
    table, and none of it is held before the shuffle."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS)), key)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a stored table dealt to tasks by their number. A document takes its time however few bytes its row has, and a
    file of a million such rows is one split or a few."""
    rows = df.count()  # of a stored table: its files say so
    tasks = max(-(-rows // MADE), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // 100)), 1)
    return df.repartition(tasks, *by)
