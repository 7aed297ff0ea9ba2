"""Registration of queries, and the tables with missing cells that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with missing discounts, and missing or blank return flags."""
    flag = F.when(every("l_orderkey", 13), None).when(every("l_orderkey", 17), "  ")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.when(~every("l_orderkey", 11), F.col("l_discount")).alias("l_discount"),
        flag.otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )


LINEITEM = """
li AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN '  '
              ELSE l_returnflag END AS l_returnflag
  FROM lineitem)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text: missing, blank and non-numeric cells among the numbers."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(every("l_orderkey", 11), None)
        .when(every("l_orderkey", 13), " ")
        .when(every("l_orderkey", 17), "n/a")
        .otherwise(F.col("l_extendedprice").cast("string"))
        .alias("price"),
    )


PRICES = """
pr AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN ' '
              WHEN l_orderkey % 17 = 0 THEN 'n/a'
              ELSE CAST(l_extendedprice AS VARCHAR) END AS price,
         CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0
              THEN l_extendedprice END AS v
  FROM lineitem)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing and blank priorities."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus",
        F.when(every("o_orderkey", 7), None)
        .when(every("o_orderkey", 19), " ")
        .otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
    )


ORDERS = """
od AS (
  SELECT o_orderkey, o_totalprice, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ' '
              ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def quartiles6(source: str, column: str, where: str = "TRUE") -> str:
    """SQL for the three quartiles at rank p(n+1), as one row (q1, median, q3)."""
    parts = []
    for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        pos = f"least(greatest({p} * (n + 1), 1), n)"
        low = f"max(CASE WHEN k = floor({pos}) THEN v END)"
        high = f"max(CASE WHEN k = least(floor({pos}) + 1, n) THEN v END)"
        share = f"max({pos} - floor({pos}))"
        parts.append(f"{low} + {share} * ({high} - {low}) AS {name}")
    return f"""
  SELECT {', '.join(parts)}
  FROM (SELECT CAST({column} AS DOUBLE) AS v,
               row_number() OVER (ORDER BY {column}) AS k, count(*) OVER () AS n
        FROM {source} WHERE {column} IS NOT NULL AND {where})"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})
