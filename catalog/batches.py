"""One pipeline over many files (B1, B2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import orders, query, table
from cleanframe.plans.batch import process, status_counts
from cleanframe.plans.spec import Op, PipelineSpec, Step
from cleanframe.session import scratch_path
from cleanframe.sources.writers import write_csv

# Orders per input file; every file is cleaned with its own statistics.
PER_FILE = 4_000


def _files(spark, df, label):
    """CSV files of PER_FILE consecutive orders."""
    path = scratch_path(spark, label)
    keyed = df.withColumn("file", F.floor(F.col("o_orderkey") / PER_FILE)).repartition("file")
    write_csv(keyed, path, partition_by=["file"])
    return f"{path}/*/*.csv"


_SCALED = f"""
WITH od AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
         floor(o_orderkey / {PER_FILE}) AS file FROM orders),
f AS (
  SELECT file, o_orderkey, coalesce(price, round(median(price) OVER (PARTITION BY file), 6)) AS price FROM od)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
  CAST(printf('%.6f', (price - min(price) OVER (PARTITION BY file))
    / (max(price) OVER (PARTITION BY file) - min(price) OVER (PARTITION BY file))) AS DOUBLE) AS price
FROM f"""


@query(_SCALED)
def batch_statistics_per_file(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    spec = PipelineSpec((Step(Op.FILL_MISSING_MEDIAN, "price"), Step(Op.NORMALIZE_MINMAX, "price")))
    out = scratch_path(spark, "batch")
    process(spark, _files(spark, df, "orders"), spec, out)
    cleaned = spark.read.option("header", True).csv(out)
    return cleaned.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("price").cast("double").alias("price"),
    )


@query("SELECT o_orderkey AS output, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'F'")
def batch_with_a_column_named_output(spark, sf_dir):
    """The folders of the cleaned files take another name where the table has such a column."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("output"), F.col("o_orderstatus").alias("v"))
    out = scratch_path(spark, "batch")
    process(spark, _files(spark, df, "orders"), PipelineSpec((Step.filter("v", "!=", "F"),)), out)
    cleaned = spark.read.option("header", True).csv(out)
    return cleaned.select(F.col("output").cast("bigint").alias("output"), "v")


@query(f"""SELECT 'SUCCESS' AS status, count(DISTINCT floor(o_orderkey / {PER_FILE})) AS files, count(*) AS rows
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 19 <> 0
UNION ALL
SELECT 'SKIPPED', count(DISTINCT floor(o_orderkey / {PER_FILE})), 0 FROM orders""")
def batch_report(spark, sf_dir):
    """Half of the files lack the column that a step needs."""
    full = _files(spark, orders(spark, sf_dir), "orders")
    bare = _files(spark, orders(spark, sf_dir).drop("o_orderpriority"), "bare")
    spec = PipelineSpec(
        (Step(Op.DROP_MISSING_ROWS), Step.regex("o_orderpriority", "^[0-9]-", ""))
    )
    report = process(spark, [full, bare], spec, scratch_path(spark, "batch"))
    rows = report.groupBy("status").agg(F.sum("row_count").alias("rows"))
    return status_counts(report).join(rows, "status")
