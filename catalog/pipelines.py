"""Whole pipelines (PL1-PL4) and joins with statistics (J1, J2, W1-W4 inside them)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from catalog.registry import LINEITEM, lineitem, quartiles6, query, rounded, table
from cleanframe.plans.pipeline import fit, run
from cleanframe.plans.spec import Op, PipelineSpec, SpecError, Step
from cleanframe.session import small_table, table_schema

PRICE_MODEL = PipelineSpec(
    (
        Step(Op.FILL_MISSING_MEAN, "l_discount"),
        Step(Op.REMOVE_OUTLIERS_IQR, "l_extendedprice"),
        Step(Op.NORMALIZE_MINMAX, "l_extendedprice"),
        Step.filter("l_quantity", ">=", "10"),
    )
)

# Prices to the third power: some then lie outside the fences.
_PRICE_MODEL = f"""
WITH {LINEITEM.replace("l_extendedprice,", "l_extendedprice * l_extendedprice * l_extendedprice / 1e9 AS l_extendedprice,")},
q AS ({quartiles6('li', 'l_extendedprice')}),
f AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag,
         coalesce(l_discount, (SELECT avg(l_discount) FROM li)) AS l_discount
  FROM li, q
  WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM f)
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, round(l_discount, 6) AS l_discount,
       round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice
FROM f, m WHERE l_quantity >= 10"""


def _cubed(spark, sf_dir):
    price = F.col("l_extendedprice")
    return lineitem(spark, sf_dir).withColumn("l_extendedprice", price * price * price / 1e9)


@query(_PRICE_MODEL)
def price_pipeline(spark, sf_dir):
    df = run(_cubed(spark, sf_dir), PRICE_MODEL)
    return rounded(df, "l_discount", "l_extendedprice")


@query(_PRICE_MODEL)
def price_pipeline_from_json(spark, sf_dir):
    spec = PipelineSpec.from_json(PRICE_MODEL.to_json())
    return rounded(run(_cubed(spark, sf_dir), spec), "l_discount", "l_extendedprice")


@query(f"""WITH {LINEITEM}, s AS (
  SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS d1, avg(l_discount) AS m2 FROM li),
b AS (SELECT coalesce(l_discount, m2) AS d FROM li, s),
t AS (SELECT avg(d) AS m3, stddev_samp(d) AS d3 FROM b)
SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / d1, 6) AS l_quantity,
       round((coalesce(l_discount, m2) - m3) / d3, 6) AS l_discount
FROM (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity,
        CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS l_discount FROM lineitem), s, t""")
def pipeline_fitted_on_other_rows(spark, sf_dir):
    """Statistics of one table applied to another."""
    spec = PipelineSpec(
        (
            Step(Op.NORMALIZE_ZSCORE, "l_quantity"),
            Step(Op.FILL_MISSING_MEAN, "l_discount"),
            Step(Op.NORMALIZE_ZSCORE, "l_discount"),
        )
    )
    columns = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    fitted = fit(lineitem(spark, sf_dir).select(*columns), spec)
    other = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") + 1).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("l_discount"),
    )
    return rounded(fitted.transform(other), "l_quantity", "l_discount")


@query(f"""WITH {LINEITEM}, a AS (
  SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM li
  WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL),
s AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2,
             quantile_cont(l_quantity, 0.75) AS q3 FROM a)
SELECT round((l_quantity - q2) / (q3 - q1), 6) AS l_quantity, round(l_discount, 6) AS l_discount,
       dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag FROM a, s""")
def sql_pipeline(spark, sf_dir):
    """Steps that shuffle come before steps that read statistics again."""
    spec = PipelineSpec(
        (
            Step(Op.DROP_MISSING_ROWS),
            Step(Op.REMOVE_DUPLICATES),
            Step(Op.NORMALIZE_ROBUST, "l_quantity"),
            Step(Op.LABEL_ENCODE, "l_returnflag"),
        )
    )
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_returnflag")
    return rounded(run(df, spec, form="sql"), "l_quantity", "l_discount")


@query(f"""WITH {LINEITEM}
SELECT 'TRAIN_TEST_SPLIT' AS operation, CAST(l_discount AS VARCHAR) AS param,
  coalesce(l_discount, 0.8) > 0 AND coalesce(l_discount, 0.8) < 1 AS accepted, count(*) AS n FROM li GROUP BY l_discount
UNION ALL SELECT 'FILTER_ROWS', '==|' || l_returnflag, coalesce(trim(l_returnflag), '') <> '', count(*) FROM li GROUP BY l_returnflag""")
def parameter_checks(spark, sf_dir):
    """PL6: the cells of two columns as parameters of steps; each distinct one is judged as when a step is added."""
    df = lineitem(spark, sf_dir)
    cells = {Op.TRAIN_TEST_SPLIT: F.col("l_discount").cast("string"), Op.FILTER_ROWS: F.concat(F.lit("==|"), "l_returnflag")}
    judged = []
    for op, cell in cells.items():
        for param, n in df.groupBy(cell.alias("param")).count().collect():  # eleven discounts, a few flags
            try:
                Step(op, "x", param).validate()
                accepted = True
            except SpecError:
                accepted = False
            judged.append((op.value, param, accepted, n))
    return small_table(spark, judged, table_schema(operation=T.StringType(), param=T.StringType(), accepted=T.BooleanType(), n=T.LongType()))
