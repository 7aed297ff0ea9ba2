"""Sorting and looking up without a task for a hot key and without reading the table twice."""

import pytest
from pyspark.sql import functions as F

from cleanframe import session
from cleanframe.operators.ordering import lookup, sort_rows

KEYS = ["hot"] * 600 + [None] * 300 + [f"k{i % 40}" for i in range(200)] + ["new", ""]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordering") / "t")
    spark.createDataFrame([(k, i % 7) for i, k in enumerate(KEYS)], "k string, n int").repartition(5).write.parquet(path)
    return path


@pytest.fixture
def mapping(spark):
    known = {k: KEYS.count(k) for k in set(KEYS) - {None, "new"}}
    rows = [(k, n, i) for i, (k, n) in enumerate(sorted(known.items()))]
    return spark.createDataFrame(rows, "k string, n long, code long"), {k: i for k, _, i in rows}, sum(known.values())


def looked_up(spark, table, mapping):
    return lookup(spark.read.parquet(table), ["k"], mapping[0], False, mapping[2], "code")


def test_lookup_by_shuffle_gives_every_row_its_code(spark, table, mapping):
    got = [tuple(r) for r in looked_up(spark, table, mapping).collect()]
    assert sorted(got, key=repr) == sorted(((k, i % 7, mapping[1].get(k)) for i, k in enumerate(KEYS)), key=repr)


def test_lookup_reads_the_table_once_and_spreads_hot_and_missing_keys(spark, table, mapping):
    joined = looked_up(spark, table, mapping)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [len(p) for p in looked_up(spark, table, mapping).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == len(KEYS) and max(sizes) < 600  # the hot key alone has 600 rows


def test_lookup_with_zeros_of_both_signs_and_nan(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)] + [(1.0,)] * 40, "x double")
    mapping = spark.createDataFrame([(0.0, 2, 7), (float("nan"), 1, 8), (1.0, 40, 9)], "x double, n long, code long")
    got = [r["code"] for r in lookup(df, ["x"], mapping, False, 43, "code").collect()]
    assert sorted(got, key=str) == sorted([7, 7, 8, None] + [9] * 40, key=str)


def test_lookup_in_an_empty_mapping(spark, table, mapping):
    got = lookup(spark.read.parquet(table), ["k"], mapping[0].limit(0), False, 0, "code")
    assert got.filter("code is not null").isEmpty() and got.count() == len(KEYS)


def test_sorting_files_writes_no_copy_of_the_table(spark, table):
    made = len(session._MADE)
    got = [r["k"] for r in sort_rows(spark.read.parquet(table).filter("n >= 0"), [F.col("k").asc_nulls_last()]).collect()]
    assert got == sorted(KEYS, key=lambda k: (k is None, k or "")) and len(session._MADE) == made


def test_sorting_what_files_do_not_number(spark, table):
    df = spark.read.parquet(table)
    grouped = df.groupBy("k").agg(F.count("*").alias("n"))
    doubled = df.unionByName(df)
    renamed = df.withColumnRenamed("n", "_metadata")
    for unsorted in (grouped, doubled, renamed):
        got = [r["k"] for r in sort_rows(unsorted, [F.col("k").asc_nulls_last()]).collect()]
        assert got == sorted([r["k"] for r in unsorted.collect()], key=lambda k: (k is None, k or ""))
