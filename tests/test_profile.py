import pytest
from pyspark.sql import functions as F

from cleanframe.operators import profile as p
from cleanframe.operators.charts import box_plot, histogram


def rows(spark):
    cells = [
        ("1", "yes", "b", None, "5"), ("1.0", "No", "a", " ", "x"), ("3", "TRUE", "a", "", "7"),
        (None, "0", "b", None, "9"), ("5", "y", "c", None, None),
    ]
    return spark.createDataFrame(cells, "n string, flag string, t string, none string, mixed string")


def profiles(spark, **options):
    return {r["name"]: r for r in p.profile(rows(spark), **options).collect()}


def test_types_counts_and_numbers(spark):
    got = profiles(spark)
    kinds = {n: r["data_type"] for n, r in got.items()}
    assert kinds == {"n": "NUMERIC", "flag": "BOOLEAN", "t": "TEXT", "none": "UNKNOWN", "mixed": "TEXT"}
    assert (got["n"]["unique_count"], got["n"]["null_count"], got["n"]["null_percent"]) == (4, 1, 20.0)
    # Numbers inside a text column are still summarised.
    assert (got["mixed"]["mean"], got["mixed"]["median"]) == (7.0, 7.0)
    assert got["none"]["most_common"] == "" and got["none"]["mean"] is None
    assert got["n"]["iqr"] == got["n"]["q3"] - got["n"]["q1"]


def test_most_common_ties(spark):
    assert profiles(spark)["t"]["most_common"] == "a"
    by_position = rows(spark).withColumn("at", F.monotonically_increasing_id())
    first = p.profile(by_position, ["t"], order=F.col("at")).first()
    assert first["most_common"] == "b"


def test_long_texts_are_counted_by_digest(spark):
    stem = "x" * 100
    texts = [stem + "b"] * 3 + [stem + "a"] * 3 + [stem + "c"] * 2 + ["short"] * 3 + ["y" * 65]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    got = p.profile(df, ["t"]).first()
    assert (got["unique_count"], got["most_common"]) == (5, "short")
    got = p.profile(df.filter("t <> 'short'"), ["t"]).first()
    assert (got["unique_count"], got["most_common"]) == (4, stem + "a")
    assert p.profile(df, ["t"], order=F.col("i")).first()["most_common"] == stem + "b"


def test_sketched_distinct(spark):
    assert profiles(spark, exact_distinct=False)["t"]["unique_count"] == 3


def test_display(spark):
    shown = {r["Column"]: r for r in p.display_table(p.profile(rows(spark))).collect()}
    assert (shown["n"]["Mean"], shown["n"]["Max"], shown["t"]["Mean"]) == ("2.5000", "5", "—")
    assert shown["n"]["Null %"] == "20.0%"
    strip = {r["name"]: r["stats"] for r in p.stats_strip(p.profile(rows(spark))).collect()}
    assert strip["n"].startswith("Mean 2.500   Median 2.000") and "n/a" in strip["t"]


def test_empty_table(spark):
    got = p.profile(spark.createDataFrame([], "x string")).first()
    assert (got["data_type"], got["total_count"], got["null_percent"]) == ("UNKNOWN", 0, 0.0)


def test_infer_types(spark):
    assert dict(p.infer_types(rows(spark)).dtypes) == {
        "n": "double", "flag": "string", "t": "string", "none": "string", "mixed": "string",
    }


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (10.0,), (float("nan"),), (None,)], "x double")
    got = [(r["bin"], r["count"]) for r in histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 2)]
    flat = histogram(df.filter("x = 10"), "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [0, 0, 0, 0, 2]
    assert histogram(df.filter("x is null"), "x", 5).count() == 0
    with pytest.raises(ValueError):
        histogram(df, "x", 4)


def test_box_plot_whiskers(spark):
    df = spark.createDataFrame([(float(i),) for i in [*range(20), 1000]], "x double")
    got = box_plot(p.profile(df)).first()
    assert got["lower_whisker"] == 0.0 and got["upper_whisker"] < 1000
