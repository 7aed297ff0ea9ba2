import math
import random

import pytest
from pyspark.sql import functions as F

from cleanframe.operators import labels, ordering
from cleanframe.plans.pipeline import fit, run, run_steps
from cleanframe.plans.spec import Op, PipelineSpec, SpecError, Step
from cleanframe.operators.split import split_cut
from cleanframe.operators.ordering import number_rows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def people(spark, n=400):
    """Text cells of every kind, with a position."""
    rng = random.Random(3)
    cities = ["Oslo", "Rome", "Bonn", "new york", "", None, "  "]

    def age(i):
        return rng.choice([str(rng.randint(18, 70)), f"{rng.gauss(40, 9):.3f}", "", None, "old", " 30 "])

    return [(i, age(i), rng.choice(cities), str(rng.randint(1, 9) ** 5)) for i in range(n)]


SCHEMA = "id long, age string, city string, pay string"


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def blank(text):
    return text is None or text.strip() == ""


def shown(x):
    return f"{x:.6f}".rstrip("0") + ("0" if f"{x:.6f}".rstrip("0").endswith(".") else "")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_mean_fill_writes_six_decimals_into_text(spark):
    rows = people(spark)
    got = by_id(run_steps(frame(spark, rows, SCHEMA), Step(Op.FILL_MISSING_MEAN, "age")))
    numbers = [number(a) for _, a, _, _ in rows if number(a) is not None]
    mean = shown(sum(numbers) / len(numbers))
    for i, age, _, _ in rows:
        assert got[i]["age"] == (mean if blank(age) else age)


def test_scaling_leaves_text_cells_alone(spark):
    rows = people(spark)
    got = by_id(run_steps(frame(spark, rows, SCHEMA), Step(Op.NORMALIZE_MINMAX, "age")))
    numbers = [number(a) for _, a, _, _ in rows if number(a) is not None]
    lo, hi = min(numbers), max(numbers)
    for i, age, _, _ in rows:
        if number(age) is None:
            assert got[i]["age"] == age
        else:
            assert float(got[i]["age"]) == pytest.approx((number(age) - lo) / (hi - lo), abs=6e-7)


def test_scaling_keeps_a_text_column_text(spark):
    df = run_steps(frame(spark, people(spark), SCHEMA), Step(Op.NORMALIZE_ZSCORE, "pay"))
    assert dict(df.dtypes)["pay"] == "string"
    pay = F.col("pay").cast("double")
    mean, sd = df.agg(F.avg(pay), F.stddev_samp(pay)).first()
    assert mean == pytest.approx(0, abs=1e-5) and sd == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("op", [Op.NORMALIZE_MINMAX, Op.NORMALIZE_ZSCORE, Op.NORMALIZE_ROBUST])
def test_no_spread(spark, op):
    df = frame(spark, [(1, "4"), (2, "4"), (3, None)], "id long, x string")
    assert [r["x"] for r in run_steps(df, Step(op, "x")).orderBy("id").collect()] == ["4", "4", None]
    typed = df.withColumn("x", F.col("x").cast("double"))
    strict = run_steps(typed, Step(op, "x"), form="sql")
    assert [r["x"] for r in strict.orderBy("id").collect()] == [None, None, None]


def test_no_quartile_range_leaves_the_column_alone(spark):
    cells = ["5"] * 10 + ["9", "n/a", "NaN", None]
    df = frame(spark, [(i, c) for i, c in enumerate(cells)], "id long, x string")
    got = run_steps(df, Step(Op.NORMALIZE_ROBUST, "x")).orderBy("id").collect()
    assert [r["x"] for r in got] == cells


@pytest.mark.parametrize("op", [Op.NORMALIZE_MINMAX, Op.NORMALIZE_ZSCORE, Op.NORMALIZE_ROBUST])
def test_fitted_scaling_keeps_words_of_another_table(spark, op):
    train = frame(spark, [("1",), ("2",), ("3",)], "x string")
    test = frame(spark, [(1, "1"), (2, "n/a"), (3, "5"), (4, None), (5, "NaN")], "id long, x string")
    got = [r["x"] for r in fit(train, PipelineSpec((Step(op, "x"),))).transform(test).orderBy("id").collect()]
    assert got[1] == "n/a" and got[3] is None and got[4] == "" and float(got[2]) > float(got[0])


def test_row_order_survives_steps_on_its_column(spark):
    rows = [(3, "b"), (1, "a"), (2, "c"), (4, "b"), (5, None)]
    df = frame(spark, [(str(i), c, i % 2) for i, c in rows], "id string, c string, k int")
    rewrite = Step.regex("id", "^.*$", "same")
    coded = run_steps(df, rewrite, Step(Op.LABEL_ENCODE, "c"), order_by="id").collect()
    assert sorted(str(r["c"]) for r in coded) == ["0", "1", "2", "2", "None"]
    assert {r["c"] for r in coded if r["k"] == 0} == {1, 2}  # c came second; the last b has the code of the first
    for drop in (rewrite, Step(Op.ONE_HOT_ENCODE, "id"), Step(Op.CAST_COLUMN, "id", "boolean"), Step(Op.LABEL_ENCODE, "id")):
        placed = run_steps(df, drop, Step(Op.SORT_COLUMN, "k"), order_by="id").collect()
        assert [r["c"] for r in placed] == ["c", "b", "a", "b", None], drop
    fitted = fit(df, PipelineSpec((rewrite, Step(Op.SORT_COLUMN, "k"))), order_by="id")
    assert [r["c"] for r in fitted.transform(df).collect()] == ["c", "b", "a", "b", None]


def test_sort_keeps_the_sign_of_zero_and_cuts_hot_copies(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    zeros = spark.range(3000, numPartitions=3).select((F.col("id") * -0.0).alias("z"), F.lit("x").alias("t"))
    got = run_steps(zeros.unionAll(zeros.limit(5)), Step(Op.SORT_COLUMN, "t"))
    assert {math.copysign(1, r["z"]) for r in got.collect()} == {-1.0} and got.count() == 3005
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange rangepartitioning") == 1
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parameters_are_checked_when_a_pipeline_runs(spark):
    df = frame(spark, [("x",)], "text string")
    for bad in (Step(Op.TRAIN_TEST_SPLIT, None, "1.5"), Step.filter("text", ">", " "), Step.regex("text", "", "")):
        with pytest.raises(SpecError):
            run_steps(df, bad)
    with pytest.raises(SpecError, match="Invalid regex"):
        run_steps(df, Step.regex("text", "(x)", "$3"))
    assert run_steps(df, Step.regex("text", "(x)", "$1$1")).first()["text"] == "xx"


def test_one_hot_has_no_cap_of_its_own(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("x"))
    assert len(run_steps(df, Step(Op.ONE_HOT_ENCODE, "x")).columns) == 1200


def test_outliers_keep_missing_text_and_nan(spark):
    cells = [str(i) for i in range(20)] + ["1e6", "-1e6", None, " ", "x", "NaN"]
    df = frame(spark, [(c,) for c in cells], "x string")
    got = [r["x"] for r in run_steps(df, Step(Op.REMOVE_OUTLIERS_IQR, "x")).collect()]
    assert sorted(got, key=str) == sorted([c for c in cells if c not in ("1e6", "-1e6")], key=str)


@pytest.mark.parametrize("operator", [">", "<", ">=", "<=", "==", "!=", "contains", "~"])
@pytest.mark.parametrize("target", ["30", "NaN", "old", "a|b", "%"])
def test_filter_against_brute_force(spark, operator, target):
    cells = ["30", "30.0", " 30 ", "31", "29", "NaN", "old", "OLD 50%", "a|b", "", None, "-5", "Infinity"]
    df = frame(spark, [(c,) for c in cells], "x string")

    def keeps(c):
        if blank(c):
            return True
        if operator in ("==", "!="):
            return (c == target) == (operator == "==")
        if operator == "contains":
            return target.lower() in c.lower()
        v, t = number(c), number(target)
        if operator == "~" or v is None or t is None:
            return True
        return {">": v > t, "<": v < t, ">=": v >= t, "<=": v <= t}[operator]

    got = [r["x"] for r in run_steps(df, Step.filter("x", operator, target)).collect()]
    assert sorted(got, key=str) == sorted([c for c in cells if keeps(c)], key=str)


def test_filter_parameter_without_operator():
    assert Step(Op.FILTER_ROWS, "x", "Oslo").filter_parts() == ("==", "")
    assert Step(Op.FILTER_ROWS, "x", "|Oslo").filter_parts() == ("==", "Oslo")
    assert Step(Op.FILTER_ROWS, "x", None).filter_parts() == ("==", "")
    assert Step(Op.FILTER_ROWS, "x", ">|a|b").filter_parts() == (">", "a|b")


def test_regex_touches_only_its_column_and_no_blanks(spark):
    df = frame(spark, [("lot 17/b", "lot 3"), ("", "open"), (None, None)], "parcel string, note string")
    got = run_steps(df, Step.regex("parcel", "[0-9]+/", "no. ")).collect()
    assert [tuple(r) for r in got] == [("lot no. b", "lot 3"), ("", "open"), (None, None)]
    turned = run_steps(
        frame(spark, [("14:2031",)], "mark string"), Step.regex("mark", "([0-9]{2}):([0-9]{4})", "year $2, week $1")
    )
    assert turned.first()["mark"] == "year 2031, week 14"


def test_bad_pattern_is_rejected_only_for_present_columns(spark):
    df = frame(spark, [("x",)], "text string")
    with pytest.raises(SpecError, match="Invalid regex"):
        run_steps(df, Step.regex("text", "[", ""))
    assert run_steps(df, Step.regex("other", "[", "")).count() == 1
    with pytest.raises(SpecError, match="has no column"):
        run_steps(df, Step.regex("other", "x", ""), on_missing="error")


def test_duplicates_keep_one_copy_and_are_idempotent(spark):
    df = frame(spark, [("a", None), ("a", ""), ("a", "b"), ("a", "b")], "x string, y string")
    once = run_steps(df, Step(Op.REMOVE_DUPLICATES))
    assert once.count() == 2
    assert run_steps(once, Step(Op.REMOVE_DUPLICATES)).count() == 2


def first_seen(rows, at):
    codes = {}
    for r in rows:
        if not blank(r[at]):
            codes.setdefault(r[at], len(codes))
    return codes


@pytest.mark.parametrize("small", [True, False])
def test_label_codes_by_first_appearance(spark, monkeypatch, small):
    if not small:
        # The ways taken for millions of values: written ranks, hot keys apart.
        monkeypatch.setattr(labels, "DRIVER_VALUES", 0)
        monkeypatch.setattr(labels, "BROADCAST_ROWS", 0)
    rows = people(spark) + [(1000 + i, "1", "Hot", "1") for i in range(800)]
    rows += [(3000 + i, "1", f"rare{i % 37}", "1") for i in range(60)]
    codes = first_seen(rows, 2)
    df = frame(spark, rows, SCHEMA).repartition(7)
    got = by_id(run_steps(df, Step(Op.LABEL_ENCODE, "city"), order_by="id"))
    assert {i: got[i]["city"] for i in got} == {r[0]: codes.get(r[2]) for r in rows}


@pytest.mark.parametrize("small", [True, False])
def test_label_codes_by_value(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(labels, "DRIVER_VALUES", 0)
        monkeypatch.setattr(labels, "BROADCAST_ROWS", 0)
    df = frame(spark, [(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "")], "id long, x string")
    got = by_id(run_steps(df, Step(Op.LABEL_ENCODE, "x"), form="sql"))
    assert [got[i]["x"] for i in range(1, 6)] == [2, 1, 3, 2, 0]


def test_label_codes_need_an_order(spark):
    with pytest.raises(SpecError, match="order_by"):
        run_steps(frame(spark, [("a",)], "x string"), Step(Op.LABEL_ENCODE, "x"))


def test_label_codes_per_group(spark):
    rows = [("f1", 1, "b"), ("f1", 2, "a"), ("f2", 3, "a"), ("f2", 4, None), ("f2", 5, "c")]
    df = frame(spark, rows, "__cf_file string, id long, x string")
    got = by_id(run(df, PipelineSpec((Step(Op.LABEL_ENCODE, "x"),)), order_by="id", group="__cf_file"))
    assert [got[i]["x"] for i in range(1, 6)] == [0, 1, 0, None, 1]


def test_one_hot_in_place_with_colliding_name(spark):
    df = frame(spark, [("b", 1), ("a", 2), (" ", 3), (None, 4)], "x string, x_a int")
    got = run_steps(df, Step(Op.ONE_HOT_ENCODE, "x"))
    assert got.columns == ["x_a_2", "x_b", "x_a"]
    assert [tuple(r) for r in got.orderBy("x_a").collect()] == [(0, 1, 1), (1, 0, 2), (0, 0, 3), (0, 0, 4)]
    strict = run_steps(df.drop("x_a"), Step(Op.ONE_HOT_ENCODE, "x"), form="sql")
    assert strict.columns == ["x_a", "x_b"]
    with pytest.raises(SpecError, match="more than 1"):
        run_steps(df, Step(Op.ONE_HOT_ENCODE, "x"), max_categories=1)


def test_one_hot_columns_can_be_used_by_later_steps(spark):
    df = frame(spark, [("b",), ("a",), ("a",)], "x string")
    got = run_steps(df, Step(Op.ONE_HOT_ENCODE, "x"), Step(Op.NORMALIZE_MINMAX, "x_a"))
    assert sorted(tuple(r) for r in got.collect()) == [(0.0, 1), (1.0, 0), (1.0, 0)]


def test_sort_by_number_or_text_with_missing_last(spark):
    cells = ["10", "9", None, "-1", "", "2.5"]
    df = frame(spark, [(i, c) for i, c in enumerate(cells)], "id long, x string")

    def ids(*steps):
        return [r["id"] for r in run_steps(df, *steps, order_by="id").collect()]

    assert ids(Step(Op.SORT_COLUMN, "x", "ascending")) == [3, 5, 1, 0, 2, 4]
    assert ids(Step(Op.SORT_COLUMN, "x", "descending")) == [0, 1, 5, 3, 2, 4]
    # A later step rewrites the key; the order stays that of the sorting step.
    assert ids(Step(Op.SORT_COLUMN, "x", "ascending"), Step.regex("x", ".*", "z")) == [3, 5, 1, 0, 2, 4]


def test_sorted_rows_feed_first_appearance(spark):
    df = frame(spark, [(1, "c", "3"), (2, "a", "1"), (3, "b", "2"), (4, "a", "9")], "id long, x string, k string")
    steps = (Step(Op.SORT_COLUMN, "k", "descending"), Step(Op.LABEL_ENCODE, "x"))
    got = run_steps(df, *steps, order_by="id").collect()
    assert [(r["id"], r["x"]) for r in got] == [(4, 0), (1, 1), (3, 2), (2, 0)]


def test_sort_then_duplicates_keeps_the_order(spark):
    df = frame(spark, [("b", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "k string, v string")
    got = run_steps(df, Step(Op.SORT_COLUMN, "k", "descending"), Step(Op.REMOVE_DUPLICATES)).collect()
    assert [r["k"] for r in got] == ["c", "b", "a"]


def test_hot_copies_are_sorted_in_pieces(spark):
    rows = [("m", 1)] * 500 + [(chr(97 + i % 26), i) for i in range(300)]
    df = frame(spark, rows, "k string, n int")
    got = [tuple(r) for r in run_steps(df, Step(Op.SORT_COLUMN, "k", "ascending")).collect()]
    assert sorted(got) == sorted(rows) and [k for k, _ in got] == sorted(k for k, _ in rows)
    positions = number_rows(ordering.sort_rows(df, [F.col("k"), F.col("n")]), "at").collect()
    assert sorted(r["at"] for r in positions) == list(range(800))


@pytest.mark.parametrize("ratio", [0.001, 0.3, 0.5, 0.8, 0.999])
def test_split_cut_is_the_cumulative_share(spark, ratio):
    rng = random.Random(4)
    words = ["hot"] * 700 + [str(rng.randint(0, 900)) for _ in range(1300)]
    df = frame(spark, [(w,) for w in words], "w string").select(F.md5("w").alias("h"))
    hashes = sorted(r["h"] for r in df.collect())
    last = {h: at for at, h in enumerate(hashes, 1)}
    cut = split_cut(df, F.col("h"), ratio)
    assert [h for h in hashes if h <= cut] == [h for h in hashes if last[h] / len(hashes) <= ratio]


def test_split_of_an_empty_table(spark):
    df = frame(spark, [], "x string")
    assert run_steps(df, Step(Op.TRAIN_TEST_SPLIT, None, "0.8"), form="sql").columns == ["x", "split_set"]


def test_statistics_steps_do_not_multiply_scans(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 1.5 as a", "id * 2.5 as b").write.parquet(path)
    steps = (
        Step(Op.FILL_MISSING_MEAN, "a"),
        Step(Op.NORMALIZE_ZSCORE, "a"),
        Step(Op.NORMALIZE_MINMAX, "b"),
        Step(Op.NORMALIZE_ROBUST, "a"),
    )
    fitted = fit(spark.read.parquet(path), PipelineSpec(steps))
    assert [len(s) for s, _ in fitted.segments] == [1, 2, 1]
    plan = fitted.transform(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_fitted_statistics_apply_to_other_rows(spark):
    train = frame(spark, [(1.0,), (3.0,)], "x double")
    fitted = fit(train, PipelineSpec((Step(Op.NORMALIZE_MINMAX, "x"),)))
    assert [r["x"] for r in fitted.transform(frame(spark, [(5.0,)], "x double")).collect()] == [2.0]


def test_statistics_per_group(spark):
    rows = [("a", 1, "1"), ("a", 2, "3"), ("a", 3, None), ("b", 4, "10"), ("b", 5, "30"), ("b", 6, "x")]
    df = frame(spark, rows, "__cf_file string, id long, x string")
    steps = (Step(Op.FILL_MISSING_MEAN, "x"), Step(Op.NORMALIZE_MINMAX, "x"))
    got = by_id(run(df, PipelineSpec(steps), group="__cf_file"))
    assert [got[i]["x"] for i in range(1, 7)] == ["0.0", "1.0", "0.5", "0.0", "1.0", "x"]


def test_strict_casts_raise(spark):
    df = frame(spark, [("3.7",)], "x string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run_steps(df, Step(Op.CAST_COLUMN, "x", "int"), form="sql").collect()
    halves = frame(spark, [(2.5,), (3.5,), (-2.5,)], "x double")
    got = run_steps(halves, Step(Op.CAST_COLUMN, "x", "int"), form="sql").collect()
    assert [r["x"] for r in got] == [2, 4, -2]


def test_empty_and_all_null_tables(spark):
    empty = frame(spark, [], "x string, y double")
    steps = [Step(op, "x") for op in (Op.FILL_MISSING_MEAN, Op.FILL_MISSING_MODE, Op.NORMALIZE_ROBUST)]
    assert run_steps(empty, *steps, Step(Op.REMOVE_OUTLIERS_IQR, "y")).count() == 0
    nulls = frame(spark, [(None,), (" ",)], "x string")
    assert [r["x"] for r in run_steps(nulls, *steps).collect()] == [None, None]


def test_odd_column_names(spark):
    df = frame(spark, [("1", "a"), ("3", "a")], "`a.b c` string, `q``t` string")
    steps = (
        Step(Op.NORMALIZE_MINMAX, "a.b c"), Step(Op.ONE_HOT_ENCODE, "q`t"), Step(Op.REMOVE_DUPLICATES),
        Step(Op.SORT_COLUMN, "a.b c", "descending"), Step(Op.DROP_MISSING_ROWS),
    )
    got = run_steps(df, *steps)
    assert got.columns == ["a.b c", "q`t_a"] and [tuple(r) for r in got.collect()] == [("1.0", 1), ("0.0", 1)]
    assert math.isclose(got.agg(F.sum("`a.b c`")).first()[0], 1.0)


PUSHED = [
    (Step.filter("l_quantity", ">", "10"), "engine", "Or(IsNull(l_quantity),And(GreaterThan(l_quantity,10.0)"),
    (Step.filter("l_orderkey", "!=", "3"), "engine", "Or(IsNull(l_orderkey),Not(EqualTo(l_orderkey,3)))"),
    (Step(Op.DROP_MISSING_ROWS), "engine", "IsNotNull(l_discount)"),
    (Step(Op.REMOVE_OUTLIERS_IQR, "l_quantity"), "engine", "GreaterThanOrEqual(l_quantity,-24.5)"),
    (Step(Op.REMOVE_OUTLIERS_IQR, "l_quantity"), "sql", "GreaterThanOrEqual(l_quantity"),
    (Step.filter("l_returnflag", "==", "A"), "sql", "EqualTo(l_returnflag,A)"),
]


@pytest.mark.parametrize("step, form, pushed", PUSHED)
def test_filters_reach_the_file_scan(spark, step, form, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = run_steps(df, step, form=form)._jdf.queryExecution().executedPlan().toString()
    line = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert pushed in line, line
    assert "Exchange" not in plan


def test_typed_filter_against_brute_force(spark):
    values = [1.0, 10.0, 10.5, float("nan"), float("inf"), float("-inf"), None]
    df = frame(spark, [(v,) for v in values], "x double")

    def keeps(v, operator, t):
        if v is None:
            return True
        return {">": v > t, "<": v < t, ">=": v >= t, "<=": v <= t, "==": v == t, "!=": v != t}[operator]

    for operator in (">", "<", ">=", "<=", "==", "!="):
        got = [r["x"] for r in run_steps(df, Step.filter("x", operator, "10")).collect()]
        assert sorted(map(str, got)) == sorted(str(v) for v in values if keeps(v, operator, 10.0))
    spread = frame(spark, [(float(i % 10),) for i in range(100)] + [(1e9,), (float("nan"),), (None,)], "x double")
    left = run_steps(spread, Step(Op.REMOVE_OUTLIERS_IQR, "x"))
    assert left.count() == 102 and left.filter("x = 1e9").count() == 0


def test_chains_on_one_text_column_stay_small(spark):
    """Every step mentions its input once or twice, so that pushed filters stay compact."""
    rows = people(spark)
    df = frame(spark, rows, SCHEMA)
    steps = [Step(Op.FILL_MISSING_MEAN, "age"), Step(Op.NORMALIZE_ZSCORE, "age")]
    steps += [Step(Op.NORMALIZE_ROBUST, "age"), Step.filter("age", "<", "2"), Step(Op.NORMALIZE_MINMAX, "age")]
    got = run_steps(df, *steps, Step.filter("age", ">", "0.25"))
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert got.filter("age = 'old'").count() > 0


def test_groups_of_any_type_and_without_a_value(spark):
    """Statistics per group, where groups are numbers, dates or missing."""
    import datetime

    days = [datetime.date(2020, 1, 1), datetime.date(2021, 1, 1), None]
    rows = [(i, i % 2 if i % 3 else None, days[i % 3], str(10 * (i % 3) + i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, part int, day date, x string").withColumn("x", F.when(F.col("id") > 5, F.col("x")))
    for group in ("part", "day"):
        spec = PipelineSpec((Step(Op.FILL_MISSING_MEAN, "x"),))
        got = {r["id"]: float(r["x"]) for r in run(df, spec, group=group).collect()}
        place = ("id", "part", "day").index(group)
        for r in rows:
            known = [float(o[3]) for o in rows if o[0] > 5 and o[place] == r[place]]
            assert got[r[0]] == pytest.approx(float(r[3]) if r[0] > 5 else sum(known) / len(known), abs=1e-4)
