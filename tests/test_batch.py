import pytest

from cleanframe.plans import batch
from cleanframe.plans.batch import process, status_counts
from cleanframe.plans.spec import Op, PipelineSpec, Step

RULE = PipelineSpec((Step.regex("berth", "^[A-Z]+-", "pier "),))


def files(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        stem, _, ext = name.rpartition("_")
        (folder / f"{stem}.{ext}").write_text(text)
    return str(folder / "*")


def report(df):
    return {r["source"].rsplit("/", 1)[-1]: r for r in df.collect()}


def content(row):
    from pathlib import Path

    parts = sorted(Path(row["output"]).glob("*.csv"))
    lines = [p.read_text().splitlines() for p in parts]
    assert len({part[0] for part in lines}) == 1
    return [lines[0][0], *[line for part in lines for line in part[1:]]]


def test_two_files(spark, tmp_path):
    paths = files(tmp_path / "in", a_csv="ship,berth\nHeron,N-4\nPlover,SW-11\n", b_csv="ship,berth\nTeal,E-2\n")
    got = process(spark, paths, RULE, str(tmp_path / "out"))
    assert {r["status"]: r["files"] for r in status_counts(got).collect()} == {"SUCCESS": 2}
    rows = report(got)
    assert rows["a.csv"]["output"].endswith("a_cleaned.csv") and rows["a.csv"]["row_count"] == 2
    assert content(rows["a.csv"]) == ["ship,berth", "Heron,pier 4", "Plover,pier 11"]


def test_missing_column_is_skipped(spark, tmp_path):
    paths = files(tmp_path / "in", a_csv="ship,berth\nHeron,N-4\n", b_csv="ship,cargo\nHeron,salt\n")
    rows = report(process(spark, paths, RULE, str(tmp_path / "out")))
    assert rows["a.csv"]["status"] == "SUCCESS"
    assert rows["b.csv"]["status"] == "SKIPPED" and "berth" in rows["b.csv"]["message"]
    assert not list((tmp_path / "out").glob("*b_cleaned*"))


def test_bad_files_are_found_and_stop_nothing(spark, tmp_path):
    good = {f"g{i}_csv": f"ship,berth\nHeron,N-{i}\n" for i in range(5)}
    bad = {"short_csv": "ship,berth\nHeron\n", "none_csv": "", "bad_json": '[{"berth"', "x_txt": "x", "bad_xlsx": "x"}
    paths = files(tmp_path / "in", **good, **bad)
    got = process(spark, [paths, str(tmp_path / "nowhere.csv")], RULE, str(tmp_path / "out"))
    assert {r["status"]: r["files"] for r in status_counts(got).collect()} == {"SUCCESS": 5, "FAILED": 6}
    rows = report(got)
    assert "Row shorter" in rows["short.csv"]["message"] and "no reader" in rows["x.txt"]["message"]
    assert content(rows["g3.csv"]) == ["ship,berth", "Heron,pier 3"]


def test_jobs_do_not_grow_with_files_and_bad_files(spark, tmp_path):
    def jobs(name, good, bad):
        texts = {f"g{i}_csv": f"ship,berth\nHeron,N-{i}\n" for i in range(good)}
        texts |= {f"s{i}_csv": "ship,berth\nHeron,N-1\nPlover\n" for i in range(bad)}
        paths = files(tmp_path / name, **texts)
        spark.sparkContext.setJobGroup(name, name)
        rows = process(spark, paths, RULE, str(tmp_path / f"{name}-out"))
        statuses = {r["status"]: r["files"] for r in status_counts(rows).collect()}
        assert statuses == {"SUCCESS": good} | ({"FAILED": bad} if bad else {})
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, many = jobs("few", 2, 0), jobs("many", 12, 5)
    spark.sparkContext._jsc.clearJobGroup()
    assert many <= few + 1


@pytest.mark.parametrize("line", ["a,b", "a,A,c", ' a ,"b ""x"", y",', ",,", "x,x,_c1", '"q"'])
def test_header_names_are_those_of_the_reader(spark, tmp_path, line):
    from cleanframe.sources.readers import csv_header, header_names

    path = tmp_path / "h.csv"
    path.write_text(line + "\n1,2,3\n")
    assert header_names(line) == csv_header(spark, str(path))


def test_statistics_belong_to_each_file(spark, tmp_path):
    paths = files(tmp_path / "in", a_csv="x\n1\n3\n\n", b_csv="x\n10\n30\n20\n")
    spec = PipelineSpec((Step(Op.NORMALIZE_MINMAX, "x"), Step(Op.SORT_COLUMN, "x", "descending")))
    rows = report(process(spark, paths, spec, str(tmp_path / "out")))
    assert content(rows["a.csv"]) == ["x", "1.0", "0.0"]
    assert content(rows["b.csv"]) == ["x", "1.0", "0.5", "0.0"]


@pytest.mark.parametrize("per_job", [1, 1000])
def test_mixed_steps_alone_and_together(spark, tmp_path, monkeypatch, per_job):
    monkeypatch.setattr(batch, "FILES_PER_JOB", per_job)
    paths = files(
        tmp_path / "in",
        a_csv="k,v\nb,1\na,2\nb,\nb,1\n",
        b_csv="k,v\na,5\n,7\nc,900\nc,6\nc,6\na,5\na,6\na,7\n",
    )
    spec = PipelineSpec(
        (
            Step(Op.FILL_MISSING_MEDIAN, "v"), Step(Op.REMOVE_DUPLICATES), Step(Op.REMOVE_OUTLIERS_IQR, "v"),
            Step(Op.FILL_MISSING_MODE, "k"), Step(Op.LABEL_ENCODE, "k"), Step(Op.SORT_COLUMN, "v", "ascending"),
        )
    )
    rows = report(process(spark, paths, spec, str(tmp_path / "out")))
    assert content(rows["a.csv"]) == ["k,v", "0,1", "0,1.0", "1,2"]
    assert content(rows["b.csv"]) == ["k,v", "0,5", "1,6", "0,6", "0,7", "0,7"]


def test_one_hot_headers_differ_per_file(spark, tmp_path):
    paths = files(tmp_path / "in", a_csv="k\nx\ny\n", b_csv="k\nz\n")
    spec = PipelineSpec((Step(Op.ONE_HOT_ENCODE, "k"),))
    rows = report(process(spark, paths, spec, str(tmp_path / "out")))
    assert content(rows["a.csv"])[0] == "k_x,k_y" and content(rows["b.csv"]) == ["k_z", "1"]


def test_nothing_left_and_same_names(spark, tmp_path):
    one = files(tmp_path / "in1", a_csv="x\n1\n")
    two = files(tmp_path / "in2", a_csv="x\n5\n")
    spec = PipelineSpec((Step.filter("x", ">", "3"),))
    got = process(spark, [one, two], spec, str(tmp_path / "out")).collect()
    outputs = {r["output"].rsplit("=", 1)[-1]: r["row_count"] for r in got}
    assert outputs == {"a_cleaned.csv": 0, "a_cleaned_2.csv": 1}
    empty = next(r for r in got if r["row_count"] == 0)
    assert content(empty) == ["x"]
