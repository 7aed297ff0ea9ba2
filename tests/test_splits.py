"""Rows that span lines and splits."""

import csv
import io
import json
import random

import pytest

from cleanframe.plans.spec import SpecError
from cleanframe.sources import readers, splits


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "500")
    yield
    spark.conf.set(name, old)


def cells(rng):
    return rng.choice(["plain", "two\nlines", 'say "so"', "", "a,b", '5" pipe', "x\n\n\ny", "long " * 30 + "\n" + "text " * 20, '"', '""\n"', " \t", "ü\n日本"])


def written(rows, raw=None):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for r in rows:
        writer.writerow(r)
    return out.getvalue()


def wanted(rows):
    return [tuple((c.strip(readers.CONTROLS) or None) for c in r) for r in rows]


def test_line_breaks_in_cells_are_read_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    rows = [[str(i), cells(rng), cells(rng)] for i in range(150)]
    (tmp_path / "a.csv").write_text(written([["id", "left", "right"], *rows]), newline="")
    frame = readers.read_csv(spark, str(tmp_path / "a.csv"), position=True)
    assert splits.text_lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
    assert [tuple(r)[:3] for r in frame.orderBy(readers.POSITION).collect()] == wanted(rows)


def test_only_files_with_line_breaks_leave_the_plain_reader(spark, tmp_path, small_splits):
    inches = 'id,note\n1,5" pipe\n2,6" x 7" plate\n' + "".join(f'{i},"{i}"" wide"\n' for i in range(3, 40))
    (tmp_path / "inches.csv").write_text(inches)
    (tmp_path / "broken.csv").write_text('id,note\n100,"one\n5"" pipe\n\nend"\n101,3" rod\n')
    paths = [str(tmp_path / "inches.csv"), str(tmp_path / "broken.csv")]
    assert [f.rsplit("/", 1)[-1] for f in splits.broken_files(spark, paths)] == ["broken.csv"]
    got = {r["id"]: r["note"] for r in readers.read_csv(spark, paths).collect()}
    assert got["1"] == '5" pipe' and got["2"] == '6" x 7" plate' and got["39"] == '39" wide' and len(got) == 41
    assert got["100"] == 'one\n5" pipe\n\nend' and got["101"] == '3" rod'


def test_headers_and_short_rows_of_joined_files(spark, tmp_path, small_splits):
    (tmp_path / "1.csv").write_text('id,"the\nnote",z\n1,"a\nb"\n2,x,y,more\n')
    frame = readers.read_csv(spark, str(tmp_path / "1.csv"))
    assert frame.columns == ["id", "the\nnote", "z"]
    assert [tuple(r) for r in frame.orderBy("id").collect()] == [("1", "a\nb", None), ("2", "x", "y")]
    with pytest.raises(Exception, match="Row shorter than the header"):
        readers.read_csv(spark, str(tmp_path / "1.csv"), short_rows="error").collect()
    (tmp_path / "2.csv").write_text('id,other\n1,"a\nb"\n')
    (tmp_path / "3.csv").write_text("id,note\n1,a\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, [str(tmp_path / "3.csv"), str(tmp_path / "2.csv")]).collect()


def test_pretty_arrays_are_read_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(9)
    texts = ["plain", 'quote " and \\ and \n line', "[not] {a} bracket, no", "ü", "", "]}" * 20]
    rows = [{"id": i, "text": rng.choice(texts), "nested": {"x": [1, {"y": rng.choice(texts)}]}} for i in range(60)]
    for name, text in {
        "indented": json.dumps(rows, indent=2),
        "half": "[" + ",\n".join(json.dumps(r, indent=1) for r in rows) + "]",
        "odd": "﻿[\n" + "\n,\n".join(json.dumps(r, indent=rng.choice([None, 3])) for r in rows) + "\n\n]\n",
        "one line": json.dumps(rows),
        "several in a line": "[\n" + json.dumps(rows[:50])[1:-1] + ",\n" + json.dumps(rows[50:])[1:-1] + "\n]",
    }.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        got = readers.read_json(spark, str(path), position=True).orderBy(readers.POSITION).collect()
        assert [(r["id"], r["text"]) for r in got] == [(str(r["id"]), r["text"].strip() or None) for r in rows], name
        assert [json.loads(r["nested"]) for r in got] == [r["nested"] for r in rows], name


def test_what_is_no_array_of_objects(spark, tmp_path, small_splits):
    for text in ['[\n{"a": 1}\n,\n2\n]', '[\n{"a":\n1}\n{"a": 2}\n]', '[\n{"a":\n1},\n]', '{\n"a": 1\n}', '[\n{"a":\n1}', '[\n[\n{"a": 1}\n]\n]', '[\n{"a":\n1}\n]\n[\n]', "[\n,\n{\n}\n]", '[\n{"a" 1\n}\n]']:
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(SpecError):
            readers.read_json(spark, str(tmp_path / "x.json"))


def test_keys_that_differ_in_case(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a":1,"A":2,"b":3},\n{"A":4}]')
    frame = readers.read_json(spark, str(tmp_path / "x.json"))
    assert frame.columns == ["a0", "A1", "b"]
    assert sorted(map(tuple, frame.collect()), key=str) == [("1", "2", "3"), (None, "4", None)]
