import io
import json
import zipfile

import pytest

from cleanframe.plans.spec import SpecError
from cleanframe.sources import readers, writers, xlsx


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_cells(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'id, name ," note "\n1, Ada ,"a, ""b"""\n\n2,,"  "\n3,Eve\n4,Bob,x,extra\n',
    )
    df = readers.read_table(spark, path)
    assert df.columns == ["id", "name", "note"]
    assert rows(df) == [("1", "Ada", 'a, "b"'), ("2", None, None), ("3", "Eve", None), ("4", "Bob", "x")]
    with pytest.raises(Exception, match="Row shorter than the header"):
        readers.read_csv(spark, path, short_rows="error").collect()


def test_csv_line_breaks_inside_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,note\n1,"line one\nline ""two"""\n2,plain\n')
    assert rows(readers.read_csv(spark, path)) == [("1", 'line one\nline "two"'), ("2", "plain")]


def test_csv_headers(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,a,,b\n1,2,3,4\n")
    df = readers.read_csv(spark, path)
    assert df.columns == ["a0", "a1", "_c2", "b"] and rows(df) == [("1", "2", "3", "4")]
    folder = tmp_path / "d"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,2\n")
    write(folder / "2.csv", "a,c\n3,4\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(folder)).collect()
    with pytest.raises(SpecError):
        readers.read_csv(spark, write(tmp_path / "empty.csv", ""))
    assert rows(readers.read_csv(spark, write(tmp_path / "h.csv", "a,b\n"))) == []


def test_csv_positions_follow_the_file_across_splits(spark, tmp_path):
    path = write(tmp_path / "a.csv", "n\n" + "".join(f"{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_csv(spark, path, position=True)
        assert df.rdd.getNumPartitions() > 3
        got = [int(r["n"]) for r in df.orderBy(readers.POSITION).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(3000))


def test_csv_export_round_trip(spark, tmp_path):
    cells = [("a\nb", ' "q" ', None, True, 0.1234567), ("", "x,y", "\\", None, None)]
    df = spark.createDataFrame(cells, "a string, b string, c string, d boolean, e double")
    path = str(tmp_path / "out")
    writers.write_csv(df.coalesce(1), path, decimals=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 'a,b,c,d,e\n"a\nb"," ""q"" ",,True,0.123457\n,"x,y",\\,,\n'
    back = rows(readers.read_csv(spark, path))
    assert back == [("a\nb", '"q"', None, "True", "0.123457"), (None, "x,y", "\\", None, None)]


def test_empty_export_keeps_its_header(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([], "a string, b int").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "a,b\n"


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\r\nc", '"q"', None)], "x string, `y\tz` string, w string")
    writers.write_tsv(df.coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == 'x\ty z\tw\na b  c\t"q"\t\n'


OBJECTS = ['{"z": 1, "a": 4.50}', '{"a": null, "m": {"k": [1, 2]}, "z": true}', '{"b": " "}']
LAYOUTS = {
    "compact": "[" + ", ".join(OBJECTS) + "]",
    "indented": json.dumps([json.loads(o) for o in OBJECTS], indent=2).replace("4.5", "4.50"),
    "array of lines": "[\n  " + ",\r\n  ".join(OBJECTS) + "\n]\n",
    "brackets on object lines": "[" + ",\n".join(OBJECTS) + "]",
    "bare lines": "\n\n".join(OBJECTS) + "\n",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_json_columns_in_order_of_appearance(spark, tmp_path, layout):
    path = write(tmp_path / "a.json", LAYOUTS[layout])
    df = readers.read_table(spark, path, position=True)
    assert df.columns == ["z", "a", "m", "b", readers.POSITION]
    got = rows(df.orderBy(readers.POSITION).drop(readers.POSITION))
    nested = got[1][2]
    assert json.loads(nested) == {"k": [1, 2]}
    assert got == [("1", "4.5", None, None), ("true", None, nested, None), (None, None, None, None)]
    assert readers.scan_json(spark, [path])[0].whole == (layout in ("compact", "indented"))


def test_json_files_of_both_kinds(spark, tmp_path):
    write(tmp_path / "a.json", '[{"q": 1}, {"b": 2}]')
    write(tmp_path / "b.json", '{"b": 3}\n{"c": 4}\n')
    df = readers.read_json(spark, str(tmp_path / "*.json"))
    assert sorted(df.columns) == ["b", "c", "q"]
    assert sorted(map(str, rows(df.select("q", "b", "c")))) == sorted(
        map(str, [("1", None, None), (None, "2", None), (None, "3", None), (None, None, "4")])
    )


def test_json_keys_may_have_any_name(spark, tmp_path):
    path = write(tmp_path / "a.json", '[{"at": 1, "item": 2, "o.x": "3", "line`": 9007199254740993}]')
    df = readers.read_json(spark, path)
    assert df.columns == ["at", "item", "o.x", "line`"]
    assert rows(df) == [("1", "2", "3", "9007199254740993")]


def test_json_without_objects(spark, tmp_path):
    df = readers.read_json(spark, write(tmp_path / "e.json", "[]"))
    assert df.columns == [] and df.count() == 0


@pytest.mark.parametrize(
    "text", ['[{"a": ', '[{"a": 1},', '[{"a": 1}\n{"a": 2}]', '{"a": 1},\n{"a": 2}', "[1, 2]", "x", '[{"a": 1}, 2]']
)
def test_broken_json(spark, tmp_path, text):
    with pytest.raises(SpecError):
        readers.read_json(spark, write(tmp_path / "b.json", text))


@pytest.mark.parametrize("name", ["data", "data.txt", "data.xls"])
def test_unsupported_files(spark, name):
    with pytest.raises(SpecError):
        readers.read_table(spark, f"/nowhere/{name}")


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheet_rows, styles="", shared=""):
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets>'
        '<sheet name="first" r:id="rId2"/><sheet name="other" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>"
        '<Relationship Id="rId1" Target="worksheets/other.xml"/>'
        '<Relationship Id="rId2" Target="/xl/worksheets/first.xml"/></Relationships>',
        "xl/worksheets/first.xml": f"<worksheet {MAIN}><sheetData>{sheet_rows}</sheetData></worksheet>",
        "xl/styles.xml": f"<styleSheet {MAIN}>{styles}</styleSheet>",
        "xl/sharedStrings.xml": f"<sst {MAIN}>{shared}</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    path.write_bytes(out.getvalue())
    return str(path)


STYLES = (
    '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/>'
    '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
)
SHARED = "<si><t>id</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si>"
ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row>'
    '<row r="2"><c r="A2"><v>7</v></c><c r="B2" s="1"><v>45296.5</v></c><c r="C2" t="b"><v>1</v></c></row>'
    '<row r="4"><c r="A4"><v>2.50</v></c><c r="C4" s="3"><v>3</v></c></row>'
    '<row r="5"><c r="A5"><f>A4*2</f><v>5</v></c><c r="B5" t="str"><f>x</f><v>text</v></c><c r="C5" t="e"><v>#N/A</v></c></row>'
    '<row r="6"><c r="A6" s="2"><v>45296.000011574</v></c><c r="B6"><v>1E-5</v></c><c r="C6"><v>12345678.9</v></c></row>'
)


def test_workbook_cells(spark, tmp_path):
    df = readers.read_table(spark, workbook(tmp_path / "a.xlsx", ROWS, STYLES, SHARED), position=True)
    assert df.columns == ["id", "rich", "c", readers.POSITION]
    assert rows(df.orderBy(readers.POSITION).drop(readers.POSITION)) == [
        ("7", "2024-01-05T12:00", "true"),
        ("2.5", None, "3"),
        ("5", "text", None),
        ("2024-01-05T00:00:01", "1.0E-5", "1.23456789E7"),
    ]


def test_workbook_dates_and_numbers():
    assert xlsx.date_text(1, False) == "1900-01-01T00:00" and xlsx.date_text(61, False) == "1900-03-01T00:00"
    assert xlsx.date_text(0, True) == "1904-01-01T00:00" and xlsx.date_text(0.0000116, True).endswith("01.002")
    assert [xlsx.number_text(x) for x in (3.0, -0.5, 0.0001, 1e16, 1.5e-7)] == [
        "3", "-0.5", "1.0E-4", "10000000000000000", "1.5E-7",
    ]


def test_preview_and_append(spark):
    df = spark.range(10).toDF("n")
    assert [r["n"] for r in readers.preview(df, 3, ["n"]).collect()] == [0, 1, 2]
    assert readers.preview(df, 0).count() == 1
    assert readers.append_rows(df, df.toDF("m")).columns == ["n"] and readers.append_rows(df, df).count() == 20
