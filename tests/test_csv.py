import csv as pycsv
import io
import random

import pytest

from tablescope.operators import report
from tablescope.sources import csv, records


def write(tmp_path, data, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030", "gbk"])
def test_encodings_give_the_same_frame(spark, tmp_path, encoding):
    path = write(tmp_path, "名,值\n北京,1\n上海,\n".encode(encoding))
    df = csv.read_csv(spark, path)
    assert df.columns == ["名", "值"]
    assert [tuple(r) for r in df.orderBy("值").collect()] == [("上海", None), ("北京", 1)]
    assert df.schema["值"].dataType.simpleString() == "bigint"


def test_undecodable(spark, tmp_path):
    with pytest.raises(ValueError, match="decode"):
        csv.read_csv(spark, write(tmp_path, b"a,b\n\xff\xff\xfe,1\n"))


def test_headers(spark, tmp_path):
    assert csv.read_csv(spark, write(tmp_path, b"a, a ,,b\n1,2,,3\n4,5,,6\n")).columns == ["a", "a__2", "b"]
    kept = csv.read_csv(spark, write(tmp_path, b"a, a ,,b\n1,2,x,3\n4,5,,6\n", "u.csv"))
    assert kept.columns == ["a", "a__2", "Unnamed", "b"]
    assert csv.preview_csv(spark, write(tmp_path, b"a,,b\n1,,3\n", "v.csv")).columns == ["a", "Unnamed", "b"]
    assert csv.read_csv(spark, write(tmp_path, b"a,a,A\n1,2,3\n", "w.csv")).columns == ["a", "a.1", "A"]


def test_empty_and_ragged(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        csv.read_csv(spark, write(tmp_path, b""))
    with pytest.raises(ValueError, match="more fields"):
        csv.read_csv(spark, write(tmp_path, b"a,b\n1,2\n1,2,3\n", "x.csv"))
    short = csv.read_csv(spark, write(tmp_path, b"a,b\n1,2\n3\n", "y.csv"))
    assert [tuple(r) for r in short.orderBy("a").collect()] == [(1, 2), (3, None)]


def test_quotes_and_line_breaks(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path, b'a,b\n"x, ""y""","two\nlines"\nz,w\n'))
    assert sorted(tuple(r) for r in df.collect()) == [('x, "y"', "two\nlines"), ("z", "w")]


def test_types_and_tokens(spark, tmp_path):
    data = b"i,f,t,s,n\n1,1.5,True,x,NA\nNA,2,False,N/A,\n3,nan,True,1d,null\n"
    df = csv.read_csv(spark, write(tmp_path, data))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "double"]
    info = csv.loading_info(df).first()
    assert (info["rows"], info["columns"], info["missing_values"], info["duplicate_rows"]) == (3, 5, 6, 0)
    assert csv.count_rows(spark, write(tmp_path, data, "again.csv")) == 3


def test_utf8_leaves_the_charset_setting_alone(spark, tmp_path):
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    csv.read_csv(spark, write(tmp_path, "a\n北\n".encode()))
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, b"a,b\n1,x\n", "p1.csv")
    write(folder, b"a,b\n2,y\n", "p2.csv")
    assert sorted(tuple(r) for r in csv.read_csv(spark, str(folder)).collect()) == [(1, "x"), (2, "y")]


def test_whole_analysis_from_csv_to_bundle(spark, tmp_path):
    lines = ["day,amount,qty,city,remark"]
    lines += [f"2024-01-{i % 28 + 1:02d},{i * 1.5},{i % 13},c{i % 3},note {i}" for i in range(60)]
    df = csv.read_csv(spark, write(tmp_path, "\n".join(lines).encode()))
    results = report.analyse(df, ["day", "amount"])
    kinds = {r.column_name: r.detected_type for r in results["types"].collect()}
    assert kinds == {"day": "datetime", "amount": "numeric", "qty": "numeric", "city": "categorical", "remark": "text"}
    manifest = report.write_bundle(results, str(tmp_path / "bundle"), "json")
    assert manifest.count() == len(results)
    back = spark.read.json(str(tmp_path / "bundle" / "categorical")).first()
    assert (back["column_name"], back["mode"]) == ("city", "c0")
    assert spark.read.json(str(tmp_path / "bundle" / "frequency")).first()["detected"] == "daily"
    assert spark.read.json(str(tmp_path / "bundle" / "manifest")).first()["schema_version"] == "1.0"


def test_files_are_matched_by_column_name(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, data in (("a.csv", b"a,b\n1,2\n"), ("b.csv", b"b,a\n20,10\n"), ("c.csv", b'a,b\n"3\n3",4\n')):
        (folder / name).write_bytes(data)
    assert sorted(tuple(r) for r in csv.read_csv(spark, str(folder)).select("a", "b").collect()) == [("1", 2), ("10", 20), ("3\n3", 4)]
    (folder / "d.csv").write_bytes(b"a,c\n1,2\n")
    with pytest.raises(ValueError, match="different columns"):
        csv.read_csv(spark, str(folder))


def test_white_space_around_cells(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path, "n,f\n12\t,\u30001.5\n\t7,2 \n".encode()))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double"]
    assert sorted(tuple(r) for r in df.collect()) == [(7, 2.0), (12, 1.5)]


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [
        (b"a,b", False, True), (b'a,"b', True, False), (b'"a', True, False), (b'"a"', False, False), (b'"a""', True, False), (b'a"b,c', False, False),
        (b'x",y', False, False), (b'x","y', True, True), (b'5" pipe,"z', True, True), (b'""', False, True), (b'"",""', False, True), (b"", False, True),
    ],
)
def test_quote_state_of_a_line(line, outside, inside):
    assert (records.after(line, False), records.after(line, True)) == (outside, inside)


def test_states_over_splits(spark):
    rows = [("f", 0, b'a,"b'), ("f", 10, b"plain"), ("f", 20, b'x",y'), ("f", 30, b'"q'), ("f", 40, b'""'), ("f", 50, b'z"'), ("f", 60, b"w"), ("g", 0, b"w"), ("g", 9, b"w")]
    lines = spark.createDataFrame([(b, f, n, i) for i, (f, n, b) in enumerate(rows)], "line binary, file string, block long, place long").coalesce(1)
    got = {(r.file, r.block): r.start for r in records.starts(lines).collect()}
    state, want = {}, {}
    for f, n, b in rows:
        want[f, n] = state.get(f, False)
        state[f] = records.after(b, want[f, n])
    assert got == want


@pytest.mark.parametrize("split", ["1000b", "64m"])
def test_a_file_with_line_breaks_in_quotes_is_split(spark, tmp_path, split):
    rng = random.Random(7)
    pieces = ["x", '"', "\n", ",", "two words", "\r\n", "é", ""]
    rows = [(str(i), "".join(rng.choices(pieces, k=rng.randrange(1, 12))), rng.choice(["plain", '5" pipe', "a\n" * 60 + "end"])) for i in range(200)]
    out = io.StringIO()
    writer = pycsv.writer(out, lineterminator="\n")
    writer.writerow(["i", "s", "two\nlines"])
    writer.writerows(rows)
    path = write(tmp_path, out.getvalue().encode("utf-8-sig"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        cells, names, _ = csv._text_frame(spark, path)
        assert names == ["i", "s", "two\nlines"]
        got = sorted(tuple(r) for r in cells.collect())
        parts = cells.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == sorted((a, b or None, c) for a, b, c in rows)
    assert split == "64m" or parts > 8
