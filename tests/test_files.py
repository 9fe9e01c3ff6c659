"""Files as numbered records: split borders inside cells, mixed headers, heads, profiles."""

import csv
import io
import os
import random

import pytest

from tabvet.operators.files import OverlongRecord, preview_files, validate_files
from tabvet.operators.validate import render, validate
from tabvet.sources.csv import read_delimited
from tabvet.sources.heads import file_heads, list_files, read_heads
from tabvet.sources.records import column_names, profile_files, scan_files

CELLS = ["x", "", "v w", '"a\n\nb ""q"" c"', '"\n"', '"x,y"', "é", '"1\r\n2"', "'", "  "]


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Three headers, two delimiters, two encodings, blank lines, rows too long and too short, spaces in paths."""
    folder = tmp_path_factory.mktemp("mixed") / "in a folder"
    folder.mkdir()
    rng = random.Random(7)

    def write(name, header, n, encoding="utf-8", sep=",", eol="\n"):
        out = [sep.join(header)]
        for k in range(n):
            out += [" \t"] if k % 17 == 3 else []
            row = [rng.choice(CELLS).replace(",", sep) for _ in header]
            row[0] = f"r{k}"
            out.append(sep.join(row[:-1] if k % 13 == 4 else [*row, "more"] if k % 29 == 5 else row))
        (folder / name).write_bytes((eol.join(out) + eol).encode(encoding))

    write("a 1.csv", ["id", "name", "t"], 120)
    write("b.csv", ["T", "id", "zip"], 90, "latin-1", ";", "\r\n")
    write("c.CSV", ["name", '"i\nd"'], 80)
    (folder / "d.csv").write_bytes(b"id,name\n")
    (folder / "e.csv").write_bytes(b"")
    (folder / "f.txt").write_bytes(b"not,this\n1,2\n")
    return folder


def by_python(folder):
    """(rows as dicts by lower-cased name, numbers and cell counts of rows too long)."""
    rows, long = [], []
    for f in sorted(os.listdir(folder)):
        data = (folder / f).read_bytes()
        if not data or f.endswith(".txt"):
            continue
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        reader = csv.reader(io.StringIO(text, newline=""), delimiter=";" if f == "b.csv" else ",")
        header = [h.lower() for h in next(reader)]
        for r in reader:
            if len(r) > 1 or r and r[0].strip():
                rows.append(dict(zip(header, r)))
                if len(r) > len(header):
                    long.append((len(rows), len(r), len(header)))
    return rows, long


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_records_do_not_depend_on_splits(spark, mixed, size):
    """Down to splits of 60 bytes: cells and whole records lie across several borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, (size, 0)):
            spark.conf.set(k, str(v))
        scan = scan_files(spark, str(mixed))
        got = sorted(scan.rows.collect())
        refused = sorted((r["row_number"], r["cells"], r["columns"]) for r in scan.refused.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want, long = by_python(mixed)
    assert [r["row_number"] for r in got] == list(range(1, len(want) + 1)) and refused == long
    names = [c for c in scan.rows.columns if c not in ("row_number", "file")]
    assert names == ["id", "name", "t", "zip", "i\nd"]
    assert [[r[c] for c in names] for r in got] == [[w.get(c, "") for c in names] for w in want]


def test_same_as_whole_files(spark, mixed, tmp_path):
    """``multi_line`` reads a file in one task; the scan's cells are the same, but for lines of white space."""
    (tmp_path / "1.csv").write_bytes((mixed / "a 1.csv").read_bytes())
    whole = sorted(tuple(r) for r in read_delimited(spark, str(tmp_path)).collect() if any(c.strip() for c in r))
    assert sorted(tuple(r)[2:] for r in scan_files(spark, str(tmp_path)).rows.collect()) == whole


def test_heads_read_as_much_of_any_file(spark, tmp_path, monkeypatch):
    line = "é" * 50 + ";b\n"
    (tmp_path / "large.csv").write_text("h;b\n" + line * 50_000)
    (tmp_path / "small.csv").write_text("h;b\n" + line * 2)
    (tmp_path / "latin.csv").write_bytes(("h;b\n" + line * 2).encode("latin-1"))
    listed = list_files(spark, str(tmp_path), "*.csv")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    heads = {os.path.basename(r["file"]): r for r in read_heads(listed, 1001).collect()}
    assert len(heads["large.csv"]["head"]) == 1001 and heads["large.csv"]["size_bytes"] > 5_000_000
    got = {os.path.basename(r["file"]): r for r in file_heads(spark, str(tmp_path), "*.csv", 1001).collect()}
    # the 1,001st byte cuts a character: that alone is no sign of another encoding
    assert {k: r["encoding"] for k, r in got.items()} == {"large.csv": "utf-8", "small.csv": "utf-8", "latin.csv": "latin-1"}
    assert all((r["delimiter"], r["columns"], r["header"]) == (";", 2, "h;b") for r in got.values())


def test_profile(spark, mixed):
    got = {os.path.basename(r["file"]).replace("%20", " "): r for r in profile_files(spark, str(mixed)).collect()}
    assert set(got) == {"a 1.csv", "b.csv", "c.CSV", "d.csv"}
    for name, r in got.items():
        assert r["size_bytes"] == os.path.getsize(mixed / name)
    assert [(r["records"], r["columns"], r["encoding"], r["delimiter"]) for _, r in sorted(got.items())] == [(120, 3, "utf-8", ","), (90, 3, "latin-1", ";"), (80, 2, "utf-8", ","), (0, 2, "utf-8", ",")]
    assert got["a 1.csv"]["line_breaks"] > 0 and got["d.csv"]["line_breaks"] == 0


def test_column_names():
    assert column_names('a,,"b ""c""",a,A', ",", '"') == ["a", "Unnamed: 1", 'b "c"', "a.1", "A.2"]


def test_files_to_report(spark, tmp_path):
    (tmp_path / "1.csv").write_text('Code,E-Mail,City,address\nc1,a@b.co,Lima,"1 Main\nSt"\nc2,bad,,\n')
    (tmp_path / "2.csv").write_text("address;City;Code;E-Mail\n;Lima;c3;a@b.co;extra\n")
    run = validate_files(spark, str(tmp_path), "IMS", "row", {"e-mail": "email"})
    rows = spark.createDataFrame([(1, "c1", "a@b.co", "Lima", "1 Main\nSt"), (2, "c2", "bad", "", ""), (3, "c3", "a@b.co", "Lima", "")], "row_number long, Code string, email string, City string, address string")
    assert sorted(tuple(r) for r in render(run.report.results).collect()) == sorted(tuple(r) for r in render(validate(rows, "IMS", "row")).collect())
    assert [(r["row_number"], r["cells"]) for r in run.scan.refused.collect()] == [(3, 5)]
    assert [(r["row_number"], r["delimiter"], r["total_rows"]) for r in preview_files(run.scan, 2).orderBy("row_number").collect()] == [(1, ",", 3), (2, ",", 3)]
    with pytest.raises(OverlongRecord, match="record 3 has 5 cells, expected 4"):
        validate_files(spark, str(tmp_path), "IMS", "bulk")


def test_own_names_do_not_clash(spark, tmp_path):
    (tmp_path / "1.csv").write_text("row_number,file,_file\n7,x,y\n")
    assert [r.asDict() for r in scan_files(spark, str(tmp_path)).rows.drop("__file").collect()] == [{"_row_number": 1, "row_number": "7", "file": "x", "_file": "y"}]
