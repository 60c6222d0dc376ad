import datetime as dt

import pytest
from loamwork.functions.formulas import Formula, formula
from loamwork.functions.predicates import Condition, condition, filter_rows, non_record_row
from loamwork.functions.text import is_blank, is_key_name, normalize_key, parse_business_number, parse_date, strip, time_bucket, to_number
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


READABLE = {
    "1,234": 1234, "(567)": -567, "¥(567.00)": -567, "1.2万": 12000, "85%": 85, "１２３": 123, "-5": -5, "+7.5": 7.5, " 42 ": 42, "$1,000.50": 1000.5, "3亿": 3e8, "2千": 2000, "4k": 4000, "3百万": 3e6,
    "12元": 12, "1e3": 1000, "（8）": -8, "RMB 5": 5,
}


@pytest.mark.parametrize("text", READABLE)
def test_business_numbers(spark, text):
    assert one(spark, text, parse_business_number) == READABLE[text]


@pytest.mark.parametrize("text", ["", "   ", "abc", "n/a", "1d", "NaN", "Infinity", "1-2", "--3", "1.2.3", None])
def test_what_is_no_number(spark, text):
    assert one(spark, text, parse_business_number) is None and one(spark, text, to_number) is None


@pytest.mark.parametrize("text", ["2024-03-01", "2024/3/1", "2024.3.1", "20240301", "2024年3月1日", "2024-03-01 00:00:00", "2024-03-01T00:00:00", "3/1/2024"])
def test_dates(spark, text):
    assert one(spark, text, parse_date) == dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("text", ["", "soon", "2024-13-01", "2024-02-30", None])
def test_what_is_no_date(spark, text):
    assert one(spark, text, parse_date) is None


def test_strip_and_keys(spark):
    assert one(spark, "　\t a b \n ", strip) == "a b"
    assert one(spark, " ＡＢ１ ", normalize_key) == "ab1"
    assert one(spark, "　", is_blank) is True and one(spark, None, is_blank) is True
    assert is_key_name("order_id") and is_key_name("客户编号") and not is_key_name("amount")


@pytest.mark.parametrize(("unit", "want"), [("month", "2021-01"), ("quarter", "2021-Q1"), ("year", "2021"), ("week", "2020-W53")])
def test_time_buckets(spark, unit, want):
    assert one(spark, "2021-01-02", lambda c: time_bucket(parse_date(c), unit, "none")) == want
    assert one(spark, "x", lambda c: time_bucket(parse_date(c), unit, "none")) == "none"


def test_negation_keeps_rows_that_cannot_be_compared(spark):
    df = spark.createDataFrame([("5",), ("-3",), ("bad",), (None,), ("1,000",)], "v string")
    assert filter_rows(df, Condition("v", "lt", 0), exclude=True).count() == 4
    assert filter_rows(df, Condition("v", "gt", 100)).count() == 0
    assert df.where(condition(Condition("v", "gt", 100), ["v"], numbers="business")).count() == 1
    with pytest.raises(ValueError):
        condition(Condition("w", "is_null"), ["v"])


def test_duplicated_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "v string")
    assert filter_rows(df, Condition("v", "duplicated")).count() == 4


def test_non_record_rows(spark):
    df = spark.createDataFrame([("city", "amount"), ("合计", "9"), (None, " "), ("Total", "1"), ("Rome", "2")], "city string, amount string")
    assert [r["city"] for r in df.where(~non_record_row(df.columns)).collect()] == ["Rome"]


BASE = {"a": "Ab c", "n": "7", "m": "0", "d": "2024-03-01", "e": "2024-03-04 12:00:00", "x": None, "err": "#N/A", "f": "1.25"}
FORMULAS = [
    (Formula("o", "trim", "a"), "Ab c"), (Formula("o", "upper", "a"), "AB C"), (Formula("o", "upper", "x"), ""), (Formula("o", "len", "x"), 0), (Formula("o", "literal", value=5), 5),
    (Formula("o", "concat", columns=["a", "x", "n"], sep="-"), "Ab c--7"), (Formula("o", "textjoin", columns=["a", "x", "n"], sep="-"), "Ab c-7"), (Formula("o", "coalesce", columns=["x", "n"], default="z"), "7"),
    (Formula("o", "divide", columns=["n", "m"]), None), (Formula("o", "add", columns=["n", "f"]), 8.25), (Formula("o", "divide", columns=["n", "f"]), 5.6), (Formula("o", "left", "a", value=2), "Ab"), (Formula("o", "right", "a", value=1), "c"),
    (Formula("o", "right", "a", value=0), "Ab c"), (Formula("o", "mid", "a", values=[2, 2]), "b "), (Formula("o", "substitute", "a", values=["b", "__"]), "A__ c"), (Formula("o", "replace", "a", values=[2, 1], value="XX"), "AXX c"),
    (Formula("o", "date_diff", "d", columns=["e"], value="days"), 3.0), (Formula("o", "date_diff", "d", columns=["e"], value="hours"), 84.0), (Formula("o", "year", "d"), 2024), (Formula("o", "text", "d", value="yyyy/mm/dd"), "2024/03/01"),
    (Formula("o", "text", "f", value="0.0"), "1.3"), (Formula("o", "text", "f", value="0%"), "125%"), (Formula("o", "round", "f", value=1), 1.2), (Formula("o", "roundup", "f", value=1), 1.3), (Formula("o", "rounddown", "f", value=1), 1.2),
    (Formula("o", "bucket", "n", values=[5, 10], mapping={5: "low", 10: "mid"}, default="high"), "mid"), (Formula("o", "regex_extract", "a", value="(b) (c)", values=[1]), "c"), (Formula("o", "regex_extract", "a", value="(z)", default="-"), "-"),
    (Formula("o", "split", "a", sep=" ", value=1), "c"), (Formula("o", "split", "a", sep=".", value=1, default="?"), "?"), (Formula("o", "ifna", "err", default="none"), "none"), (Formula("o", "iferror", "err", default="none"), "none"),
    (Formula("o", "iferror", "n", default="none"), "7"), (Formula("o", "map", "n", mapping={"7": "seven"}, default="?"), "seven"), (Formula("o", "map", "m", mapping={"7": "seven"}, default="?"), "?"), (Formula("o", "isin", "n", values=[7, 8]), True),
    (Formula("o", "contains", "a", value="b.c"), True), (Formula("o", "remove_special_chars", "a"), "Abc"), (Formula("o", "and", conditions=[Condition("n", "gt", 5), Condition("x", "is_blank")]), True), (Formula("o", "not", conditions=[Condition("n", "gt", 5)]), False),
    (Formula("o", "ifs", conditions=[Condition("n", "lt", 5), Condition("n", "lt", 9)], values=["a", "b"], default="c"), "b"), (Formula("o", "today", value="2024-01-05"), dt.datetime(2024, 1, 5)), (Formula("o", "equals", "n", value="7"), True),
]


@pytest.mark.parametrize(("f", "want"), FORMULAS, ids=[f.op + str(i) for i, (f, _) in enumerate(FORMULAS)])
def test_formulas(spark, f, want):
    df = spark.createDataFrame([tuple(BASE.values())], ", ".join(f"{k} string" for k in BASE))
    assert df.select(formula(f, df.columns)).first()[0] == want


def test_unknown_formulas_and_columns(spark):
    for f in (Formula("o", "nothing", "a"), Formula("o", "trim", "zz"), Formula("o", "split", "a"), Formula("o", "add", columns=["a"])):
        with pytest.raises(ValueError):
            formula(f, list(BASE))


@pytest.mark.parametrize(("pattern", "want"), [("dd/mm/yyyy", "05/03/2024"), ("mm-dd-yyyy", "03-05-2024"), ("yy-mm-dd", "24-03-05"), ("%Y.%m.%d", "2024.03.05"), ("yyyy年mm月dd日", "2024年03月05日"), ("yyyy-mm-dd HH:mm", "2024-03-05 00:00"), ("mm/dd", "03/05")])
def test_date_formats(spark, pattern, want):
    df = spark.createDataFrame([("2024-03-05",)], "d string")
    assert df.select(formula(Formula("o", "text", "d", value=pattern), ["d"])).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("100块", 100), ("100人民币", 100), ("5美元", 5), ("1.2万元", 12000), ("RMB 3千", 3000)])
def test_currency_words(spark, text, want):
    assert one(spark, text, parse_business_number) == want


def test_names_of_columns():
    from loamwork.functions.text import holds_dates, is_amount_name, is_count_name, is_date_name

    assert all(map(is_key_name, ("主键", "序号", "工号", "卡号", "license_no", "license", "site_code", "uuid"))) and not any(map(is_key_name, ("备注", "amount", "notes")))
    assert all(map(is_date_name, ("month", "year", "年度", "order_date"))) and holds_dates("order_date") and not holds_dates("year")
    assert is_count_name("stock_qty") and is_count_name("年龄") and not is_count_name("account") and is_amount_name("unit_price")


def test_names_that_begin_like_totals_are_records(spark):
    names = ["Summit Ltd", "Total Energies", "Sumitomo", "Notebook", "Noteworthy", "total", " SUM ", "合计", "Note: x", "remarks", "备注如下"]
    df = spark.createDataFrame([(n, "1") for n in names], "name string, n string")
    from loamwork.functions.predicates import remark_row, total_row

    got = {r["name"]: (r["t"], r["r"]) for r in df.select("name", total_row(df.columns).alias("t"), remark_row(df.columns).alias("r")).collect()}
    assert [n for n in names if got[n][0]] == ["total", " SUM ", "合计"] and [n for n in names if got[n][1]] == ["Note: x", "remarks", "备注如下"]


@pytest.mark.parametrize(("shown", "want"), [
    ("2024-03-05T10:11:12Z", "2024-03-05 10:11:12"), ("2024-03-05 10:11:12.123", "2024-03-05 10:11:12.123"), ("2024/3/5 10:11", "2024-03-05 10:11:00"), ("2024-03", "2024-03-01 00:00:00"),
    ("Mar 5, 2024", "2024-03-05 00:00:00"), ("Sept. 5, 2024", "2024-09-05 00:00:00"), ("5 March 2024", "2024-03-05 00:00:00"), ("March 2024", "2024-03-01 00:00:00"), ("20240305T101112Z", "2024-03-05 10:11:12"),
    ("2024年3月", "2024-03-01 00:00:00"), ("2024-03-05T10:11:12+0800", "2024-03-05 02:11:12"), ("2024-03-05T10:11:12.123456789Z", "2024-03-05 10:11:12.123456"), ("2024-1-1 1:02", "2024-01-01 01:02:00"),
    ("1/10/2024 01:11", "2024-01-10 01:11:00"), ("2024-02-30", None), ("Foo 5, 2024", None), ("2024", None), ("12:30", None), ("2024/3-5", None), ("13/40/2024", None), ("123456789", None), ("31-feb-2024", None), ("2024-03-05x", None),
])
def test_date_shapes(spark, shown, want):
    assert one(spark, shown, lambda c: parse_date(c).cast("string")) == want
