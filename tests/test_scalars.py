"""Fixture strings of the text, cell and date rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells as C
from tidemark.functions import dates as D
from tidemark.functions import names as N
from tidemark.functions import text as X
from tidemark.operators import facts as K


def apply(spark, fn, *values, schema="v string"):
    return spark.createDataFrame([values], schema).select(fn.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("增加0.49个百分点", "0.49"), ("减少2.35个", "-2.35"), ("下降了3.1", "-3.1"), ("上升了0.5", "0.5"), ("12.5元", "12.5"),
        ("附注六", ""), ("不适用", ""), ("增 加 0.27 个百分点", "0.27"), ("None", "None"), ("", ""), ("1,234.50", "1,234.50"),
        ("（五）2", "2"), ("七、附注61", "61"), ("【注 1】5", "5"), ("五（一）.", "."), ("无", ""), ("每10股转增10股", ""),
    ],
)
def test_preclean(spark, raw, clean):
    assert apply(spark, C.preclean(F.col("v")), raw) == clean


@pytest.mark.parametrize(
    "raw, clean, number",
    [
        ("（1,234.5）", "-1,234.5", -1234.5), ("--", "", None), ("-", "", None), ("一", "", None), ("—", "", None),
        ("1,000", "1,000", 1000.0), ("None", "", None), ("12 /", "12", 12.0), ("12）", "12", 12.0), ("n.a.", "n.a.", None),
    ],
)
def test_final_clean(spark, raw, clean, number):
    assert apply(spark, C.final_clean(F.col("v")), raw) == clean
    got = apply(spark, C.to_decimal(F.col("v")), raw)
    assert (None if got is None else float(got)) == number


def test_glued_numbers_fill_the_next_none(spark):
    row = C.preclean_row(F.array(*[F.lit(x) for x in ("1,234  5,678", "9", "None", "None")]))
    assert spark.range(1).select(row.alias("r")).first()["r"] == ["1,234", "9", "5,678", "None"]
    blank = C.split_glued_row(F.array(*[F.lit(x) for x in ("1  2", "", "None")]))
    assert spark.range(1).select(blank.alias("r")).first()["r"] == ["1", "", "None"]


@pytest.mark.parametrize(
    "raw, label",
    [("2015.12.31", "2015年"), ("2015-6-30", "2015年"), ("2014", "2014年"), ("2014年", "2014年"), ("项目", "项目")],
)
def test_year_label(spark, raw, label):
    assert apply(spark, D.year_label(F.col("v")), raw) == label


@pytest.mark.parametrize(
    "raw, code, name, year, kind",
    [
        ("（002184）海得控制：2014年年度报告.PDF", "002184", "海得控制", "2014年", "年度报告"),
        ("（000069）华侨城A：2018年年度报告.PDF", "000069", "华侨城A", "2018年", "年度报告"),
        ("（300451）创业慧康：2015年半年度报告（更新后）.PDF", "300451", "创业慧康", "2015年", "半年度报告"),
        ("千禾味业：2019年年度报告.PDF", None, "千禾味业", "2019年", "年度报告"),
        ("千禾味业：公告.PDF", None, "千禾味业", None, None),
    ],
)
def test_names(spark, raw, code, name, year, kind):
    v = F.col("v")
    parts = F.struct(N.code(v), N.company(v), N.year(v), N.report_type(v))
    assert tuple(apply(spark, parts, raw)) == (code, name, year, kind)


def test_label_normalising(spark):
    label = lambda s: apply(spark, X.normalise_label(F.col("v")), s)
    assert label("1、将净利润调节") == "1．将净利润调节"
    assert label("2 现金及现金等价物") == "2．现金及现金等价物"
    assert label("（1）将净利润") == "1．将净利润"
    assert label("一.期初") == "一、期初"
    assert label("处臵固定资产(元)-净额") == "处置固定资产（元）－净额"


def test_width_round_trip(spark):
    assert apply(spark, X.to_half_width(F.col("v")), "华侨城Ａ　１２（ｘ）") == "华侨城A 12(x)"
    assert apply(spark, X.to_full_width(F.col("v")), "A 1~") == "Ａ　１～"


def test_small_rules(spark):
    assert apply(spark, X.chinese_digits(F.col("v")), "二〇一九年") == "2019年"
    assert apply(spark, X.chinese_digits(F.col("v")), "2019 年") == "2019年"
    assert apply(spark, X.unit_multiplier(F.col("v")), "人民币百万元") == 1_000_000
    assert apply(spark, X.unit_multiplier(F.col("v")), "美金") == 1
    assert apply(spark, X.collapse_repeats(F.col("v")), "江江苏苏省") == "江苏省"
    assert apply(spark, X.code_prefix(F.col("v"), F.lit("公司")), "600000") == "0600000"
    assert apply(spark, X.code_prefix(F.col("v"), F.lit("国债")), "010107") == ""
    assert apply(spark, X.contains_match(F.col("v"), "a"), None) is False
    assert apply(spark, X.standardise(F.col("v"), "", null_spellings=True), "None") is None
    assert apply(spark, X.merge_cells(F.col("a"), F.col("b")), "None", None, schema="a string, b string") == ""
    assert apply(spark, X.clean_title(F.col("v"), "(年度报告)"), "x2019年<em>年度</em>报告全文") == "2019年年度报告"
    kind = X.classify_security(F.col("v"))
    assert tuple(apply(spark, kind, "国债1号 (010107)")) == ("010107", "国债1", "国债")
    assert tuple(apply(spark, kind, "上证指数(000001)")) == ("000001", "上证指数", "指数")


def test_dates(spark):
    row = spark.createDataFrame([("2020-1-30", "2020/2/2")], "a string, b string")
    r = row.select(
        D.difference("days", F.col("a"), F.col("b")).alias("days"),
        D.difference("seconds", F.col("a"), F.col("b")).alias("seconds"),
        D.shift("weeks", F.col("b"), F.lit(1)).cast("string").alias("week"),
        D.shift("milliseconds", F.col("b"), F.lit(1500)).cast("string").alias("ms"),
        D.last_weekday(D.parse_date(F.col("b"))).cast("string").alias("weekday"),
        D.parse_date(F.lit("no date")).alias("none"),
    ).first()
    assert (r["days"], r["seconds"], r["week"], r["weekday"], r["none"]) == (3, 259200, "2020-02-09 00:00:00", "2020-01-31", None)
    assert r["ms"] == "2020-02-02 00:00:01.5"
    with pytest.raises(ValueError):
        D.shift("years", F.col("a"), F.lit(1))
    with pytest.raises(ValueError):
        D.difference("weeks", F.col("a"), F.col("b"))


def lines(spark, *texts):
    rows = [(1, i // 2, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, page long, pos long, text string")


def test_page_snippets(spark):
    page = lines(
        spark,
        "公司代码：603027 公司简称：千禾味业",
        "在职员工的数量合计 21,056",
        "研发投入金额（元） 1,000.00 研发投入金额 7",
        "研发投入金额（元） 8,555,951,000.00",
        "注册地址 江苏连云港市海州区",
        "在职员工的数量合计 5",
    )
    words = {
        "在职员工的数量合计": ("staff", "number"), "研发投入金额": ("research", "number"), "注册地址": ("address", "place"),
    }
    first = {r["fact"]: r["value"] for r in K.settle_facts(K.keyword_hits(page, words)).collect()}
    assert first["research"] == "1,000.00"
    facts = {r["fact"]: r["value"] for r in K.settle_facts(K.keyword_hits(page, words), unit_overrides=True).collect()}
    assert facts == {"staff": "21,056", "research": "8,555,951,000.00", "address": "江苏连云港市"}
    assert tuple(K.reference_pairs(page).first()) == (1, "603027", "千禾味业")


def test_units_behind_numbers_dashes_and_companies(spark):
    page = lines(
        spark, "研发支出总额46,982.65万元", "在职员工的数量合计（人） 2731", "在职员工的数量合计 -", "在职员工的数量合计 21,056",
        "编制单位：深圳华侨城股份有限公司", "研发投入金额（元） 8,555,951,000.00", "公司办公地址 中国安徽省芜湖市文化路39号",
    )
    words = {
        "研发支出总额": ("spent", "number"), "在职员工的数量合计": ("staff", "number"), "编制单位：": ("company", "company"),
        "研发投入金额": ("research", "number"), "公司办公地址": ("office", "place"),
    }
    hits = {(r["fact"], r["value"], r["unit"]) for r in K.keyword_hits(page, words).collect()}
    assert ("spent", "46,982.65", "万元") in hits and ("research", "8,555,951,000.00", "元") in hits and ("staff", "", None) in hits
    facts = {r["fact"]: r["value"] for r in K.settle_facts(K.keyword_hits(page, words)).collect()}
    assert facts == {
        "spent": "46,982.65", "staff": "21,056", "company": "深圳华侨城股份有限公司", "research": "8,555,951,000.00", "office": "中国安徽省芜湖市",
    }


@pytest.mark.parametrize("text, want", [
    ("公司代码：603027 公司简称：千禾味业", ("603027", "千禾味业")), ("股票简称 亿纬锂能 股票代码 300014", ("300014", "亿纬锂能")),
    ("股票代码 600801 900933 股票简称 华新水泥 华新B股", ("600801", "华新水泥")), ("公司代码：603027", None), ("--现金 --非现金资产的公允价值", None),
])
def test_reference_forms(spark, text, want):
    got = K.reference_pairs(lines(spark, text)).first()
    assert (None if got is None else (got["code"], got["name"])) == want


def test_title_and_unit(spark):
    page = lines(spark, "千千禾味业股份有限公司 二〇一九 年 年度报告", "单位：万元 币种：人民币", "x", "单位：元")
    title = K.title_facts(page).first()
    assert (title["company"], title["year_label"], title["report_type"]) == ("千禾味业股份有限公司", "2019年", "年度报告")
    units = [r["unit"] for r in K.unit_in_force(page).orderBy("pos").collect()]
    assert units == [None, "万元", "万元", "元"]
