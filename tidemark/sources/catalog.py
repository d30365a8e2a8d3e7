"""Logical tables of the engine, read or derived from the landed parquet tables.

The landed tables carry no accounting meaning; each method states how a logical table of the
report/price model is derived from them, so that every job's work grows with its input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Report kinds by order status, security kinds by market segment.
REPORT_TYPES = {"F": "年度报告", "O": "半年度报告", "P": "第三季度报告"}
SECURITY_KINDS = {"MACHINERY": "指数", "BUILDING": "国债"}
DEFAULT_KIND = "公司"

# Label fragments and number styles of the derived report rows.
ROW_LABELS = ["营业", "收入", "净利润（元）", "", "一、总资产", "其中：研发", "备注", "负债合计"]


def lookup(mapping: dict[str, str], key: Column, default: Column | str | None = None) -> Column:
    """Small fixed mapping as one map literal; unmatched keys take ``default``."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], mapping.items(), [])
    found = F.create_map(*pairs)[key]
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


class Catalog:
    """Reads tables lazily from ``root``; nothing is cached or collected."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # ---- market data -------------------------------------------------------------------

    def ticks(self, kind: str | None = None) -> DataFrame:
        """Raw price ticks: (code, ts, event_id, close), of one event type or of all."""
        events = self.table("events")
        if kind is not None:
            events = events.where(F.col("event_type") == kind)
        return events.select(
            F.col("user_id").cast("string").alias("code"),
            "ts",
            "event_id",
            F.col("value").cast("decimal(18,4)").alias("close"),
        )

    def price(self, kind: str | None = None) -> DataFrame:
        """Daily closes: the last tick of each (code, date).

        ``max_by`` combines on the map side, so a code that holds a third of all ticks shuffles
        one partial row per map task and day.  (The sort key is a struct, so Spark sorts each input
        split to combine it; packing time and id into one number to hash instead measured slower.)  Every series made from this table has at most
        one row per calendar day, which bounds every per-code window and grouped map.
        """
        return (
            self.ticks(kind)
            .groupBy("code", F.col("ts").cast("date").alias("trade_date"))
            .agg(F.max_by("close", F.struct("ts", "event_id")).alias("close"))
        )

    def price_long(self) -> DataFrame:
        """Long daily series: summed order value per (priority, day)."""
        return (
            self.table("orders")
            .groupBy(
                F.col("o_orderpriority").alias("code"),
                F.col("o_orderdate").cast("date").alias("trade_date"),
            )
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("decimal(18,4)").alias("close"))
        )

    def price_listed(self) -> DataFrame:
        """Daily series of the indices (order priorities) and of every company (customer): summed order value per day.

        The number of series grows with the customers.
        """
        company = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
        return (
            self.table("orders")
            .select(
                F.explode(F.array("o_orderpriority", company)).alias("code"),
                F.col("o_orderdate").cast("date").alias("trade_date"),
                F.col("o_totalprice").cast("decimal(18,4)").alias("value"),
            )
            .groupBy("code", "trade_date")
            .agg(F.sum("value").cast("decimal(18,4)").alias("close"))
        )

    # ---- dimensions --------------------------------------------------------------------

    def securities(self) -> DataFrame:
        """Security dimension: (code, name, kind)."""
        code = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
        return self.table("customer").select(
            code.alias("code"),
            F.concat(F.lit("客户"), code).alias("name"),
            lookup(SECURITY_KINDS, F.col("c_mktsegment"), DEFAULT_KIND).alias("kind"),
        )

    def categories(self) -> DataFrame:
        """Industry by company name: (name, industry)."""
        code = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
        nation = self.table("nation")
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.concat(F.lit("客户"), code).alias("name"), F.col("n_name").alias("industry"))
        )

    def filings(self, priorities: tuple[str, ...] = ()) -> DataFrame:
        """Report announcements: one row per order (of the given priorities, if any)."""
        orders = self.table("orders")
        if priorities:
            orders = orders.where(F.col("o_orderpriority").isin(*priorities))
        code = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
        year = F.year("o_orderdate")
        report_type = lookup(REPORT_TYPES, F.col("o_orderstatus"))
        name = F.concat(F.lit("客户"), code)
        return orders.select(
            F.col("o_orderkey").alias("ord"),
            year.cast("bigint").alias("report_time"),
            code.alias("code"),
            name.alias("name"),
            report_type.alias("report_type"),
            F.col("o_orderdate").cast("date").alias("publish_date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("size"),
            F.concat(
                F.lit("（"), code, F.lit("）"), name, F.lit("："), year.cast("string"), F.lit("年"), report_type,
                F.lit(".PDF"),
            ).alias("file_name"),
        )

    def ledger(self) -> DataFrame:
        """Filings already processed: those of urgent and high priority."""
        return self.filings(("1-URGENT", "2-HIGH"))

    # ---- statements --------------------------------------------------------------------

    def statement(self, by_type: bool = False) -> DataFrame:
        """Yearly measures per (code, year), or (code, report_type, year), all decimal.

        Order totals are summed per order before the join, so no measure is counted per line.
        """
        item = self.table("lineitem").select(
            "l_orderkey",
            F.col("l_quantity").cast("decimal(12,2)").alias("qty"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
            F.col("l_discount").cast("decimal(4,2)").alias("disc"),
            F.col("l_tax").cast("decimal(4,2)").alias("tax"),
            "l_returnflag",
            "l_linestatus",
        )
        one = F.lit(1).cast("decimal(4,2)")
        revenue = F.col("price") * (one - F.col("disc"))
        per_order = item.groupBy("l_orderkey").agg(
            F.sum(revenue).alias("revenue"),
            F.sum(F.col("price") * F.col("disc")).alias("fees"),
            F.sum(revenue * F.col("tax")).alias("tax"),
            F.sum("qty").alias("headcount"),
            F.sum(F.when(F.col("l_returnflag") == "R", revenue).otherwise(0)).alias("receivables"),
            F.sum(F.when(F.col("l_linestatus") == "O", revenue).otherwise(0)).alias("inventory"),
        )
        orders = self.table("orders").select(
            "o_orderkey",
            F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
            lookup(REPORT_TYPES, F.col("o_orderstatus")).alias("report_type"),
        )
        keys = ["code", "report_type", "year"] if by_type else ["code", "year"]
        measures = ["revenue", "fees", "tax", "headcount", "receivables", "inventory"]
        return (
            orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(*keys)
            .agg(
                *[F.sum(m).cast("decimal(24,6)").alias(m) for m in measures],
                F.sum("total").cast("decimal(24,6)").alias("total_assets"),
            )
        )

    # ---- report pages ------------------------------------------------------------------

    def document_lines(self) -> DataFrame:
        """One row per text line: (doc_id, row_idx, line)."""
        return self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))

    def report_rows(self) -> DataFrame:
        """Raw report tables in row form: (doc_id, row_idx, cells array of three strings).

        One table per document and one table row per text line.  A table is bounded by one
        stored text, so per-document windows are bounded too.
        """
        row, line = F.col("row_idx"), F.col("line")
        n1 = F.length(line) * 1237 + row
        n2 = F.size(F.split(line, " ")) * 7919 + 13
        style = (F.length(line) + row) % 10
        number = F.when(style == 0, F.concat(F.lit("（"), thousands(n1), F.lit("）")))
        for code, left, right in (
            (1, "增加", ".49个百分点"),
            (2, "减少", ".35个"),
            (3, "下降了", ".1"),
        ):
            number = number.when(style == code, F.concat(F.lit(left), n1.cast("string"), F.lit(right)))
        number = (
            number.when(style == 4, F.lit("--"))
            .when(style == 5, F.lit("None"))
            .when(style == 6, F.concat(thousands(n1), F.lit("   "), thousands(n2)))
            .when(style == 7, F.concat(F.lit("附注七、"), (row % 50).cast("string")))
            .when(style == 8, F.concat(thousands(n1), F.lit(".50元")))
            .otherwise(thousands(n1))
        )
        second = F.when(style == 6, F.lit("None")).otherwise(thousands(n2))
        label = F.element_at(F.array(*[F.lit(x) for x in ROW_LABELS]), (row % len(ROW_LABELS)) + 1)
        cells = (
            F.when(row == 0, F.array(F.lit("项目"), F.lit("2015.12.31"), F.lit("2014")))
            .when(row == 1, F.array(F.lit(""), F.lit("（调整后）"), F.lit("None")))
            .when(row % 40 == 39, F.array(F.lit("项目"), F.lit("2015年"), F.lit("2014年")))
            .when(row % 16 == 11, F.array(F.lit(""), F.lit("None"), F.lit("None")))
            .otherwise(F.array(label, number, second))
        )
        return self.document_lines().select("doc_id", row.cast("bigint").alias("row_idx"), cells.alias("cells"))

    def page_lines(self) -> DataFrame:
        """Page text by line, with fact phrases before the original words.

        (doc_id, page, pos, text); a page holds twenty lines.
        """
        row, line = F.col("row_idx"), F.col("line")
        size = F.length(line)
        n1 = thousands(size * 1237 + row)
        kind = (size + row) % 7
        units = F.element_at(F.array(*[F.lit(u) for u in ("元", "千元", "万元", "亿元")]), size % 4 + 1)
        code = F.lpad(F.col("doc_id").cast("string"), 6, "0")
        lead = (
            F.when(kind == 0, F.concat(F.lit("公司代码："), code, F.lit(" 公司简称：客户"), (size % 50).cast("string")))
            .when(kind == 1, F.concat(F.lit("在职员工的数量合计 "), n1))
            .when(kind == 2, F.concat(F.lit("单位："), units, F.lit(" 币种：人民币")))
            .when(kind == 3, F.concat(F.lit("研发投入金额（元） "), n1, F.lit(".00")))
            .when(
                kind == 4,
                F.concat(
                    F.lit("江江苏苏客户"), (size % 50).cast("string"), F.lit("股份有限公司 "),
                    (F.lit(2010) + size % 10).cast("string"), F.lit(" 年年度报告"),
                ),
            )
            .when(kind == 5, F.lit("注册地址 江苏连云港市"))
            .otherwise(F.lit(""))
        )
        return self.document_lines().select(
            "doc_id",
            F.floor(row / 20).cast("bigint").alias("page"),
            row.cast("bigint").alias("pos"),
            F.concat(lead, F.lit(" "), line).alias("text"),
        )
