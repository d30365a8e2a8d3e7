"""Shared common table expressions: the logical tables of ``sources.catalog`` in DuckDB SQL."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "ticks": """
        SELECT CAST(user_id AS VARCHAR) AS code, ts, event_id, CAST(value AS DECIMAL(18,4)) AS close FROM events""",
    "price": """
        SELECT code, trade_date, close FROM (
          SELECT code, CAST(ts AS DATE) AS trade_date, close,
                 row_number() OVER (PARTITION BY code, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
          FROM ticks) WHERE rn = 1""",
    "price_long": """
        SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS trade_date,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS close
        FROM orders GROUP BY 1, 2""",
    "price_listed": """
        SELECT code, trade_date, CAST(sum(value) AS DECIMAL(18,4)) AS close
        FROM (SELECT unnest([o_orderpriority, lpad(CAST(o_custkey AS VARCHAR), 6, '0')]) AS code, CAST(o_orderdate AS DATE) AS trade_date,
                     CAST(o_totalprice AS DECIMAL(18,4)) AS value FROM orders)
        GROUP BY code, trade_date""",
    "securities": """
        SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code,
               '客户' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS name,
               CASE c_mktsegment WHEN 'MACHINERY' THEN '指数' WHEN 'BUILDING' THEN '国债' ELSE '公司' END AS kind
        FROM customer""",
    "categories": """
        SELECT '客户' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS name, n_name AS industry
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "filings": """
        SELECT ord, report_time, code, '客户' || code AS name, report_type, publish_date, size,
               '（' || code || '）客户' || code || '：' || CAST(report_time AS VARCHAR) || '年' || report_type || '.PDF'
                 AS file_name
        FROM (SELECT o_orderkey AS ord, CAST(year(o_orderdate) AS BIGINT) AS report_time,
                     lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code,
                     CASE o_orderstatus WHEN 'F' THEN '年度报告' WHEN 'O' THEN '半年度报告' WHEN 'P' THEN '第三季度报告' END
                       AS report_type,
                     CAST(o_orderdate AS DATE) AS publish_date, CAST(o_totalprice AS DECIMAL(18,2)) AS size
              FROM orders)""",
    "ledger": """
        SELECT * FROM filings
        WHERE ord IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))""",
    "statement": """
        SELECT code, year, CAST(sum(revenue) AS DECIMAL(24,6)) AS revenue, CAST(sum(fees) AS DECIMAL(24,6)) AS fees,
               CAST(sum(tax) AS DECIMAL(24,6)) AS tax, CAST(sum(headcount) AS DECIMAL(24,6)) AS headcount,
               CAST(sum(receivables) AS DECIMAL(24,6)) AS receivables,
               CAST(sum(inventory) AS DECIMAL(24,6)) AS inventory,
               CAST(sum(total) AS DECIMAL(24,6)) AS total_assets
        FROM (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code,
                     CAST(year(o_orderdate) AS BIGINT) AS year, CAST(o_totalprice AS DECIMAL(12,2)) AS total
              FROM orders)
        JOIN (SELECT l_orderkey, sum(rev) AS revenue, sum(price * disc) AS fees, sum(rev * tax) AS tax,
                     sum(qty) AS headcount, sum(CASE WHEN l_returnflag = 'R' THEN rev ELSE 0 END) AS receivables,
                     sum(CASE WHEN l_linestatus = 'O' THEN rev ELSE 0 END) AS inventory
              FROM (SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(12,2)) AS qty,
                           CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc,
                           CAST(l_tax AS DECIMAL(4,2)) AS tax,
                           CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev
                    FROM lineitem)
              GROUP BY l_orderkey) ON o_orderkey = l_orderkey
        GROUP BY code, year""",
    "document_lines": """
        SELECT doc_id, CAST(i AS BIGINT) AS row_idx, lines[i + 1] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
             LATERAL (SELECT unnest(range(0, len(lines))) AS i)""",
    "report_base": """
        SELECT doc_id, row_idx, length(line) * 1237 + row_idx AS n1, len(string_split(line, ' ')) * 7919 + 13 AS n2,
               (length(line) + row_idx) % 10 AS style
        FROM document_lines""",
    "report_rows": """
        SELECT doc_id, row_idx,
               CASE WHEN row_idx = 0 THEN '项目' WHEN row_idx = 1 THEN '' WHEN row_idx % 40 = 39 THEN '项目'
                    ELSE ['营业','收入','净利润（元）','','一、总资产','其中：研发','备注','负债合计'][row_idx % 8 + 1] END AS c0,
               CASE WHEN row_idx = 0 THEN '2015.12.31' WHEN row_idx = 1 THEN '（调整后）'
                    WHEN row_idx % 40 = 39 THEN '2015年' WHEN row_idx % 16 = 11 THEN 'None'
                    WHEN style = 0 THEN '（' || format('{:,}', n1) || '）'
                    WHEN style = 1 THEN '增加' || n1 || '.49个百分点'
                    WHEN style = 2 THEN '减少' || n1 || '.35个'
                    WHEN style = 3 THEN '下降了' || n1 || '.1'
                    WHEN style = 4 THEN '--' WHEN style = 5 THEN 'None'
                    WHEN style = 6 THEN format('{:,}', n1) || '   ' || format('{:,}', n2)
                    WHEN style = 7 THEN '附注七、' || (row_idx % 50)
                    WHEN style = 8 THEN format('{:,}', n1) || '.50元'
                    ELSE format('{:,}', n1) END AS c1,
               CASE WHEN row_idx = 0 THEN '2014' WHEN row_idx = 1 THEN 'None' WHEN row_idx % 40 = 39 THEN '2014年'
                    WHEN style = 6 OR row_idx % 16 = 11 THEN 'None' ELSE format('{:,}', n2) END AS c2
        FROM report_base""",
    "page_lines": """
        SELECT doc_id, row_idx // 20 AS page, row_idx AS pos,
               CASE (length(line) + row_idx) % 7
                 WHEN 0 THEN '公司代码：' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' 公司简称：客户' || (length(line) % 50)
                 WHEN 1 THEN '在职员工的数量合计 ' || format('{:,}', length(line) * 1237 + row_idx)
                 WHEN 2 THEN '单位：' || ['元','千元','万元','亿元'][length(line) % 4 + 1] || ' 币种：人民币'
                 WHEN 3 THEN '研发投入金额（元） ' || format('{:,}', length(line) * 1237 + row_idx) || '.00'
                 WHEN 4 THEN '江江苏苏客户' || (length(line) % 50) || '股份有限公司 ' || (2010 + length(line) % 10)
                             || ' 年年度报告'
                 WHEN 5 THEN '注册地址 江苏连云港市'
                 ELSE '' END || ' ' || line AS text
        FROM document_lines""",
}


def define(name: str, body: str) -> None:
    """Add a CTE used by several oracles of one module."""
    if name in CTES:
        raise ValueError(f"CTE {name} defined twice")
    CTES[name] = body


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in CTES if name in words]


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it names, in dependency order."""
    ordered: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in ordered or name in trail:
            return
        for dep in _needs(CTES[name]):
            if dep != name:
                visit(dep, trail + (name,))
        ordered.append(name)

    for name in _needs(sql):
        visit(name, ())
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
