"""Text function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cells as C
from tidemark.functions import names as N
from tidemark.functions import text as X
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present
from tidemark.registry.selection import file_names

HAN = "\\x{4E00}-\\x{9FA5}"

define("announcements", """
    SELECT o_orderkey AS ord, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code,
           CASE o_orderstatus WHEN 'F' THEN year(o_orderdate) || '年<em>年度</em>报告（更新后）'
                WHEN 'O' THEN '关于' || year(o_orderdate) || '年半年度报告的公告' ELSE year(o_orderdate) || '年_三季度报告' END AS title,
           '客户' || CASE o_orderstatus WHEN 'F' THEN 'Ａ' WHEN 'O' THEN ' － B' ELSE '*' END AS sec_name,
           'finalpage/' || CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END
             || '/' || o_orderkey || '.PDF' AS url
    FROM orders""")


def announcements(c):
    """Announcement records with title and name spellings as found on a listing site."""
    year = F.year("o_orderdate").cast("string")
    status = F.col("o_orderstatus")
    title = (
        F.when(status == "F", F.concat(year, F.lit("年<em>年度</em>报告（更新后）")))
        .when(status == "O", F.concat(F.lit("关于"), year, F.lit("年半年度报告的公告")))
        .otherwise(F.concat(year, F.lit("年_三季度报告")))
    )
    name = F.concat(
        F.lit("客户"), F.when(status == "F", "Ａ").when(status == "O", " － B").otherwise("*")
    )
    day = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return c.table("orders").select(
        F.col("o_orderkey").alias("ord"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"),
        title.alias("title"),
        name.alias("sec_name"),
        F.concat(F.lit("finalpage/"), day, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".PDF")).alias("url"),
    )


@job("regex_standardise", """
    SELECT ord, nullif(regexp_extract(raw_name, '[0-9]+年'), '') AS year_label,
           nullif(regexp_extract(raw_name, '（(摘要|英文)）'), '') AS remark FROM file_names""")
def _standardise(c):
    name = F.col("raw_name")
    return present(
        file_names(c).select(
            "ord", X.standardise(name, "[0-9]+年").alias("year_label"), X.standardise(name, "（(摘要|英文)）").alias("remark")
        )
    )


@job("regex_match", "SELECT ord, regexp_matches(raw_name, '摘要|英文') AS hit, false AS none FROM file_names")
def _match(c):
    name = F.col("raw_name")
    return present(
        file_names(c).select("ord", X.contains_match(name, "摘要|英文").alias("hit"), X.contains_match(name, "").alias("none"))
    )


define("parsed_names", f"""
    SELECT ord, raw_name, nullif(regexp_extract(raw_name, '（([0-9]+)）', 1), '') AS code,
           nullif(regexp_extract(raw_name, '[*A-Z]*[{HAN}]+[A-Z0-9]*'), '') AS name,
           nullif(regexp_extract(raw_name, '[0-9]+年'), '') AS year_label,
           CASE WHEN regexp_extract(raw_name, '[0-9]+年([{HAN}]+)', 1) IN ('第一季度报告', '半年度报告', '第三季度报告', '年度报告')
                THEN regexp_extract(raw_name, '[0-9]+年([{HAN}]+)', 1) END AS report_type FROM file_names""")


@job("parse_name", "SELECT ord, code, name, year_label, report_type FROM parsed_names")
def _parse(c):
    n = F.col("raw_name")
    return present(
        file_names(c).select(
            "ord", N.code(n).alias("code"), N.company(n).alias("name"), N.year(n).alias("year_label"),
            N.report_type(n).alias("report_type"),
        )
    )


@job("canonical_name", """
    SELECT ord, '（' || code || '）' || name || '：' || year_label || report_type || '.PDF' AS built,
           coalesce(name || '：' || year_label || report_type, raw_name) AS prefix FROM parsed_names""")
def _canonical(c):
    n = F.col("raw_name")
    return present(
        file_names(c).select(
            "ord",
            N.build(N.code(n), N.company(n), N.year(n), N.report_type(n)).alias("built"),
            N.prefix(n).alias("prefix"),
        )
    )


@job("fill_year_name", """
    SELECT n.ord, CASE WHEN year_label IS NULL THEN split_part(raw_name, '：', 1) || '：' || year(publish_date) || '年'
             || split_part(raw_name, '：', 2) ELSE raw_name END AS filled
    FROM parsed_names n JOIN filings f ON f.ord = n.ord""")
def _fill_year(c):
    table = file_names(c).join(c.filings().select("ord", "publish_date"), "ord")
    return present(table.select("ord", N.with_publishing_year(F.col("raw_name"), F.col("publish_date")).alias("filled")))


@job("clean_title", f"""
    SELECT ord, coalesce(nullif(regexp_extract(t, '[0-9]+年(半年度报告|第三季度报告|年度报告)(（[{HAN}]+）)*'), ''), t) AS title
    FROM (SELECT ord, replace(replace(replace(title, '<em>', ''), '</em>', ''), '年_三季度报告', '年第三季度报告') AS t
          FROM announcements)""")
def _title(c):
    return present(
        announcements(c).select("ord", X.clean_title(F.col("title"), "(半年度报告|第三季度报告|年度报告)").alias("title"))
    )


@job("clean_name", """
    SELECT ord, CASE n WHEN '客户' THEN '客户集团' ELSE n END AS name FROM (
      SELECT ord, replace(array_to_string(regexp_extract_all(sec_name, '[客户A-ZＡ-Ｚ]+'), ''), 'Ａ', 'A') AS n FROM announcements)""")
def _clean_name(c):
    return present(
        announcements(c).select("ord", X.clean_name(F.col("sec_name"), "[客户A-ZＡ-Ｚ]+", {"客户": "客户集团"}).alias("name"))
    )


@job("date_from_url", "SELECT ord, regexp_extract(url, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AS day FROM announcements")
def _url_date(c):
    from tidemark.functions import dates as D

    return present(announcements(c).select("ord", D.from_url(F.col("url")).alias("day")))


@job("map_join", """
    SELECT code, coalesce(string_agg(CASE report_type WHEN '年度报告' THEN 'category_ndbg' WHEN '半年度报告' THEN 'category_bndbg' END, ';'
             ORDER BY report_type), '') AS joined
    FROM (SELECT DISTINCT code, report_type FROM filings) GROUP BY code""")
def _map_join(c):
    codes = {"年度报告": "category_ndbg", "半年度报告": "category_bndbg"}
    lists = c.filings().groupBy("code").agg(F.sort_array(F.collect_set("report_type")).alias("types"))
    out = lists.select("code", X.map_join(F.col("types"), codes).alias("joined"))
    return present(out)


@job("code_prefix", """
    SELECT code, kind, CASE kind WHEN '公司' THEN (CASE WHEN code LIKE '6%' THEN '0' ELSE '1' END) || code
       WHEN '指数' THEN (CASE WHEN code LIKE '0%' THEN '0' ELSE '1' END) || code ELSE '' END AS prefixed
    FROM (SELECT reverse(code) AS code, kind FROM securities)""")
def _prefix(c):
    dim = c.securities().select(F.reverse("code").alias("code"), "kind")
    return present(dim.select("code", "kind", X.code_prefix(F.col("code"), F.col("kind")).alias("prefixed")))


@job("classify_security", """
    SELECT code, CASE kind WHEN '指数' THEN '上证指数' WHEN '国债' THEN '国债' || regexp_extract(code, '[1-9][0-9]*') ELSE '客户' END AS name,
           kind FROM securities""")
def _classify_security(c):
    name = (
        F.when(F.col("kind") == "指数", "上证指数")
        .when(F.col("kind") == "国债", F.concat(F.lit("国债"), F.regexp_extract("code", "[1-9][0-9]*", 0)))
        .otherwise("客户")
    )
    content = F.concat(F.lit(" "), name, F.lit("("), "code", F.lit(") "))
    return present(c.securities().select(X.classify_security(content).alias("s")).select("s.*"))


@job("trim_keys", """
    SELECT DISTINCT replace(replace(replace('''' || name || ' "' || kind || '"', '''', ''), '"', ''), ' ', '') AS key FROM securities""")
def _trim(c):
    raw = F.concat(F.lit("'"), "name", F.lit(' "'), "kind", F.lit('"'))
    return present(c.securities().select(X.trim_keys(raw).alias("key")).distinct())


define("raw_labels", """
    SELECT doc_id, row_idx, (['1', '(2)', '3、', '一.', ''])[row_idx % 5 + 1] || c0 || '(' || c2 || ')-,购臵.' AS raw FROM report_rows""")


def raw_labels(c):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("1", "(2)", "3、", "一.", "")]), (F.col("row_idx") % 5 + 1).cast("int"))
    return c.report_rows().select(
        "doc_id",
        "row_idx",
        F.concat(lead, F.col("cells")[0], F.lit("("), F.col("cells")[2], F.lit(")-,购臵.")).alias("raw"),
    )


@job("normalise_label", f"""
    SELECT doc_id, row_idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      translate(raw, '():-—―‖.，', '（）：－－““．、'), '([处购])臵', '\\1置', 'g'), '^([0-9])、', '\\1．'),
      '^([0-9])([{HAN}])', '\\1．\\2'), '^（([0-9])）', '\\1．'), '^([一二三四五六七八九〇])．', '\\1、') AS label
    FROM raw_labels""")
def _normalise_label(c):
    return present(raw_labels(c).select("doc_id", "row_idx", X.normalise_label(F.col("raw")).alias("label")))


_ALPHA = ("".join(chr(x) for x in range(0x21, 0x7F) if chr(x) != "'"), "".join(chr(x + 0xFEE0) for x in range(0x21, 0x7F) if chr(x) != "'"))


@job("fullwidth_to_ascii", f"SELECT ord, translate(file_name, '{_ALPHA[1]}', '{_ALPHA[0]}') AS narrow FROM filings")
def _narrow(c):
    return present(c.filings().select("ord", X.to_half_width(F.col("file_name")).alias("narrow")))


@job("ascii_to_fullwidth", f"SELECT ord, translate(file_name, '{_ALPHA[0]} ', '{_ALPHA[1]}　') AS wide FROM filings")
def _wide(c):
    return present(c.filings().select("ord", X.to_full_width(F.col("file_name")).alias("wide")))


@job("cn_digits", "SELECT ord, report_time || '年' AS year_label, '三' AS kept FROM filings")
def _cn(c):
    cn = F.concat(F.translate(F.col("report_time").cast("string"), "0123456789", "〇一二三四五六七八九"), F.lit(" 年"))
    return present(
        c.filings().select("ord", X.chinese_digits(cn).alias("year_label"), X.chinese_digits(F.lit("三")).alias("kept"))
    )


@job("unit_scale", """
    SELECT doc_id, pos, u AS unit, CAST(m AS BIGINT) AS multiplier, CAST(n AS DOUBLE) AS raw, CAST(n * m AS DOUBLE) AS scaled FROM (
      SELECT doc_id, pos, u, length(text) AS n,
             CASE u WHEN '元' THEN 1 WHEN '千元' THEN 1000 WHEN '万元' THEN 10000 WHEN '亿元' THEN 100000000 ELSE 1 END AS m
      FROM (SELECT *, nullif(regexp_extract(text, '单位：([^ ]+) 币种', 1), '') AS u FROM page_lines))""")
def _unit(c):
    unit = F.nullif(F.regexp_extract("text", "单位：([^ ]+) 币种", 1), F.lit(""))
    table = c.page_lines().select("doc_id", "pos", unit.alias("unit"), F.length("text").cast("double").alias("raw"))
    return present(
        table.withColumn("multiplier", X.unit_multiplier(F.col("unit"))).withColumn(
            "scaled", F.col("raw") * F.col("multiplier")
        )
    )


_PRE = [
    ("元$", ""), ("个百分点$", ""), ("^附\\s*注[一二三四五六七八九十〇]*", ""), ("^增\\s*加", ""), ("^减\\s*少", "-"), ("^下降[了]*", "-"),
    ("[一二三四五六七八九十〇、]{1,4}", ""),
]


def _sql_rules(expr: str, rules) -> str:
    for pattern, repl in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"
    return expr


define("clean_cells", f"""
    SELECT doc_id, row_idx, c0, c1, c2, CASE WHEN c1 IN ('', 'None') THEN c1
      ELSE regexp_replace(replace(split_part({_sql_rules('c1', _PRE)}, '   ', 1), ' ', ''), '个$', '') END AS p1,
      CASE WHEN contains(c1, '   ') AND c2 = 'None' THEN split_part(c1, '   ', 2) ELSE
           {_sql_rules('c2', _PRE)} END AS p2
    FROM report_rows""")


@job("cell_preclean", "SELECT doc_id, row_idx, p1 AS cleaned FROM clean_cells")
def _preclean(c):
    return present(c.report_rows().select("doc_id", "row_idx", C.preclean(F.col("cells")[1]).alias("cleaned")))


@job("cell_to_decimal", """
    SELECT doc_id, row_idx, f AS cleaned, TRY_CAST(replace(f, ',', '') AS DOUBLE) AS number FROM (
      SELECT doc_id, row_idx, regexp_replace(regexp_replace(replace(p1, 'None', ''), '（([0-9.,]+)）', '-\\1'), '.*-$', '') AS f
      FROM (SELECT doc_id, row_idx, CASE WHEN p1 = '（调整后）' THEN '调整后' ELSE p1 END AS p1 FROM clean_cells))""")
def _to_decimal(c):
    cell = C.preclean(F.col("cells")[1])
    return present(
        c.report_rows().select(
            "doc_id", "row_idx", C.final_clean(cell).alias("cleaned"), C.to_decimal(cell).cast("double").alias("number")
        )
    )


@job("split_glued_cells", """
    SELECT doc_id, row_idx, CASE WHEN contains(c1, '   ') THEN split_part(c1, '   ', 1) ELSE c1 END AS first,
           CASE WHEN contains(c1, '   ') AND c2 = 'None' THEN split_part(c1, '   ', 2) ELSE c2 END AS second FROM report_rows""")
def _split(c):
    row = C.split_glued_row(F.slice("cells", 2, 2))
    return present(
        c.report_rows().select("doc_id", "row_idx", row.alias("r")).select(
            "doc_id", "row_idx", F.col("r")[0].alias("first"), F.col("r")[1].alias("second")
        )
    )


@job("merge_cells", """
    SELECT doc_id, row_idx, coalesce(nullif(nullif(c1, ''), 'None'), '') || coalesce(nullif(nullif(c2, ''), 'None'), '') AS joined,
           coalesce(nullif(nullif(c2, ''), 'None'), nullif(nullif(c1, ''), 'None'), '') AS replaced FROM report_rows""")
def _merge(c):
    a, b = F.col("cells")[1], F.col("cells")[2]
    return present(
        c.report_rows().select(
            "doc_id", "row_idx", X.merge_cells(a, b).alias("joined"), X.merge_cells(a, b, join=False).alias("replaced")
        )
    )


@job("collapse_repeats", """
    SELECT doc_id, string_agg(ch, '' ORDER BY i) AS text FROM (
      SELECT doc_id, i, chars[i] AS ch, chars[i - 1] AS before
      FROM (SELECT doc_id, string_split(text, '') AS chars FROM documents),
           LATERAL (SELECT unnest(range(1, len(chars) + 1)) AS i))
    WHERE before IS DISTINCT FROM ch GROUP BY doc_id""")
def _collapse(c):
    return present(c.table("documents").select("doc_id", X.collapse_repeats(F.col("text")).alias("text")))


@job("valid_length", """
    SELECT doc_id, row_idx, CAST(coalesce(length(nullif(nullif(c2, ''), 'None')), 0) AS BIGINT) AS n FROM report_rows""")
def _valid_length(c):
    return present(c.report_rows().select("doc_id", "row_idx", X.valid_length(F.col("cells")[2]).alias("n")))


@job("classify_value", """
    SELECT doc_id, pos, CASE WHEN regexp_matches(t, '^-?[0-9][0-9,]*([.][0-9]+)?$') THEN 'number'
      WHEN regexp_matches(t, '[0-9]+\\s*年\\s*[0-9]+\\s*月\\s*[0-9]+\\s*日') THEN 'date'
      WHEN regexp_matches(t, '[0-9]{4}\\s*年') THEN 'year' WHEN regexp_matches(t, '股份有限公司') THEN 'company'
      WHEN regexp_matches(t, '单位：') THEN 'unit' WHEN regexp_matches(t, '(省|市)$') THEN 'place' ELSE 'text' END AS class
    FROM (SELECT doc_id, pos, split_part(text, ' ', 1) || CASE WHEN pos % 3 = 0 THEN '' ELSE split_part(text, ' ', 2) END AS t FROM page_lines)""")
def _classify(c):
    words = F.split("text", " ")
    t = F.concat(words[0], F.when(F.col("pos") % 3 == 0, "").otherwise(F.coalesce(F.get(words, F.lit(1)), F.lit(""))))
    return present(c.page_lines().select("doc_id", "pos", X.classify(t, X.LABEL_CLASSES, "text").alias("class")))
