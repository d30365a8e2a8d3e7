"""Report file names: ``（code）name：year type.PDF``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report types and patterns of standard names.
REPORT_TYPES = ["第一季度报告", "半年度报告", "第三季度报告", "年度报告"]
NAME_PATTERN = "[*A-Z]*[\\u4E00-\\u9FA5]+[A-Z0-9]*"
YEAR_PATTERN = "[0-9]+年"
TYPE_PATTERN = "[0-9]+年([\\u4E00-\\u9FA5]+)"
CODE_PATTERN = "（([0-9]+)）"


def first_match(pattern: str, text: Column, group: int = 0) -> Column:
    """First match, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def code(name: Column) -> Column:
    return first_match(CODE_PATTERN, name, 1)


def company(name: Column) -> Column:
    return first_match(NAME_PATTERN, name)


def year(name: Column) -> Column:
    return first_match(YEAR_PATTERN, name)


def report_type(name: Column) -> Column:
    """Report type after the year, NULL unless it is a known one."""
    found = first_match(TYPE_PATTERN, name, 1)
    return F.when(found.isin(*REPORT_TYPES), found)


def build(code_: Column, company_: Column, year_: Column, type_: Column) -> Column:
    """Standard file name; NULL when a part is missing."""
    return F.concat(F.lit("（"), code_, F.lit("）"), company_, F.lit("："), year_, type_, F.lit(".PDF"))


def prefix(name: Column) -> Column:
    """``name：year type`` of a file name; the name itself where a part cannot be parsed."""
    return F.coalesce(F.concat(company(name), F.lit("："), year(name), report_type(name)), name)


def with_publishing_year(name: Column, published: Column) -> Column:
    """Puts the publishing year before the type where the name carries no year."""
    filled = F.concat(
        F.substring_index(name, "：", 1),
        F.lit("："),
        F.year(published).cast("string"),
        F.lit("年"),
        F.substring_index(name, "：", -1),
    )
    return F.when(year(name).isNull() & published.isNotNull(), filled).otherwise(name)
