"""Number cells of report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import apply_rules, is_valid

# Cell rules, applied in this order.
CELL_RULES = [
    ("不适用$", ""),
    ("^附\\s*注[一二三四五六七八九十〇]*", ""),
    ("^[一二三四五六七八九十〇、]+附\\s*注", ""),
    ("元$", ""),
    ("^上升了", ""),
    ("^上升", ""),
    ("个百分点$", ""),
    ("个.*百分点$", ""),
    ("个百分$", ""),
    ("^注释", ""),
    ("^）\\s*", ""),
    ("^同比增加", ""),
    ("注$", ""),
    ("^增\\s*加", ""),
    ("^减\\s*少", "-"),
    ("^下降[了]*", "-"),
    ("^储$", ""),
    ("^备-$", ""),
    ("^无$", ""),
    ("^增长", ""),
    ("【注.*】", ""),
    ("注[0-9]+$", ""),
    ("^不派发现金红利$", ""),
    ("^每[0-9]+股转增[0-9]+股", ""),
    ("^货币单位：人民币$", ""),
    ("^去年同期为负$", ""),
    ("[0-9]、$", ""),
    ("^\\s*[（(]*[一二三四五六七八九十〇、]{1,4}[)）]*(?=[^\\u4E00-\\u9FA5])", ""),
    ("[（(]*[一二三四五六七八九十〇、]{1,4}[)）]*(?=[^\\u4E00-\\u9FA5])", ""),
    ("[一二三四五六七八九十〇、]{1,4}", ""),
]
TAIL_RULES = [(" ", ""), ("个百分点$", ""), ("个百分$", ""), ("个$", "")]
GLUE = "[ ]{2,}(?=[0-9-])"

PLAIN_NUMBER = "^[0-9,.-]*$"


def clean_words(cell: Column) -> Column:
    """``CELL_RULES`` on a cell; a plain number, which no rule changes, skips them."""
    return F.when(cell.rlike(PLAIN_NUMBER), cell).otherwise(apply_rules(cell, CELL_RULES))


def preclean(cell: Column) -> Column:
    """Notes, percent words and direction words out of a number cell; falls become negative."""
    head = F.element_at(F.split(clean_words(cell), GLUE, 2), 1)
    return F.when(is_valid(cell), apply_rules(head, TAIL_RULES)).otherwise(cell)


def _fill_row(cells: Column, rule, finish) -> Column:
    """Row with glued cells split: each cell is ``finish``-ed after ``rule`` and the split.

    Every cell goes through ``rule`` once, before the fold that carries second numbers along.
    """
    prepared = F.transform(cells, lambda x: F.struct(x.alias("cell"), F.split(rule(x), GLUE, 2).alias("parts")))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("pending"))

    def step(acc: Column, item: Column) -> Column:
        cell, parts = item["cell"], item["parts"]
        filled = F.when((cell == "None") & acc["pending"].isNotNull(), acc["pending"]).otherwise(cell)
        value = F.when(is_valid(cell), finish(F.element_at(parts, 1))).otherwise(filled)
        left = F.when(is_valid(cell), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(acc["pending"]))
        return F.struct(F.concat(acc["out"], F.array(value)).alias("out"), left.alias("pending"))

    return F.aggregate(prepared, empty, step)["out"]


def preclean_row(cells: Column) -> Column:
    """``preclean`` over the cells of a row in order.

    Where two numbers sit in one cell, the second fills the next 'None' cell of the row; a blank
    cell in between forgets it.
    """
    return _fill_row(cells, clean_words, lambda x: apply_rules(x, TAIL_RULES))


def split_glued_row(cells: Column) -> Column:
    """Only the splitting part of ``preclean_row``."""
    return _fill_row(cells, lambda x: x, lambda x: x)


def final_clean(cell: Column) -> Column:
    """Bracketed negatives get their sign; dashes and other fillers become ''."""
    text = F.replace(F.translate(cell, "\n /", ""), F.lit("None"), F.lit(""))
    return apply_rules(text, [("（([0-9.,]+)）", "-$1"), ("[（）]", ""), (".*-$", ""), ("^一$", ""), ("^—$", "")])


def to_decimal(cell: Column) -> Column:
    """Number of a cell, NULL where it holds none."""
    return F.replace(final_clean(cell), F.lit(","), F.lit("")).try_cast("decimal(38,4)")
