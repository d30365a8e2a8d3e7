"""Scalar text rules as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = ("", "None")

# Spellings and rules of report labels and cells, applied in this order.
LABEL_CHARACTERS = ("():-—―‖.，", "（）：－－““．、")
LABEL_RULES = [
    ("([处购])臵", "$1置"),
    ("^([0-9])、", "$1．"),
    ("\"一”", "“－”"),
    ("^([0-9])([\\u4E00-\\u9FA5])", "$1．$2"),
    ("^（([0-9])）", "$1．"),
    ("^([一二三四五六七八九〇])．", "$1、"),
    ("“一”(号填列)", "“－”$1"),
]
UNIT_MULTIPLIERS = {"元": 1, "千元": 1000, "万元": 10000, "百万元": 1000000, "千万元": 10000000, "亿元": 100000000}
CHINESE_DIGITS = ("○一二三四五六七八九〇", "01234567890")
DISCARD_WORDS = ["摘要", "英文", "正文", "公告"]
SECURITY_INDEXES = ["上证指数", "深证成指", "恒生指数", "道琼斯指数"]
LABEL_CLASSES = [
    ("number", "^-?[0-9][0-9,]*([.][0-9]+)?$"),
    ("date", "[0-9]+\\s*年\\s*[0-9]+\\s*月\\s*[0-9]+\\s*日"),
    ("year", "[0-9]{4}\\s*年"),
    ("company", "股份有限公司"),
    ("unit", "单位："),
    ("place", "(省|市)$"),
]

# Printable ASCII and its full-width twins: U+0021..U+007E against U+FF01..U+FF5E, plus the space.
HALF_WIDTH = "".join(chr(c) for c in range(0x20, 0x7F))
FULL_WIDTH = "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def apply_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression rules held as data."""
    return reduce(lambda col, rule: F.regexp_replace(col, rule[0], rule[1]), rules, text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A filter pushed below the projection that builds a column repeats the column's expression for
    every mention of it; bound as a lambda variable it is mentioned once.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def is_valid(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(*INVALID)


def valid_or_null(text: Column) -> Column:
    """One NULL for the three spellings of nothing."""
    return F.when(is_valid(text), text)


def valid_length(text: Column) -> Column:
    return F.coalesce(F.length(valid_or_null(text)), F.lit(0))


def standardise(text: Column, pattern: str, null_spellings: bool = False) -> Column:
    """First match of ``pattern``, NULL without one; an empty pattern changes nothing.

    With ``null_spellings`` and an empty pattern, '' and 'None' become NULL.
    """
    if not pattern:
        return valid_or_null(text) if null_spellings else text
    return F.regexp_substr(text, F.lit(pattern))


def standardise_all(texts: Column, pattern: str) -> Column:
    return F.transform(texts, lambda t: standardise(t, pattern))


def contains_match(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found; false for a missing text or an empty pattern."""
    if not pattern:
        return F.lit(False)
    return F.coalesce(text.rlike(pattern), F.lit(False))


def clean_title(title: Column, type_pattern: str) -> Column:
    """Announcement title to ``year type``: emphasis tags go, a bare 三季度 gets its 第."""
    plain = apply_rules(
        title,
        [("</?em>", ""), ("([0-9]{4}年)_三季度报告", "$1第三季度报告"), ("([0-9]{4}年)_第三季度报告", "$1第三季度报告")],
    )
    found = F.regexp_substr(plain, F.lit("[0-9]+年" + type_pattern + "(（[\\u4E00-\\u9FA5]+）)*"))
    return F.coalesce(F.replace(found, F.lit(" "), F.lit("")), plain)


def clean_name(name: Column, pattern: str, aliases: Mapping[str, str] | None = None) -> Column:
    """All matches run together, full-width letters narrowed, then the alias."""
    joined = to_half_width(F.array_join(F.regexp_extract_all(name, F.lit(pattern), F.lit(0)), ""))
    if not aliases:
        return joined
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[joined], joined)


def map_join(keys: Column, mapping: Mapping[str, str], separator: str = ";") -> Column:
    """Mapped values of an array run together; unknown keys are dropped."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    dictionary = F.create_map(*pairs)
    return F.array_join(F.transform(keys, lambda k: dictionary[k]), separator)


def code_prefix(code: Column, kind: Column) -> Column:
    """Exchange digit before the code: companies in 6 and indexes in 0 belong to the first exchange."""
    head = F.substring(code, 1, 1)
    prefixed = F.when(kind == "公司", F.concat(F.when(head == "6", "0").otherwise("1"), code)).when(
        kind == "指数", F.concat(F.when(head == "0", "0").otherwise("1"), code)
    )
    return F.when((code == "") | (kind == ""), "").otherwise(F.coalesce(prefixed, F.lit("")))


def normalise_brackets(text: Column) -> Column:
    return F.replace(F.translate(text, "()", "（）"), F.lit(" "), F.lit(""))


def classify_security(content: Column, indexes: Sequence[str] = tuple(SECURITY_INDEXES)) -> Column:
    """Link text to struct(code, name, kind)."""
    from tidemark.functions import names as N

    text = normalise_brackets(content)
    name = N.company(text)
    kind = F.when(name.isin(*indexes), "指数").when(name.rlike("国债[0-9]*"), "国债").otherwise("公司")
    return F.struct(N.code(text).alias("code"), name.alias("name"), kind.alias("kind"))


def trim_keys(text: Column) -> Column:
    """Quotes and blanks out of keys."""
    return F.translate(text, "'\" ", "")


def normalise_label(label: Column) -> Column:
    """Punctuation of row labels in its Chinese form, leading numerals and known misprints fixed."""
    plain = F.translate(F.replace(label, F.lit(" "), F.lit("")), *LABEL_CHARACTERS)
    return apply_rules(plain, LABEL_RULES)


def to_half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def to_full_width(text: Column) -> Column:
    return F.translate(text, HALF_WIDTH, FULL_WIDTH)


def chinese_digits(text: Column) -> Column:
    """Chinese numeral year to digits when at least two characters convert; blanks are dropped."""
    numerals = CHINESE_DIGITS[0]
    kept = F.array_join(F.regexp_extract_all(text, F.lit(f"[{numerals}年]"), F.lit(0)), "")
    converted = F.translate(kept, *CHINESE_DIGITS)
    return F.replace(F.when(F.length(kept) > 1, converted).otherwise(text), F.lit(" "), F.lit(""))


def unit_multiplier(unit: Column) -> Column:
    """Multiplier of a currency unit, 1 when it is unknown."""
    found = F.regexp_substr(unit, F.lit("(" + "|".join(UNIT_MULTIPLIERS) + ")"))
    pairs = [F.lit(x) for kv in UNIT_MULTIPLIERS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[found], F.lit(1)).cast("bigint")


def merge_cells(first: Column, second: Column, join: bool = True) -> Column:
    """Both cells run together (or the second) where both are valid, else the valid one, else ''."""
    a, b = valid_or_null(first), valid_or_null(second)
    both = F.concat(a, b) if join else b
    return F.coalesce(both, b, a, F.lit(""))


def merge_all(cells: Column) -> Column:
    """Valid cells of an array run together."""
    return F.array_join(F.filter(cells, is_valid), "")


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)(.)\\1+", "$1")


def classify(text: Column, classes: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that is found, in list order."""
    out: Column | None = None
    for label, pattern in classes:
        hit = contains_match(text, pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)
