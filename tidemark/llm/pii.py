"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression over one row, so there is no shuffle and a hot source is just more rows.

Defined results: a null or empty text has no spans; a row that stands twice is answered twice; a null id stays null; other
columns of the input are not looked at.  Positions count code points, ``end`` is exclusive.  The time per text is linear but for
the list of found spans, which grows by copying.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import located

# Each pattern matches the same spans as its plain form. A match can only begin at the start of a run (or where the last match
# ended) and takes its runs whole, so a text without a match is still read once, and no repeated group recurses.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
SECRET = r"""(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-])"""

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
KINDS = BASE + ADDED

#: Score of a confirmed span before its neighbourhood is read, and the score from which an added kind is reported.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "ssn": 0.4, "secret": 0.3}
ACCEPT = 0.5
BONUS = 0.3
MALUS = 0.2
WINDOW = 40
CONTEXT = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|master|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social security|taxpayer",
    "secret": r"""(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|bearer)["']?\s*[:=]?\s*["']?$""",
}
DOUBT = r"\bversion|\bserial|\border (?:no|number)|\bisbn|\bsha-?1\b|\bcommit\b"

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def place(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + place(i))
    return total % 10 == 0


def passes_mod97(value: Column) -> Column:
    """Account number: the first four characters go to the end, letters count from 10, the rest modulo 97 is 1."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.length(flat).between(15, 34) & (rest == 1)


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CONFIRM = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), passes_luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": passes_mod97,
    "ssn": lambda v: F.lit(True),
    "secret": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"),
}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "secret": SECRET}


def _gate(text: Column, kind: str) -> Column:
    """What every match of the kind holds, cheap to look for."""
    digit = F.col("_digit")
    return {
        "email": F.contains(text, F.lit("@")),
        "phone": F.contains(text, F.lit("+")) & digit,
        "secret": digit & F.lower(text).rlike("token|secret|passw|key|bearer"),
    }.get(kind, digit)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed and scored spans of a kind; base kinds keep every confirmed span, added ones those above ``ACCEPT``."""
    confirmed = F.filter(located(text, _PATTERN[kind]), lambda s: _CONFIRM[kind](s["value"]))

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - WINDOW, F.lit(0))
        before = F.lower(F.substring(text, begin + 1, s["start"] - begin))
        near = before if kind == "secret" else F.concat(before, F.lit(" "), F.lower(F.substring(text, s["stop"] + 1, F.lit(WINDOW))))
        score = F.lit(START[kind]) + F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - F.when(near.rlike(DOUBT), MALUS).otherwise(0.0)))
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"),
            F.lit(kind).alias("kind"), s["value"].alias("value"), score.alias("score"),
        )

    scoredspans = F.transform(confirmed, scored)
    if kind in ADDED:
        scoredspans = F.filter(scoredspans, lambda s: s["score"] >= ACCEPT)
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,value:string,score:double>>")
    return F.when(_gate(text, kind), scoredspans).otherwise(none)


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``entities``, the spans by start (start, rank, stop, kind, value, score)."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digit", text.rlike("[0-9]"))
    rows = rows.select("_id", *[_spans(text, k).alias(f"_{k}") for k in KINDS])
    return rows.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])).alias("entities"))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest of ``find_entities``: counts, hash of the base spans, list of all spans."""
    e = F.col("entities")
    count = lambda kind: F.size(F.filter(e, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(e, lambda s: s["rank"] < len(BASE))
    return find_entities(docs).select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(e).alias("spans"),
        F.array_join(F.transform(e, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
