"""Near-duplicate lines by deletion neighbourhoods over words.

Two lines of ``MIN_WORDS`` words or more are near duplicates if one word inserted, deleted or replaced turns one into the other.  A line is
removed if an equal or near line stands earlier, by (document id, line number); shorter lines are left alone.

1. *Which lines can have a neighbour.*  One edit leaves the first or the last half of a line as it is.  Both halves, as the line
   itself and as a line one word longer would cut it, are hashed; halves that two different lines share set bits of a fixed-size
   filter.  The filter only saves work: a line that passes it wrongly finds no neighbour later.
2. *Deletion neighbourhood.*  Lines that pass emit, for each place in the half that may differ, the line without the word there and the
   line as it is, both keyed with the place.  Lines that meet under a key are one edit apart, whichever they are, so the earliest of a
   key settles all of its lines: a key is one aggregate, never a list, and a template that millions of lines share stays one row.
3. *Verification.*  Each (line, earliest) pair is read again and its edit distance taken from the common prefix and suffix.
4. *Removal.*  Lines with an equal or near earlier line are joined to all occurrences, and the documents to their removals.

Defined results: a null or empty text has no lines and stays as it is; rows with one id are one document standing twice: neither is
earlier than the other; a null id is later than all others; ids are integers; a line is compared without white space around it; all
columns of the input are kept, whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import filters
from tidemark.session import materialise

MIN_WORDS = 8
#: Bits of the filter; 2^23 are one megabyte. Each half sets two.
FILTER_BITS = 1 << 23
_BLANK = " \t\r\x0b\x0c"


def _order(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """The place of (``doc``, ``pos``) among all lines, and a number below all places: longs, or decimals where the ids lie too far apart."""
    number = F.col(id_col).cast("decimal(20,0)")
    ends = docs.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
    low, high = int(ends["low"] or 0), int(ends["high"] or 0)
    if high - low < (1 << 32) - 1 and -(1 << 63) <= low and high < 1 << 63:
        # a null id is one behind the last
        since = F.coalesce(F.col("doc").cast("long") - F.lit(low).cast("long"), F.lit(high - low + 1).cast("long"))
        return F.call_function("shiftleft", since, F.lit(31)) + F.col("pos"), F.lit(-1).cast("long")
    order = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)")) * 2147483648 + F.col("pos")
    return order.cast("decimal(34,0)"), F.lit("-" + "9" * 33).cast("decimal(34,0)")


def _trimmed(line: Column) -> Column:
    """Without white space at the ends; ``btrim`` walks the whole line, so only lines that have some there go through it."""
    ends = F.lit(False)
    for c in _BLANK:
        ends = ends | line.startswith(c) | line.endswith(c)
    return F.when(ends, F.btrim(line, F.lit(_BLANK))).otherwise(line)


def _lines(docs: DataFrame, id_col: str, text_col: str, order: Column) -> DataFrame:
    """Lines of ``MIN_WORDS`` words or more: ``doc``, ``pos``, ``line``, its order ``o`` and its two hashes."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line")))
    # a line of fewer words is the same as its first words
    rows = rows.where(_first_words(F.col("line"), F.lit(MIN_WORDS - 1)) != F.col("line"))
    return rows.select("doc", "pos", "line", order.alias("o"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))


def _half(n: Column) -> Column:
    """How many words of a line of ``n`` count as its first half: about half, the same for most neighbouring lengths."""
    return F.when(n < 16, F.floor(n / 2)).otherwise(4 * F.floor(n / 8)).cast("int")


def _halves(n: Column, line: Column) -> list[Column]:
    """Hashes of the halves as ``n`` words and as ``n - 1`` words cut them: two of the front (null if equal), two of the back."""
    mine, less = _half(n), _half(n - 1)
    front = F.xxhash64(F.lit(0), _first_words(line, mine))
    front_less = F.when(mine != less, F.xxhash64(F.lit(0), _first_words(line, less)))
    return [front, front_less, F.xxhash64(F.lit(1), _first_words(line, mine - n)), F.xxhash64(F.lit(1), _first_words(line, less - n + 1))]


def _first_words(line: Column, count: Column) -> Column:
    """The first ``count`` words, or, where ``count`` is negative, the last ones."""
    return F.call_function("substring_index", line, F.lit(" "), count)


def _counted(lines: DataFrame) -> DataFrame:
    """``n``: the number of words, one more than that of spaces."""
    return lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)


def shared_halves(lines: DataFrame) -> Column:
    """Filter over the halves that two different lines share."""
    keys = _counted(lines).select("a", F.explode(F.array(*_halves(F.col("n"), F.col("line")))).alias("key")).where("key IS NOT NULL")
    shared = keys.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most")
    return filters.build(shared, "key", FILTER_BITS)


def candidates(lines: DataFrame, table: Column) -> DataFrame:
    """Lines that may have a neighbour, with ``tail`` and ``head``: whether their last or first half may differ from it."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_halves(F.col("n"), F.col("line")))])
    # a generator between keys and tests: the halves of a line are hashed once, and no test moves below it
    keyed = _counted(lines).select("*", F.explode(F.array(keys)).alias("_k"))
    known = lambda i: F.coalesce(filters.holds(table, F.col(f"_k.k{i}"), FILTER_BITS), F.lit(False))
    asked = keyed.select(*lines.columns, "n", (known(0) | known(1)).alias("tail"), (known(2) | known(3)).alias("head"))
    return asked.where("tail OR head")


def neighbourhood(rows: DataFrame) -> DataFrame:
    """The variants of candidate lines as (key, a, o): the line without the word at a place, and with all words, per place."""
    h = F.col("_h")
    low = F.when(F.col("head"), F.lit(0)).otherwise(_half(F.col("n") - 1))
    high = F.when(F.col("tail"), F.col("n")).otherwise(F.greatest(_half(F.col("n")), _half(F.col("n") - 1) + 1))
    rows = rows.withColumn("_h", F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w))).withColumn("_all", F.xxhash64("_h"))

    def keys(j: Column) -> Column:
        without = F.concat(F.slice(h, F.lit(1), j), F.slice(h, j + 2, F.greatest(F.col("n") - j - 1, F.lit(0))))
        return F.array(F.when(j < F.col("n"), F.xxhash64(j, F.xxhash64(without))), F.xxhash64(j, F.col("_all")))

    every = F.flatten(F.transform(F.sequence(low, high), keys))
    return rows.select("a", "o", F.explode(F.filter(every, lambda k: k.isNotNull())).alias("key"))


def one_edit_apart(x: Column, y: Column) -> Column:
    """Whether two word lists differ by one inserted, deleted or replaced word at most."""

    def common(p: Column, q: Column) -> Column:
        first = F.array_position(F.zip_with(p, q, lambda u, v: u.eqNullSafe(v)), F.lit(False))
        return F.when(first == 0, F.size(p)).otherwise(first - 1)

    longest = F.greatest(F.size(x), F.size(y))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (common(x, y) + common(F.reverse(x), F.reverse(y)) >= longest - 1)


def near_lines(lines: DataFrame) -> DataFrame:
    """Hashes (a, b) of the lines that have a near line before their first occurrence."""
    found = candidates(lines, shared_halves(lines)).groupBy("a", "b").agg(  # repeated lines stand for themselves once
        F.min("o").alias("o"), F.min("line").alias("line"), F.min("n").alias("n"), F.min("tail").alias("tail"), F.min("head").alias("head")
    )
    rows = materialise(found, "line-candidates")
    variants = neighbourhood(rows).groupBy("key", "a").agg(F.min("o").alias("o"))
    earliest = variants.groupBy("key").agg(F.min("o").alias("first"), F.min("a").alias("_least"), F.max("a").alias("_most"))
    earliest = earliest.where("_least <> _most").select("key", "first")
    pairs = variants.join(earliest, "key").where("o > first").select("o", "first").distinct()
    texts = rows.select("o", F.split("line", " ", -1).alias("words"), "a", "b")
    later = pairs.join(texts, "o").join(texts.select(F.col("o").alias("first"), F.col("words").alias("before")), "first")
    return later.where(one_edit_apart(F.col("words"), F.col("before"))).select("a", "b").distinct()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to remove, per document: ``doc`` and ``gone``, a list of (pos, a)."""
    order, before = _order(docs, id_col)
    lines = _lines(docs, id_col, text_col, order)
    repeated = lines.groupBy("a", "b").agg(F.min("o").alias("first"), F.max("o").alias("_last")).where("_last > first").drop("_last")
    near = near_lines(lines).withColumn("first", before)
    repeated = repeated.unionByName(near.select("a", "b", "first")).groupBy("a", "b").agg(F.min("first").alias("first"))
    gone = lines.drop("line").join(repeated, ["a", "b"]).where(F.col("o") > F.col("first"))
    return gone.groupBy("doc").agg(F.collect_set(F.struct("pos", "a")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; columns and rows stay, ``length_col`` is counted again."""
    rows, lines = _without(docs, id_col, text_col)
    kept = F.when(F.size("_at") > 0, F.array_join(lines, "\n")).otherwise(F.col("_row")[text_col])
    rows = rows.withColumn("_text", kept)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_text").alias(c))
        elif c == length_col:
            out.append(F.length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("_row")[c].alias(c))
    return rows.select(*out)


def _without(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """Documents as ``_row`` with ``_at``, the places of removed lines, and the remaining lines."""
    gone = removals(docs, id_col, text_col)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc"))
    rows = packed.join(gone, packed["doc"].eqNullSafe(gone["doc"]), "left").select("_row", "gone")
    rows = rows.withColumn("_lines", F.split(F.col("_row")[text_col], "\n"))
    same = lambda g: F.xxhash64(F.btrim(F.get("_lines", g["pos"]), F.lit(_BLANK))) == g["a"]
    places = F.transform(F.filter("gone", same), lambda g: g["pos"])
    rows = rows.withColumn("_at", F.coalesce(places, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_at"))
    return rows, F.transform(left, lambda i: F.get("_lines", i))


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of its lines, how many went, and the hash of what is left."""
    rows, lines = _without(docs, "doc_id", "text")
    text = F.when(F.size("_at") > 0, F.array_join(lines, "\n")).otherwise(F.coalesce(F.col("_row.text"), F.lit("")))
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), F.when(F.col("_row.text") != "", F.size("_lines")).otherwise(0).cast("long").alias("n_lines"),
        F.size("_at").cast("long").alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
