"""URL filter: hand-written rules first, gradient-boosted trees on lexical features for all others.

A rule names a host and the start of a path; it fits that host and its subdomains, and of several that fit the longest decides.  URLs that a rule
decides are labelled ones: from at most ``LABELLED`` different of them (those with the smallest hashes, whatever their order in the table) the
trees are trained; every URL is then judged.  Features: lengths, path depth, number of host labels, parameters and hyphens, shares of digits, character
entropy, and for the last label and the last two labels of the host how many labelled URLs end so and which share of them is blocked.
For training URLs that share comes from the other half of the sample, else it would give away the answer.

The suffix statistics are the only thing joined: hashed, with at most two rows per labelled URL, hence broadcast.  Pages are not shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path and is fitted by no rule; URLs that repeat are one
in training and get equal answers; where no rule decides any URL, or all the same, there is nothing to train and the rest get the only label
known, or "allow"; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Rule text (host, then path) and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

LABELLED = 20_000
TREES, DEPTH, STEP, BINS, SEED = 20, 4, 0.2, 64, 13
#: Labelled URLs of the average share that every suffix is mixed with.
PRIOR = 5.0
LEVELS = (1, 2)
FEATURES = [
    "length", "host_length", "path_length", "query_length", "depth", "host_labels", "params", "hyphens", "digit_share", "host_digit_share",
    "entropy", "host_entropy", *[f"suffix_{kind}_{n}" for n in LEVELS for kind in ("count", "share")],
]


def _small(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """``host``, ``path`` and ``_query`` of the URL, empty where it has none."""
    text = F.coalesce(F.col(url_col), F.lit(""))
    part = "://([^/?#]*)([^?#]*)(?:[?]([^#]*))?"
    return rows.withColumns({
        "_url": text, "host": _small(F.regexp_extract(text, part, 1)), "path": F.regexp_extract(text, part, 2),
        "_query": F.regexp_extract(text, part, 3),
    })


def rule_of(rules: dict[str, str]) -> Column:
    """The longest rule that fits ``host`` and ``path``, else null."""
    tests = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        host, _, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        tests.append(F.when(fits & F.col("path").startswith("/" + path), F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def verdict_of(rules: dict[str, str]) -> Column:
    """The verdict of the rule in column ``rule``."""
    return reduce(lambda out, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(out), rules, F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits per character; characters are sorted, so equal ones are counted in one pass."""

    def term(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(acc: Column, c: Column) -> Column:
        same = F.coalesce(acc["char"] == c, F.lit(False))
        return F.struct(
            c.alias("char"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            (acc["sum"] + F.when(same, F.lit(0.0)).otherwise(term(acc["run"]))).alias("sum"),
        )

    start = F.struct(F.lit(None).cast("string").alias("char"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    n = F.length(text).cast("double")
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda acc: acc["sum"] + term(acc["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.length(whole) > 0, F.length(part) / F.length(whole)).otherwise(F.lit(0.0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def with_lexical(rows: DataFrame) -> DataFrame:
    """The features that the URL alone gives, and the keys of its suffixes."""
    url, host, path, query = (F.col(c) for c in ("_url", "host", "path", "_query"))
    numbers = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "host_labels": F.size(F.filter(F.split(host, "[.]"), lambda s: s != "")),
        "params": F.size(F.filter(F.split(query, "[&;]"), lambda s: s != "")), "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "digit_share": _share(_digits(url), url), "host_digit_share": _share(_digits(host), host), "entropy": entropy(url), "host_entropy": entropy(host),
    }
    keys = {f"_key_{n}": F.xxhash64(F.lit(n), F.substring_index(host, ".", -n)) for n in LEVELS}
    return rows.withColumns({c: v.cast("double") for c, v in numbers.items()} | keys)


class Filter:
    """Trained trees, or the one label known, and the suffix statistics beside them."""

    def __init__(self, model, only: str | None, suffixes: DataFrame | None, average: float):
        self.model, self.only, self.suffixes, self.average = model, only, suffixes, average

    def judge(self, rows: DataFrame) -> DataFrame:
        """Rows of ``with_parts`` with ``score``, the probability to be blocked, and ``judged``."""
        if self.model is None:
            return rows.withColumn("score", F.lit(1.0 if self.only == "block" else 0.0)).withColumn("judged", F.lit(self.only or "allow"))
        rows = self.model.transform(_assembled(_with_suffixes(with_lexical(rows), self.suffixes, self.average)))
        rows = rows.withColumn("score", vector_to_array("probability")[1])
        return rows.withColumn("judged", F.when(F.col("prediction") > 0, F.lit("block")).otherwise(F.lit("allow")))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, average: float, *others: str) -> DataFrame:
    """Counts and mixed shares of each level's suffix; ``others`` are further columns to join on."""
    for n in LEVELS:
        # at most len(LEVELS) rows per labelled URL (and half of the sample)
        stats = F.broadcast(suffixes.withColumnsRenamed({"key": f"_key_{n}", "n": "_n", "blocked": "_blocked"}))
        rows = rows.join(stats, [f"_key_{n}", *others], "left")
        count, blocked = (F.coalesce(F.col(c), F.lit(0)) for c in ("_n", "_blocked"))
        rows = rows.withColumns({
            f"suffix_count_{n}": F.log1p(count.cast("double")), f"suffix_share_{n}": (blocked + F.lit(PRIOR * average)) / (count + F.lit(PRIOR)),
        }).drop("_n", "_blocked")
    return rows


def labelled_sample(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` different URLs of (_url, blocked), by their hash; a URL labelled both ways counts as blocked.

    Rows far beyond the bound leave before anything is shuffled: their hash lies above the share that is needed.
    """
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("_url"), F.lit(1 << 40)))
    different = rows.agg(F.approx_count_distinct("_at")).first()[0]
    share = min(1.0, 1.5 * limit / max(different, 1))
    few = rows.where(F.col("_at") <= int(share * (1 << 40))).groupBy("_at", "_url").agg(F.max("blocked").alias("blocked"))
    return few.orderBy("_at", "_url").limit(limit)


def fit(labelled: DataFrame, limit: int = LABELLED, trees: int = TREES, depth: int = DEPTH) -> Filter:
    """Trained on at most ``limit`` URLs of ``labelled``, rows of (url, blocked)."""
    rows = with_parts(labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where("blocked IS NOT NULL"))
    sample = with_parts(labelled_sample(rows, limit), "_url").withColumn("_half", F.col("_at") % 2)
    sample = materialise(with_lexical(sample), "urls-sample")
    seen = sample.agg(F.min("blocked").alias("least"), F.max("blocked").alias("most"), F.avg("blocked").alias("average")).first()
    if seen["least"] is None or seen["least"] == seen["most"]:
        return Filter(None, None if seen["least"] is None else ("block" if seen["most"] else "allow"), None, 0.0)
    ends = sample.select("_half", "blocked", F.explode(F.array(*[f"_key_{n}" for n in LEVELS])).alias("key"))
    halves = ends.groupBy("key", "_half").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"))
    halves = materialise(halves, "urls-suffixes")
    other = halves.withColumn("_half", 1 - F.col("_half"))
    train = _assembled(_with_suffixes(sample.withColumnRenamed("blocked", "label"), other, seen["average"], "_half"))
    train = materialise(train.select("features", F.col("label").cast("double")), "urls-train")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, maxBins=BINS, seed=SEED, checkpointInterval=-1).fit(train)
    both = halves.groupBy("key").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    return Filter(model, None, both, seen["average"])


def judge(pages: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url", limit: int = LABELLED) -> DataFrame:
    """Per page its host, path, rule, verdict and the trees' score."""
    rows = with_parts(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"))).withColumn("rule", rule_of(rules))
    known = rows.where("rule IS NOT NULL").select("url", (verdict_of(rules) == "block").alias("blocked"))
    out = fit(known, limit).judge(rows)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce(verdict_of(rules), "judged").alias("verdict"), "score")


def report(pages: DataFrame) -> DataFrame:
    return judge(pages)
