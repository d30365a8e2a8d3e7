"""Sources: landed text, CSV and JSON files, scoped table scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def existing_paths(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Paths that exist, asked of whatever file system each one names."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


# Charsets the CSV source takes without the wider Java set.
STANDARD_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Opens the wider Java charset set for files such as GBK ones."""
    if encoding.lower() not in STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_price_csv(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str], encoding: str = "GBK"
) -> DataFrame:
    """Price files with a header, every field as text, columns renamed by position.

    Missing files are skipped; an empty file contributes no rows.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    allow_charset(spark, encoding)
    present = existing_paths(spark, paths)
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option(
        "encoding", encoding
    ).csv(present)


def empty_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Paths holding no data row, for the landing report (sizes only; contents are not read)."""
    listed = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    with_rows = (
        spark.read.option("header", True).csv(list(paths)).select(F.col("_metadata.file_path").alias("path")).distinct()
    )
    return listed.join(with_rows, "path", "left_anti")


def security_dimension(listed: DataFrame, configured: DataFrame) -> DataFrame:
    """Code list united with configured rows, whole-row duplicates removed."""
    return listed.select("name", "code", "kind").unionByName(configured.select("name", "code", "kind")).distinct()


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """Header-less code list with given names; all text so that codes keep their zeros."""
    return spark.read.schema("name string, code string, kind string").csv(path)


def scan_sorted(table: DataFrame, predicate: Column, order: Sequence[Column | str]) -> DataFrame:
    """Filtered scan in order; the predicate reaches the files, only its rows are sorted."""
    return table.where(predicate).orderBy(*order)


def null_cells(table: DataFrame) -> DataFrame:
    """Null count per column in one pass, as (column, null_cells)."""
    counts = table.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in table.columns])
    return counts.unpivot([], table.columns, "column_name", "null_cells")


def require_no_nulls(table: DataFrame) -> DataFrame:
    """The table itself; the job fails on the first null cell it reads."""
    first, *rest = table.columns

    def guarded(c: str) -> Column:
        return F.when(
            F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"null cell in column {c}")).cast(table.schema[c].dataType)
        ).otherwise(F.col(f"`{c}`"))

    return table.select(*[guarded(c).alias(c) for c in (first, *rest)])


def report_scope(
    table: DataFrame,
    scope: str,
    names: DataFrame | None = None,
    periods: Sequence[int] | None = None,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Report rows at one of three scopes.

    ``full`` takes every row; ``batch`` (companies) and ``portfolio`` keep the names of the given
    table (a semi join, so the list may be as long as it likes) and filter period and type.
    """
    if scope == "full":
        return table
    if scope not in ("batch", "portfolio"):
        raise ValueError(f"unknown scope {scope}")
    out = table
    if periods is not None:
        out = out.where(F.col("report_time").isin(*periods))
    if types is not None:
        out = out.where(F.col("report_type").isin(*types))
    if names is not None:
        out = out.join(names.select("name"), "name", "left_semi")
    return out


def normalise_corpus(table: DataFrame, text: str = "text") -> DataFrame:
    """Line breaks become spaces.  Whole texts are kept."""
    return table.withColumn(text, F.translate(text, "\r\n", "  "))


def read_replacements(spark: SparkSession, root: str, table_name: str) -> DataFrame:
    """Replacement table of one source: nulls become empty text, line breaks are removed."""
    return clean_replacements(spark.read.parquet(f"{root}/{table_name}"))


def clean_replacements(table: DataFrame) -> DataFrame:
    text = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    out = table.na.fill("", text)
    return out.withColumns({c: F.regexp_replace(c, r"[\r\n]", "") for c in text})


def page_links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """Links whose target matches ``pattern``: (page_id, ord, href, label); ``ord`` counts all anchors of the page.

    The whole tag is matched, its target taken from any place among the attributes, quoted either way or not at all; tags inside the
    label are stripped.
    """
    anchor = r"""(?is)<a(\s(?:"[^"]*"|'[^']*'|[^>"'])*)>(.*?)</a\s*>"""
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("label"),
    )
    href = r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return (
        pages.select("page_id", F.posexplode(pairs).alias("ord", "link"))
        .select(
            "page_id", "ord",
            F.regexp_replace(F.regexp_extract("link.attrs", href, 1), "^[\"']|[\"']$", "").alias("href"),
            F.regexp_replace("link.label", "<[^>]*>", "").alias("label"),
        )
        .where(F.col("href").rlike(pattern))
    )


ANNOUNCEMENT = "struct<code: string, title: string, size: double>"
ANNOUNCEMENT_PAGE = f"struct<query: string, page: bigint, total: bigint, announcements: array<{ANNOUNCEMENT}>>"


def flatten_announcements(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed JSON responses to one row per announcement, with the total its query declared.

    A page without announcements gives one row with nothing but its query and total.
    """
    parsed = raw.select(F.from_json(payload, ANNOUNCEMENT_PAGE).alias("r"))
    return parsed.select(
        F.col("r.query").alias("query"),
        F.col("r.total").alias("declared"),
        F.explode_outer("r.announcements").alias("a"),
    ).select("query", "declared", "a.code", "a.title", "a.size")


def landing_counts(announcements: DataFrame) -> DataFrame:
    """Landed against declared row count per query."""
    return announcements.groupBy("query").agg(
        F.count(F.coalesce("code", "title", F.col("size").cast("string"))).alias("landed"), F.max("declared").alias("declared")
    ).withColumn("complete", F.col("landed") == F.col("declared"))
