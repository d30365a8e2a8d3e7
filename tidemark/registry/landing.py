"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present
from tidemark.session import shared_dir
from tidemark.sources import readers as R
from tidemark.sources import sinks as K

define("stored_ticks", "SELECT * FROM ticks WHERE ts < TIMESTAMP '2024-01-20 00:00:00'")
define("batch_ticks", "SELECT * FROM ticks WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
define("stored_price", "SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close, "
                       "0 AS batch_no FROM price WHERE trade_date < DATE '2024-01-20'")
define("batch_price", "SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close, "
                      "1 AS batch_no FROM price WHERE trade_date >= DATE '2024-01-15'")


def stored_price(c):
    return c.price().where(F.col("trade_date") < F.lit("2024-01-20").cast("date")).withColumn("batch_no", F.lit(0))


def batch_price(c):
    """Daily closes of all events of the overlapping second half of the month."""
    return c.price().where(F.col("trade_date") >= F.lit("2024-01-15").cast("date")).withColumn("batch_no", F.lit(1))


@job("scan_prices", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(CAST(close AS DECIMAL(18,4)) AS VARCHAR) AS close FROM price""")
def _scan_prices(c):
    """Round trip: daily prices landed as GBK text files, then scanned as all-text columns."""
    path = shared_dir(c.spark, "landed-prices")
    R.allow_charset(c.spark, "GBK")
    c.price().select("code", "trade_date", "close").write.option("header", True).option("encoding", "GBK").csv(path)
    return R.read_price_csv(c.spark, [path, f"{path}-missing"], ["code", "trade_date", "close"])


@job("security_dim", """
    SELECT name, code, kind FROM securities
    UNION SELECT DISTINCT '行业' || industry, '900000', '指数' FROM categories""")
def _security_dim(c):
    configured = c.categories().select(
        F.concat(F.lit("行业"), "industry").alias("name"), F.lit("900000").alias("code"), F.lit("指数").alias("kind")
    )
    return present(R.security_dimension(c.securities(), configured))


@job("scan_filtered_sorted", """
    SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, o_totalprice FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus IN ('F', 'O')
    ORDER BY o_custkey, o_orderdate, o_orderkey""")
def _scan_sorted(c):
    keep = (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("o_orderstatus").isin("F", "O")
    df = R.scan_sorted(c.table("orders"), keep, ["o_custkey", "o_orderdate", "o_orderkey"])
    return present(
        df.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"), "o_totalprice")
    )


define("rated_docs", """
    SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")


@job("null_row_audit", """
    SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS null_cells FROM rated_docs
    UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS NULL) FROM rated_docs
    UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM rated_docs
    UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM rated_docs""")
def _null_audit(c):
    rated = c.table("documents").join(c.table("labels"), "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic")
    return present(R.null_cells(rated))


@job("scan_require_complete", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _require_complete(c):
    return present(R.require_no_nulls(c.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")))


@job("report_scope", """
    SELECT ord, 'batch' AS scope FROM filings WHERE report_time IN (1997, 1998) AND report_type IN ('年度报告')
      AND name IN (SELECT name FROM securities WHERE kind = '公司')
    UNION ALL
    SELECT ord, 'portfolio' FROM filings WHERE report_time IN (1999) AND report_type IN ('年度报告', '半年度报告')
      AND name IN (SELECT name FROM categories WHERE industry = 'NATION_3')
    UNION ALL SELECT ord, 'full' FROM filings""")
def _report_scope(c):
    filings = c.filings()
    companies = c.securities().where(F.col("kind") == "公司")
    portfolio = c.categories().where(F.col("industry") == "NATION_3")
    parts = [
        R.report_scope(filings, "batch", companies, [1997, 1998], ["年度报告"]).withColumn("scope", F.lit("batch")),
        R.report_scope(filings, "portfolio", portfolio, [1999], ["年度报告", "半年度报告"]).withColumn(
            "scope", F.lit("portfolio")
        ),
        R.report_scope(filings, "full").withColumn("scope", F.lit("full")),
    ]
    out = parts[0].select("ord", "scope")
    for p in parts[1:]:
        out = out.unionByName(p.select("ord", "scope"))
    return present(out)


@job("corpus_normalise", "SELECT doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM documents")
def _corpus(c):
    return present(R.normalise_corpus(c.table("documents")), "doc_id", "text")


@job("page_links", r"""
    SELECT page_id, CAST(i AS BIGINT) AS ord, hrefs[i + 1] AS href, labels_[i + 1] AS label
    FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<a(\s(?:"[^"]*"|''[^'']*''|[^>"''])*)>(.*?)</a\s*>', 1),
                   lambda t: regexp_replace(regexp_extract(t, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')) AS hrefs,
                 list_transform(regexp_extract_all(html, '(?is)<a(\s(?:"[^"]*"|''[^'']*''|[^>"''])*)>(.*?)</a\s*>', 2), lambda t: regexp_replace(t, '<[^>]*>', '', 'g')) AS labels_ FROM pages),
         LATERAL (SELECT unnest(range(0, len(hrefs))) AS i)
    WHERE regexp_matches(hrefs[i + 1], '^/[a-zA-Z]+$')""")
def _page_links(c):
    return present(R.page_links(c.table("pages"), "^/[a-zA-Z]+$"))


@job("landing_count_check", """
    SELECT query, landed, declared, landed = declared AS complete FROM (
      SELECT CAST(o_custkey AS VARCHAR) AS query, count(*) AS landed,
             CAST(max(CASE WHEN o_custkey % 10 = 0 THEN n + 1 ELSE n END) AS BIGINT) AS declared
      FROM orders JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey GROUP BY 1)""")
def _landing_counts(c):
    """Announcement pages as landed JSON, checked against the totals.

    A page holds one query's announcements out of a thousand consecutive ids, so it stays small
    for a query that owns any share of all rows.
    """
    orders = c.table("orders")
    totals = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    page = F.floor(F.col("o_orderkey") / 1000)
    pages = (
        orders.groupBy("o_custkey", page.alias("page"))
        .agg(
            F.collect_list(
                F.struct(
                    F.col("o_custkey").cast("string").alias("code"),
                    F.col("o_orderpriority").alias("title"),
                    F.col("o_totalprice").alias("size"),
                )
            ).alias("announcements")
        )
        .join(totals, "o_custkey")
    )
    declared = F.col("total") + F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(0)
    raw = pages.select(
        F.to_json(
            F.struct(
                F.col("o_custkey").cast("string").alias("query"),
                F.col("page").cast("bigint").alias("page"),
                declared.alias("total"),
                "announcements",
            )
        ).alias("payload")
    )
    return present(R.landing_counts(R.flatten_announcements(raw)))


@job("write_replace", "SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close FROM price")
def _write_replace(c):
    path = shared_dir(c.spark, "price-table")
    K.replace_table(stored_price(c).select("code", "trade_date", "close"), path)
    K.replace_table(c.price(), path)
    return present(c.spark.read.parquet(path))


@job("write_append", """
    SELECT code, trade_date, close FROM stored_price UNION ALL SELECT code, trade_date, close FROM batch_price""")
def _write_append(c):
    path = shared_dir(c.spark, "price-table")
    K.append_table(stored_price(c), path)
    K.append_table(batch_price(c), path)
    return present(c.spark.read.parquet(path), "code", "trade_date", "close")


@job("upsert_keyset", """
    SELECT code, trade_date, close, CAST(batch_no AS BIGINT) AS batch_no FROM stored_price
    WHERE NOT (code IN (SELECT code FROM batch_price) AND trade_date IN (SELECT trade_date FROM batch_price))
    UNION ALL SELECT code, trade_date, close, batch_no FROM batch_price""")
def _upsert_keyset(c):
    return present(K.upsert_by_keyset(stored_price(c), batch_price(c), ["code", "trade_date"]))


@job("upsert_exact", """
    SELECT code, trade_date, close, CAST(batch_no AS BIGINT) AS batch_no FROM stored_price s
    WHERE NOT EXISTS (SELECT 1 FROM batch_price b WHERE b.code = s.code AND b.trade_date = s.trade_date)
    UNION ALL SELECT code, trade_date, close, batch_no FROM batch_price""")
def _upsert_exact(c):
    return present(K.upsert_by_keyset(stored_price(c), batch_price(c), ["code", "trade_date"], exact=True))


@job("upsert_stored", """
    SELECT code, trade_date, close, CAST(batch_no AS BIGINT) AS batch_no FROM stored_price s
    WHERE NOT EXISTS (SELECT 1 FROM batch_price b WHERE b.code = s.code AND b.trade_date = s.trade_date)
    UNION ALL SELECT code, trade_date, close, batch_no FROM batch_price""")
def _upsert_stored(c):
    """The exact upsert into a stored table, of which only the partitions with keys of the batch are written anew."""
    root = shared_dir(c.spark, "price-buckets")
    K.store_buckets(stored_price(c), root, "code", 16)
    K.upsert_buckets(c.spark, root, batch_price(c), 0, ["code", "trade_date"], 16)
    return present(K.read_buckets(c.spark, root))


@job("incremental_append", """
    SELECT b.code, b.event_id, CAST(b.close AS DOUBLE) AS close FROM batch_ticks b
    LEFT JOIN (SELECT code, max(ts) AS mark FROM stored_ticks GROUP BY code) m ON m.code = b.code
    WHERE mark IS NULL OR b.ts > mark""")
def _incremental(c):
    ticks = c.ticks()
    stored = ticks.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    batch = ticks.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return present(K.append_newer(stored, batch, "code", "ts"), "code", "event_id", "close")


@job("insert_new_keys", """
    SELECT DISTINCT code, name FROM filings WHERE code NOT IN (SELECT code FROM ledger WHERE report_time < 1997)""")
def _insert_new(c):
    batch = c.filings().select("code", "name").distinct()
    return present(K.insert_unseen(c.ledger().where(F.col("report_time") < 1997), batch, ["code"]))


@job("ledger_merge", """
    SELECT code, report_type, ord, CAST(publish_date AS VARCHAR) AS publish_date FROM (
      SELECT *, row_number() OVER (PARTITION BY code, report_type ORDER BY b DESC, ord DESC) AS rn FROM (
        SELECT code, report_type, ord, publish_date, 0 AS b FROM ledger
        UNION ALL SELECT code, report_type, ord, publish_date, 1 FROM filings WHERE report_time = 1999)) WHERE rn = 1
    ORDER BY code DESC, report_type DESC""")
def _ledger_merge(c):
    cols = ["code", "report_type", "ord", "publish_date"]
    merged = K.merge_ledger(
        c.ledger().select(*cols),
        c.filings().where(F.col("report_time") == 1999).select(*cols),
        ["code", "report_type"],
        "ord",
    )
    return present(merged.orderBy(F.desc("code"), F.desc("report_type")))


@job("sorted_export", "SELECT name, code, kind FROM securities ORDER BY kind || code, code")
def _sorted_export(c):
    return present(K.sorted_export(c.securities()), "name", "code", "kind")


@job("ledger_remove", """
    SELECT ord, file_name FROM ledger WHERE ord NOT IN (SELECT ord FROM filings WHERE report_type = '第三季度报告')
    ORDER BY ord""")
def _ledger_remove(c):
    items = c.filings().where(F.col("report_type") == "第三季度报告")
    return present(K.ledger_remove(c.ledger(), items, ["ord"]).select("ord", "file_name").orderBy("ord"))


@job("ledger_add", """
    SELECT ord, file_name FROM ledger UNION SELECT ord, file_name FROM filings WHERE report_type = '第三季度报告'""")
def _ledger_add(c):
    items = c.filings().where(F.col("report_type") == "第三季度报告").select("ord", "file_name")
    return present(K.ledger_add(c.ledger().select("ord", "file_name"), items))


@job("replacement_scan", """
    SELECT doc_id, coalesce(replace(replace(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END, chr(13), ''), chr(10), ''), '')
             AS text, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, '') AS lang FROM documents""")
def _replacement_scan(c):
    raw = c.table("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"),
    )
    return present(R.clean_replacements(raw))


@job("schema_typed_table", """
    SELECT code, CAST(year AS VARCHAR) || '年' AS report_time, CAST(CAST(revenue AS DECIMAL(38,4)) AS DOUBLE) AS revenue,
           CAST(CAST(revenue AS DECIMAL(38,4)) AS DOUBLE) AS revenue1, CAST(CAST(fees AS DECIMAL(38,4)) AS DOUBLE) AS fees
    FROM statement""")
def _schema_typed(c):
    """Statement rows cast to a configured schema (repeated measure name numbered)."""
    schema, _ = K.table_schema(
        {"report_time": "DATE NOT NULL", "code": "INTEGER NOT NULL"}, [], ["revenue", "revenue", "fees"]
    )
    table = c.statement().select(
        F.concat(F.col("year").cast("string"), F.lit("年")).alias("report_time"),
        "code",
        "revenue",
        F.col("revenue").alias("revenue1"),
        "fees",
    )
    return present(table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
