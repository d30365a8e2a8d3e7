"""Feature preparation and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as M
from tidemark.operators.chain import Chain, Step
from tidemark.operators import ordering as O
from tidemark.operators import series as S
from tidemark.plans import scoring as P
from tidemark.plans import trend_job
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present
from tidemark.session import materialise, shared_dir
from tidemark.sources import sinks

define("scalable", """
    SELECT code, trade_date, CAST(close AS DOUBLE) AS close, CAST(lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS DOUBLE) AS opening
    FROM price""")


def scalable(c):
    w = S._series()
    return c.price().select(
        "code", "trade_date", F.col("close").cast("double").alias("close"), F.lag("close").over(w).cast("double").alias("opening")
    )


@job("scale_group", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, close / m AS close
    FROM scalable JOIN (SELECT code, max(abs(close)) AS m FROM scalable GROUP BY code) USING (code)""")
def _scale_group(c):
    return present(M.scale(scalable(c), [M.ScaleRule("close"), M.ScaleRule("absent")], ["code"]), "code", "trade_date", "close")


@job("scale_whole", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, close / (SELECT max(abs(close)) FROM scalable) AS close FROM scalable""")
def _scale_whole(c):
    return present(M.scale(scalable(c), [M.ScaleRule("close", "whole")], ["code"]), "code", "trade_date", "close")


@job("scale_dependent", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, close / m AS close, opening / m AS opening
    FROM scalable JOIN (SELECT code, max(abs(close)) AS m FROM scalable GROUP BY code) USING (code)""")
def _scale_dependent(c):
    rules = [M.ScaleRule("opening", "group", "close"), M.ScaleRule("close")]
    return present(M.scale(scalable(c), rules, ["code"]))


@job("one_hot", """
    SELECT ord, CAST(report_type = '年度报告' AS BIGINT) AS "report_type_年度报告", CAST(report_type = '半年度报告' AS BIGINT) AS "report_type_半年度报告",
           report_time FROM filings""")
def _one_hot(c):
    table = c.filings().select("ord", "report_time", "report_type")
    return present(M.one_hot(table, "report_type", ["年度报告", "半年度报告"], 1).drop("report_type"))


@job("pad_sequences", """
    SELECT code, CAST(batch AS BIGINT) AS batch, CAST(n AS BIGINT) AS length, array_to_string(list_concat(list_transform(v, lambda x: CAST(x AS VARCHAR)),
           list_transform(range(max(n) OVER (PARTITION BY batch) - n), lambda x: '0.0')), ',') AS steps
    FROM (SELECT *, (row_number() OVER (ORDER BY CAST(code AS BIGINT)) - 1) // 8 AS batch, len(v) AS n FROM (
      SELECT code, list(CAST(close AS DOUBLE) ORDER BY trade_date) AS v FROM price GROUP BY code))""")
def _pad(c):
    sequences = O.ordered_sequences(c.price(), ["close"]).select(
        "code", F.col("code").cast("bigint").alias("number"), F.transform("steps", lambda s: s["close"].cast("double")).alias("steps")
    )
    padded = M.pad_sequences(sequences, "number", batch_size=8)
    return present(padded.select("code", "batch", "length", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps")))


@job("kfold_assign", """
    SELECT code, fold, CASE WHEN fold = 2 THEN 'valid' ELSE 'train' END AS role FROM (
      SELECT code, CAST((row_number() OVER (ORDER BY code) - 1) // ((SELECT count(*) FROM securities) // 7) AS BIGINT) AS fold FROM securities)
    WHERE fold < 7""")
def _kfold(c):
    table = c.securities().select("code", F.col("code").cast("bigint").alias("number"))
    return present(M.assign_folds(table, "number", 7, 2), "code", "fold", "role")


define("corpus_chars", """
    SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, ch FROM (
      SELECT doc_id, generate_subscripts(chars, 1) AS i, unnest(chars) AS ch
      FROM (SELECT doc_id, string_split(text, '') AS chars FROM documents WHERE length(text) > 0))""")
define("corpus_size", "SELECT sum(length(text)) AS n FROM documents")


define("lanes", """
    SELECT pos, ch, pos // size AS lane, pos % size AS q FROM corpus_chars, (SELECT CAST(n // 16 AS BIGINT) AS size FROM corpus_size)""")


@job("windows_random", """
    SELECT batch, slot, x, y FROM (
      SELECT j, r // 32 AS batch, r % 32 AS slot FROM (
        SELECT j, CAST(row_number() OVER (ORDER BY md5('11:' || j), j) - 1 AS BIGINT) AS r
        FROM (SELECT unnest(range((SELECT CAST((n - 1) // 35 AS BIGINT) FROM corpus_size))) AS j))) o
    JOIN (SELECT j, string_agg(ch, '' ORDER BY pos) FILTER (k < 35) AS x, string_agg(ch, '' ORDER BY pos) FILTER (k > 0) AS y FROM (
        SELECT pos // 35 AS j, pos % 35 AS k, pos, ch FROM corpus_chars
        UNION ALL SELECT pos // 35 - 1, 35, pos, ch FROM corpus_chars WHERE pos % 35 = 0) GROUP BY j) w USING (j)
    WHERE batch < (SELECT ((n - 1) // 35) // 32 FROM corpus_size)""")
def _random_windows(c):
    return present(M.random_windows(c.table("documents"), steps=35, batch_size=32, seed=11))


@job("windows_consecutive", """
    SELECT step, lane, string_agg(ch, '' ORDER BY pos) FILTER (k < 35) AS x, string_agg(ch, '' ORDER BY pos) FILTER (k > 0) AS y FROM (
      SELECT lane, q // 35 AS step, q % 35 AS k, pos, ch FROM lanes UNION ALL
      SELECT lane, q // 35 - 1, 35, pos, ch FROM lanes WHERE q % 35 = 0 AND q > 0)
    WHERE step < (SELECT CAST((n // 16 - 1) // 35 AS BIGINT) FROM corpus_size) AND lane < 16 GROUP BY step, lane""")
def _consecutive(c):
    return present(M.consecutive_windows(c.table("documents"), steps=35, lanes=16))


@job("encode_chars", """
    SELECT doc_id, coalesce(char_ids, '[]') AS char_ids FROM documents LEFT JOIN (
    SELECT doc_id, '[' || string_agg(char_id, ',' ORDER BY i) || ']' AS char_ids FROM (
      SELECT doc_id, generate_subscripts(chars, 1) AS i, unnest(chars) AS ch
      FROM (SELECT doc_id, string_split(text, '') AS chars FROM documents WHERE length(text) > 0))
    JOIN (SELECT ch, row_number() OVER (ORDER BY ord(ch)) - 1 AS char_id
          FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '') USING (ch) GROUP BY doc_id) USING (doc_id)""")
def _encode(c):
    coded = M.encode_chars(c.table("documents"))
    return present(coded.select("doc_id", F.to_json("char_ids").alias("char_ids")))


define("lagged", """
    SELECT code, trade_date, CAST(close AS DOUBLE) AS y, CAST(lag(close) OVER w AS DOUBLE) AS a, CAST(lag(close, 2) OVER w AS DOUBLE) AS b
    FROM price_long WINDOW w AS (PARTITION BY code ORDER BY trade_date)""")
define("fitted", """
    SELECT (cay * vb - cby * cab) / (va * vb - cab * cab) AS wa, (cby * va - cay * cab) / (va * vb - cab * cab) AS wb, my, ma, mb
    FROM (SELECT covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, covar_pop(a, b) AS cab, var_pop(a) AS va, var_pop(b) AS vb,
                 avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM lagged WHERE b IS NOT NULL)""")


@job("growth_regression", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, round(my + wa * (a - ma) + wb * (b - mb), 2) AS predicted
    FROM lagged, fitted WHERE b IS NOT NULL""")
def _growth(c):
    features = materialise(P.lag_features(c.price_long(), 2), "growth-features")
    model = P.fit_growth(features, ["lag_1", "lag_2"], "close")
    scored = P.score(model, features, ["code", "trade_date"], ["predicted"])
    return present(scored.withColumn("predicted", F.round("predicted", 2)))


@job("score_batch")
def _score_batch(c):
    """Growth model applied to every series, its predictions stored with their keys."""
    features = materialise(P.lag_features(c.price(), 3), "score-features")
    model = P.fit_growth(features, ["lag_1", "lag_2", "lag_3"], "close")
    path = shared_dir(c.spark, "scores")
    sinks.replace_table(P.score(model, features, ["code", "trade_date", "close"], ["predicted"]), path)
    return present(c.spark.read.parquet(path))


@job("trend_direction")
def _direction(c):
    minor = trend_job.minor_pivots(c.price_long(), S.TREND_SETTINGS)
    segments = trend_job.level_segments(minor, trend_job.MEDIAN, 36, 7.3)
    return present(P.trend_direction(segments))


STEPS = [
    Step("opening", "prior", ("close",), ("opening",), {"by": "code", "order": "trade_date"}),
    Step("scaled", "scale", ("close", "opening"), ("close_part", "opening_part"), {"by": "code", "of": "close"}),
    Step("whole", "fill", ("opening_part",), ("opening_part",), {"value": 0.0}),
    Step("move", "formula", ("close_part", "opening_part"), ("move",), {"sql": "close_part - opening_part"}),
]


@job("transform_chain", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, close / m AS close_part, coalesce(opening / m, 0.0) AS opening_part,
           close / m - coalesce(opening / m, 0.0) AS move
    FROM scalable JOIN (SELECT code, max(abs(close)) AS m FROM scalable GROUP BY code) USING (code)""")
def _chain(c):
    """A chain fitted on the prices, stored, read back and applied to them."""
    prices = c.price().withColumn("close", F.col("close").cast("double"))
    path = shared_dir(c.spark, "chain")
    Chain(STEPS).fit(prices).save(c.spark, path)
    table = Chain.load(c.spark, path).apply(prices)
    return present(table, "code", "trade_date", "close_part", "opening_part", "move")


define("typed_statement", """
    SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, CASE o_orderstatus WHEN 'F' THEN '年度报告' WHEN 'O' THEN '半年度报告' WHEN 'P' THEN '第三季度报告' END AS report_type,
           CAST(year(o_orderdate) AS BIGINT) AS year, sum(revenue) / 1e6 AS y, sum(fees) / 1e6 AS a, sum(headcount) / 1e3 AS b
    FROM orders JOIN (
      SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue,
             sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS fees, sum(l_quantity) AS headcount
      FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY ALL""")
define("typed_fit", """
    SELECT report_type, (cay * vb - cby * cab) / (va * vb - cab * cab) AS wa, (cby * va - cay * cab) / (va * vb - cab * cab) AS wb, my, ma, mb
    FROM (SELECT report_type, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, covar_pop(a, b) AS cab, var_pop(a) AS va, var_pop(b) AS vb,
                 avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM typed_statement GROUP BY report_type)""")


@job("score_by_type", """
    SELECT code, report_type, year, round(my + wa * (a - ma) + wb * (b - mb), 4) AS predicted FROM typed_statement JOIN typed_fit USING (report_type)""")
def _score_by_type(c):
    """Revenue (millions) from fees and headcount, one model per report type, stored partitioned by type."""
    table = c.statement(by_type=True).select(
        "code", "report_type", "year", (F.col("revenue").cast("double") / 1e6).alias("y"), (F.col("fees").cast("double") / 1e6).alias("a"),
        (F.col("headcount").cast("double") / 1e3).alias("b"),
    )
    features = materialise(table, "typed-features")
    models = materialise(P.fit_by_group(features, "report_type", ["a", "b"], "y"), "typed-models")
    path = shared_dir(c.spark, "typed-scores")
    sinks.replace_partitions(P.score_by_group(models, features, "report_type", ["a", "b"], ["code", "year"]), path, ["report_type"])
    return present(c.spark.read.parquet(path).withColumn("predicted", F.round("predicted", 4)))
