"""Sources, sinks and streaming jobs on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import CHECKPOINT_KEY, shared_dir
from tidemark.sources import readers as R
from tidemark.sources import sinks as K
from tidemark.streaming import incremental as I
from tidemark.streaming import moving_average as A


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_gbk_prices_missing_and_empty_files(spark, tmp_path):
    full, empty = tmp_path / "full.csv", tmp_path / "empty.csv"
    full.write_bytes("日期,代码,名称\n2020-01-02,000001,平安银行\n".encode("gbk"))
    empty.write_bytes("日期,代码,名称\n".encode("gbk"))
    paths = [f"file://{full}", f"file://{empty}", f"file://{tmp_path}/missing.csv"]
    df = R.read_price_csv(spark, paths, ["trade_date", "code", "name"])
    assert rows(df) == [("2020-01-02", "000001", "平安银行")]
    assert [r["path"].split("/")[-1] for r in R.empty_files(spark, paths[:2]).collect()] == ["empty.csv"]
    assert R.read_price_csv(spark, paths[2:], ["a"]).count() == 0


def test_code_list_without_header(spark, tmp_path):
    f = tmp_path / "codes.csv"
    f.write_text("平安银行,000001,公司\n上证指数,000001,指数\n平安银行,000001,公司\n", encoding="utf-8")
    listed = R.read_code_list(spark, f"file://{f}")
    extra = spark.createDataFrame([("国债1", "010107", "国债")], "name string, code string, kind string")
    assert R.security_dimension(listed, extra).count() == 3


def test_required_cells(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(R.null_cells(df)) == [("k", 0), ("v", 1)]
    assert R.require_no_nulls(df.where("k = 1")).count() == 1
    with pytest.raises(Exception, match="null cell in column v"):
        R.require_no_nulls(df).collect()


def test_announcement_pages(spark):
    page = {"query": "q", "page": 1, "total": 3, "announcements": [{"code": "1", "title": "t", "size": 2.0}] * 2}
    raw = spark.createDataFrame([(json.dumps(page),)], "payload string")
    got = R.landing_counts(R.flatten_announcements(raw)).first()
    assert (got["landed"], got["declared"], got["complete"]) == (2, 3, False)


def test_links(spark):
    html = '<p><a href="/SH600000.html" class="x">浦发银行(600000)</a><a href="/other">no</a></p>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(R.page_links(df, "S[HZ][0-9]{6}")) == [(1, 0, "/SH600000.html", "浦发银行(600000)")]


def test_replacements(spark, tmp_path):
    spark.createDataFrame([("a\nb", None)], "x string, y string").write.parquet(f"{tmp_path}/fixes")
    assert rows(R.read_replacements(spark, str(tmp_path), "fixes")) == [("ab", "")]


def test_upserts(spark):
    stored = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 0), ("b", 3, 0)], "code string, y int, v int")
    batch = spark.createDataFrame([("a", 1, 9), ("b", 2, 9)], "code string, y int, v int")
    product = K.upsert_by_keyset(stored, batch, ["code", "y"])
    assert rows(product) == [("a", 1, 9), ("b", 2, 9), ("b", 3, 0)]  # (a,2) and (b,1) go with the product
    exact = K.upsert_by_keyset(stored, batch, ["code", "y"], exact=True)
    assert rows(exact) == [("a", 1, 9), ("a", 2, 0), ("b", 1, 0), ("b", 2, 9), ("b", 3, 0)]
    assert rows(K.upsert_by_keyset(product, batch, ["code", "y"])) == rows(product)
    assert rows(K.upsert_by_keyset(exact, batch, ["code", "y"], exact=True)) == rows(exact)
    nothing = batch.where("false")
    assert rows(K.upsert_by_keyset(stored, nothing, ["code", "y"])) == rows(stored)


def test_ledger(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 0, "n"), ("c", 1, "n"), ("c", 2, "m")], "k string, n int, v string")
    assert rows(K.merge_ledger(old, new, ["k"], "n")) == [("a", 0, "n"), ("b", 5, "o"), ("c", 2, "m")]


def test_schema_from_configuration():
    schema, keys = K.table_schema(
        {"report_time": "DATE NOT NULL", "code": "INTEGER NOT NULL", "unit": "CHAR(10)"}, ["h"], ["m", "m", "n"]
    )
    assert keys == ["report_time", "code"]
    assert schema.fieldNames() == ["report_time", "code", "unit", "h", "m", "m1", "n"]
    assert schema["code"].dataType == T.StringType() and schema["m"].dataType == T.DecimalType(38, 4)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "t string, v int")
    path = f"{tmp_path}/table"
    K.replace_partitions(df, path, ["t"])
    K.replace_partitions(df.where("t = 'a'").withColumn("v", F.lit(7)), path, ["t"])
    assert rows(spark.read.parquet(path), "t", "v") == [("a", 7), ("b", 2)]
    one = K.write_version(df, f"{tmp_path}/v", 1)
    two = K.write_version(spark.read.parquet(one).where("v = 1"), f"{tmp_path}/v", 2)
    assert spark.read.parquet(one).count() == 2 and spark.read.parquet(two).count() == 1


def test_state_goes_to_the_named_folder(spark, tmp_path):
    before = spark.conf.get(CHECKPOINT_KEY, None)
    if before is None:
        assert "tidemark-" in shared_dir(spark, "x")
    else:
        assert shared_dir(spark, "x").startswith(before.rstrip("/") + "/x-")


TICK = "code string, ts timestamp, event_id long, close double"


def tick(code, day, hour, event_id, close):
    return (code, dt.datetime(2024, 1, day, hour), event_id, close)


def land(spark, path, *ticks):
    spark.createDataFrame(list(ticks), TICK).coalesce(1).write.mode("append").parquet(path)


def test_feed_drops_late_and_repeated_rows_and_restarts(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/store"
    stored = spark.createDataFrame([tick("a", 5, 1, 1, 1.0)], TICK)
    I.seed_store(stored, root, "code", "ts")
    land(spark, source, tick("a", 4, 1, 2, 2.0), tick("a", 6, 1, 3, 3.0), tick("a", 6, 1, 3, 3.0), tick("b", 1, 1, 4, 4.0))

    def run():
        feed = spark.readStream.schema(TICK).parquet(source)
        I.run_incremental(feed, root, "code", "ts", "event_id").awaitTermination()

    run()
    assert rows(I.read_store(spark, root), "event_id") == [(1,), (3,), (4,)]
    land(spark, source, tick("a", 6, 0, 5, 5.0), tick("b", 7, 1, 6, 6.0))
    run()
    assert rows(I.read_store(spark, root), "event_id") == [(1,), (3,), (4,), (6,)]
    # a batch written twice leaves what it wrote once
    again = spark.createDataFrame([tick("b", 7, 1, 6, 6.0)], TICK)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "store" / "rows").iterdir() if "seed" not in p.name)
    I.append_batch(root, "code", "ts")(again, last)
    assert rows(I.read_store(spark, root), "event_id") == [(1,), (3,), (4,), (6,)]


def test_daily_totals_follow_the_feed(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/days"
    land(spark, source, tick("a", 1, 1, 1, 2.0), tick("a", 1, 2, 2, 4.0))
    for _ in range(2):
        feed = spark.readStream.schema(TICK).parquet(source)
        A.store_daily(feed, root, "10 days").awaitTermination()
        land(spark, source, tick("a", 1, 3, 3, 6.0), tick("a", 9, 1, 4, 8.0))
    days = A.current_days(spark, root)
    assert rows(days, "n", "total") == [(1, 8.0), (3, 12.0)]
    average = {r["trade_date"].day: r["average"] for r in A.moving_average(days, 7).collect()}
    assert average == {1: 4.0, 9: 8.0}
    wide = {r["trade_date"].day: r["average"] for r in A.moving_average(days, 30).collect()}
    assert wide == {1: 4.0, 9: 5.0}


def test_sliding_average_in_append_mode(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        feed = spark.readStream.schema(TICK).parquet(source)
        query = (
            A.sliding_average(feed, "2 days", "1 day", "1 hour")
            .writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    land(spark, source, tick("a", 1, 1, 1, 2.0), tick("a", 2, 1, 2, 4.0))
    run()
    land(spark, source, tick("a", 9, 1, 3, 1.0))
    run()
    got = {r["as_of"].day: r["average"] for r in spark.read.parquet(out).collect()}
    assert got[2] == 2.0 and got[3] == 3.0 and got[4] == 4.0


def test_empty_announcement_page_is_counted(spark):
    raw = spark.createDataFrame([('{"query": "q", "page": 1, "total": 5, "announcements": []}',)], "payload string")
    got = R.landing_counts(R.flatten_announcements(raw)).first()
    assert (got["query"], got["landed"], got["declared"], got["complete"]) == ("q", 0, 5, False)


def test_links_in_any_spelling(spark):
    html = "<A class=x href='/a'>one <b>two</b></A> <a href=/b>c</a><a title=\"t\" HREF = \"/d\" id=1>e\nf</a><a name=x>no</a><abbr href='/z'>q</abbr>"
    got = R.page_links(spark.createDataFrame([(1, html)], "page_id long, html string"), "^/").collect()
    assert [(r["href"], r["label"]) for r in got] == [("/a", "one two"), ("/b", "c"), ("/d", "e\nf")]


def test_links_with_brackets_in_quoted_attributes(spark):
    html = "<a title='a > b' href=\"/x\">one</a><a data-x=\"</a>\" href='/y?q=>'>two</a>"
    got = R.page_links(spark.createDataFrame([(1, html)], "page_id long, html string"), "^/").collect()
    assert [(r["href"], r["label"]) for r in got] == [("/x", "one"), ("/y?q=>", "two")]


def test_a_lagging_key_keeps_its_rows_and_marks_must_be_there(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "code string, ts timestamp, event_id long"
    rows = lambda *r: spark.createDataFrame([(c, __import__("datetime").datetime(2024, 1, d), i) for c, d, i in r], schema)
    I.seed_store(rows(("a", 1, 1), ("b", 1, 2)), root, "code", "ts")
    write = I.append_batch(root, "code", "ts", "event_id")
    write(rows(("a", 20, 3)), 0)
    write(rows(("b", 5, 4), ("b", 5, 4)), 1)
    assert sorted(r["event_id"] for r in I.read_store(spark, root).collect()) == [1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        write(rows(("a", 21, 5)), 5)


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session(), "x")


def test_batches_are_merged_and_may_run_again(spark, tmp_path):
    from tidemark.streaming import folders as D

    root = str(tmp_path / "store")
    I.seed_store(spark.createDataFrame([tick("a", 1, 0, 0, 0.0)], TICK), root, "code", "ts")
    write = I.append_batch(root, "code", "ts", "event_id", every=3)
    for n in range(20):
        batch = spark.createDataFrame([tick("a", n + 2, 1, n + 1, 1.0), tick("b", n + 2, 1, 100 + n, 1.0)], TICK)
        write(batch, n)
        if n % 4 == 0:
            write(batch, n)  # run again after a failure
        assert sorted(r[0] for r in I.read_store(spark, root).select("event_id").collect()) == [*range(n + 2), *range(100, 101 + n)]
    names = sorted(p.name for p in (tmp_path / "store" / "rows").iterdir() if p.is_dir())
    assert names == ["batch=0-8", "batch=18", "batch=19", "batch=9-17", "batch=seed"]
    assert len([p for p in (tmp_path / "store" / "marks").iterdir() if p.is_dir()]) == 2
    # a wider folder counts once it is finished, whatever narrower ones still lie there
    spark.read.parquet(f"{root}/rows/batch=0-8").write.parquet(f"{root}/rows/batch=4")
    (tmp_path / "store" / "rows" / "batch=0-17").mkdir()
    assert I.read_store(spark, root).count() == 41
    assert D.covering(["batch=0", "batch=1", "batch=0-1", "batch=2", "batch=seed", "other", "batch=x"]) == ["batch=seed", "batch=0-1", "batch=2"]


def test_keyed_rewrite_leaves_other_partitions(spark, tmp_path):
    root = str(tmp_path / "table")
    stored = spark.createDataFrame([(f"c{i}", d, float(i), 0) for i in range(60) for d in (1, 2)], "code string, day int, close double, batch_no int")
    batch = spark.createDataFrame([("c3", 2, 9.0, 1), ("c3", 5, 9.0, 1), ("new", 1, 9.0, 1)], stored.schema)
    K.store_buckets(stored, root, "code", 16)

    def files():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "table" / "rows").rglob("*.parquet")}

    before = files()
    for _ in range(2):
        K.upsert_buckets(spark, root, batch, 7, ["code", "day"], 16)
    want = sorted(map(tuple, K.upsert_by_keyset(stored, batch, ["code", "day"], exact=True).collect()))
    assert sorted(map(tuple, K.read_buckets(spark, root).collect())) == want
    after = files()
    touched = {r[0] for r in batch.select(K.bucket_of("code", 16)).collect()}
    left = {p for p in before if not any(f"_bucket={b}/" in p for b in touched)}
    assert left and all(after.get(p) == before[p] for p in left) and not set(after) & (set(before) - left)


def test_keyed_rewrite_goes_on_from_its_stage(spark, tmp_path):
    import shutil

    root = str(tmp_path / "table")
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "code string, v int")
    batch = spark.createDataFrame([("a", 2)], "code string, v int")
    K.store_buckets(stored, root, "code", 4)
    K.upsert_buckets(spark, root, batch, 1, ["code"], 4)
    # as if the run had been cut off while it replaced the partition
    bucket = batch.select(K.bucket_of("code", 4)).first()[0]
    shutil.rmtree(f"{root}/applied")
    shutil.rmtree(f"{root}/rows/_bucket={bucket}")
    K.upsert_buckets(spark, root, batch, 1, ["code"], 4)
    assert rows(K.read_buckets(spark, root), "code", "v") == [("a", 2), ("b", 1)]


def test_row_averages_of_many_batches_equal_one(spark, tmp_path):
    from decimal import Decimal

    from tidemark.operators import series as S
    from tidemark.streaming import row_average as B

    schema = "code string, trade_date date, close decimal(18,4)"
    closes = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=i), Decimal(i * 37 % 101) / 4) for c in "ab" for i in range(40 if c == "a" else 7)]
    late = [("a", dt.date(2024, 1, 3), Decimal(99))]
    columns = ("code", "trade_date", "close", "record_id", "x", "y")
    want = rows(S.moving_averages(spark.createDataFrame(closes, schema), {"x": 3, "y": 12}), *columns)
    for name, cuts in (("one", [0, 40]), ("many", [0, 1, 2, 10, 11, 40])):
        for lo, hi in zip(cuts, cuts[1:]):
            part = [r for r in closes if lo <= (r[1] - dt.date(2024, 1, 1)).days < hi] + (late if lo == 11 else [])
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        B.store_averages(feed, f"{tmp_path}/store-{name}", {"x": 3, "y": 12}, every=2).awaitTermination()
        assert rows(B.read_averages(spark, f"{tmp_path}/store-{name}"), *columns) == want


def test_row_average_state_expires_in_the_time_of_the_feed(spark, tmp_path):
    from tidemark.streaming import row_average as B

    schema = "code string, trade_date date, close double"
    for part in ([("a", dt.date(2024, 1, 1), 1.0)], [("b", dt.date(2024, 6, 1), 1.0)], [("b", dt.date(2024, 6, 2), 1.0)], [("a", dt.date(2024, 6, 3), 3.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = B.row_averages(feed, {"x": 1}, ttl_days=30)
    out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got, "code", "record_id") == [("a", 0), ("a", 0), ("b", 0), ("b", 1)]
