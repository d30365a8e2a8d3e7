"""Report tables, fragments, numbering and features on small fixtures."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import facts as K
from tidemark.operators import features as M
from tidemark.operators import filters as S
from tidemark.operators import joins as J
from tidemark.operators import numbering as N
from tidemark.operators import ordering as O
from tidemark.operators import ratios as R
from tidemark.operators import statement as T
from tidemark.plans.statement_job import clean_statement


def table(spark, *rows, doc=1):
    return spark.createDataFrame(
        [(doc, i, list(cells)) for i, cells in enumerate(rows)], "doc_id long, row_idx long, cells array<string>"
    )


def cells(df):
    return [r["cells"] for r in df.orderBy("doc_id", "row_idx").collect()]


SPEC = T.TableSpec(
    header_words=["项目"],
    header_pattern="[0-9]{4}年|调整",
    labels=["营业收入", "净利润", "其中：研发费用"],
    label_pattern="[\\u4E00-\\u9FA5].*",
    label_aliases={"营业总收入": "营业收入"},
    discard=["备注"],
)


def test_leading_rows_go_and_headers_merge(spark):
    df = table(
        spark, ["编制单位", "None", "None"], ["None", "None", "None"], ["项目", "2015年", "None"], ["", "（调整后）", "2014年"],
        ["营业收入", "1", "2"], ["项目", "2015年", "2014年"], ["净利润", "3", "4"], ["项目", "2013年", "x"],
    )
    assert cells(T.merge_headers(df, SPEC)) == [
        ["项目", "2015年（调整后）", "2014年"], ["营业收入", "1", "2"], ["项目", "2015年", "2014年"], ["净利润", "3", "4"],
        ["项目", "2013年", "x"],
    ]


def test_broken_labels_merge(spark):
    df = table(
        spark, ["营业", "1", "None"], ["收入", "None", "2"], ["", "5", "6"], ["净利", "None", "None"], ["润", "None", "None"],
        ["其中：", "None", "None"], ["研发", "7", "None"], ["费用", "None", "8"],
    )
    got = cells(T.merge_labels(df, SPEC.labels))
    assert got == [["营业收入", "1", "2"], ["净利润", "5", "6"], ["其中：研发费用", "7", "8"]]


def test_longest_label_wins():
    assert T.alternation(["收入", "营业收入", "收入"]) == "\\Q营业收入\\E|\\Q收入\\E"


def test_match_starts(spark):
    df = spark.createDataFrame([("xabyyaabb",), ("",), ("none",)], "t string")
    got = [r["s"] for r in df.select(T.match_starts(F.col("t"), "ab|b").alias("s")).collect()]
    assert got == [[1, 6, 8], [], []]


def test_header_labels_merge_after_transposing(spark):
    df = table(spark, ["营业", "收入", "净利润"], ["1", "None", "3"])
    assert cells(T.merge_header_labels(df, SPEC.labels)) == [["营业收入", "净利润"], ["1", "3"]]


def test_statement_end_to_end(spark):
    good = table(
        spark, ["项目", "2015.12.31", "2014"], ["营业总", "1,200.5元", "（300）"], ["收入", "None", "None"], ["净利润", "减少2个百分点", "--"],
        ["备注", "1", "2"], ["净利润", "7", "8"],
    )
    empty = table(spark, ["项目", "2015年", "2014年"], doc=2)
    facts = clean_statement(good.unionByName(empty), SPEC, F.lit(2016)).orderBy("row_idx", "report_time").collect()
    got = {(r["label"], r["report_time"]): r["value"] if r["value"] is None else float(r["value"]) for r in facts}
    assert got == {
        ("营业收入", 2015): 1200.5, ("营业收入", 2014): -300.0, ("净利润", 2015): -2.0, ("净利润", 2014): None,
        ("净利润1", 2015): 7.0, ("净利润1", 2014): 8.0,
    }
    assert {r["doc_id"] for r in facts} == {1}


def test_statement_parts_grow_with_the_rows(spark, monkeypatch):
    docs = [table(spark, ["项目", "2015.12.31", "2014"], ["营业收入", "1", "2"], ["净利润", str(i), "--"], doc=i) for i in range(12)]
    rows = reduce(DataFrame.unionByName, docs)
    whole = clean_statement(rows, SPEC, F.lit(2016))
    monkeypatch.setattr(T, "TASK_ROWS", 4)
    parts = clean_statement(rows, SPEC, F.lit(2016))
    assert T.dealt(rows).rdd.getNumPartitions() == 9
    assert T.dealt(rows.limit(0)).rdd.getNumPartitions() == 1
    placed = T.dealt(rows).select("doc_id", F.spark_partition_id().alias("part")).distinct()
    assert placed.count() == 12
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and parts.count() == 48


def test_sections(spark):
    df = spark.createDataFrame(
        [(1, i, x) for i, x in enumerate(["行业", "a", "产品", "b", "c"])], "doc_id long, row_idx long, label string"
    )
    got = [(r["label"], r["行业"], r["产品"]) for r in T.section_columns(df, ["行业", "产品"]).orderBy("row_idx").collect()]
    assert got == [("行业", "行业", ""), ("a", "a", ""), ("b", "", "b"), ("c", "", "c")]


def test_rows_and_cells_round_trip(spark):
    nested = spark.createDataFrame([(1, [["a", None], ["b", "c"]])], "doc_id long, table array<array<string>>")
    df = T.rows_from_nested(nested)
    assert cells(df) == [["a", "None"], ["b", "c"]]
    assert cells(T.rows_from_cells(T.cells_long(df))) == cells(df)


def pick(spark, *frags):
    rows = [(1, page, frag, score, ended, 3) for page, frag, score, ended in frags]
    df = spark.createDataFrame(rows, "doc_id long, page long, frag long, score long, ended boolean, width int")
    return {r["page"]: (r["picked"], r["score"], r["ended"]) for r in K.pick_fragments(df).collect()}


def test_fragment_choice_depends_on_order(spark):
    assert pick(spark, (0, 0, 1, True), (0, 1, 2, False))[0] == ([1], 2, False)
    assert pick(spark, (0, 0, 2, False), (0, 1, 1, True))[0] == ([1], 1, True)
    assert pick(spark, (0, 0, 0, True))[0] == ([], 0, False)
    later = pick(spark, (0, 0, 1, False), (1, 0, 0, False), (1, 1, 0, False), (2, 0, 0, False), (2, 1, 0, True), (2, 2, 3, False))
    assert later[1] == ([0, 1], 0, False) and later[2] == ([1], 0, True)


def test_stitching_restarts(spark):
    def stitched(*pages):
        df = spark.createDataFrame([(1, *p) for p in pages], "doc_id long, page long, score long, ended boolean")
        return sorted(r["page"] for r in K.stitch_pages(df).collect())

    assert stitched((0, 0, False), (1, 2, False), (2, 0, True), (3, 4, False)) == [1, 2]
    assert stitched((1, 2, False), (2, 3, False), (3, 0, False)) == [2, 3]
    assert stitched((1, 2, False), (5, 2, False)) == [5]
    assert stitched((1, 2, False), (2, 2, False)) == [1, 2]
    assert stitched((1, 0, False)) == []


def test_offsets_over_levels(spark):
    rng = random.Random(1)
    keys = rng.sample(range(0, 5000), 400)
    rows = [(k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k long, w long")
    total, want = 0, {}
    for k, w in sorted(rows):
        want[k] = total
        total += w
    assert {r["k"]: r["offset"] for r in N.with_offset(df, "k", "w").collect()} == want
    position = {r["k"]: r["position"] for r in N.with_position(df, "k").collect()}
    assert position == {k: i for i, k in enumerate(sorted(keys))}
    ranks = [r["rank"] for r in N.with_shuffled_rank(df, "k", 7).collect()]
    assert sorted(ranks) == list(range(400))


@pytest.mark.parametrize("steps, lanes", [(3, 1), (4, 2), (7, 5), (50, 3), (1, 1)])
def test_corpus_windows(spark, steps, lanes):
    rng = random.Random(steps)
    texts = ["".join(rng.choice("abcdé\n中") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(40)]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = "".join(texts)
    size = len(whole) // lanes
    want = {}
    for lane in range(lanes):
        for step in range(max(0, (size - 1) // steps)):
            at = lane * size + step * steps
            want[(step, lane)] = (whole[at : at + steps], whole[at + 1 : at + steps + 1])
    got = {(r["step"], r["lane"]): (r["x"], r["y"]) for r in M.consecutive_windows(df, steps, lanes).collect()}
    assert got == want


def test_random_batches_cover_full_batches(spark):
    df = spark.createDataFrame([(i, "abcdefghij" * i) for i in range(1, 6)], "doc_id long, text string")
    rows = M.random_windows(df, 7, 4, seed=3).collect()
    whole = "".join("abcdefghij" * i for i in range(1, 6))
    assert len(rows) == (len(whole) - 1) // 7 // 4 * 4
    assert {(r["batch"], r["slot"]) for r in rows} == {(b, s) for b in range(len(rows) // 4) for s in range(4)}
    known = [whole[i : i + 8] for i in range(0, len(whole) - 7, 7)]
    assert all(r["x"] + r["y"][-1] in known for r in rows)


def test_encoding(spark):
    df = spark.createDataFrame([(1, "ba中a"), (2, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["char_ids"] for r in M.encode_chars(df).collect()} == {1: [1, 0, 2, 0], 2: []}


def test_scaling(spark):
    df = spark.createDataFrame([("a", -4.0, 2.0), ("a", 2.0, 8.0), ("b", 0.0, 1.0)], "code string, x double, y double")
    rules = [M.ScaleRule("y", "group", "x"), M.ScaleRule("x"), M.ScaleRule("gone")]
    assert sorted(map(tuple, M.scale(df, rules, ["code"]).collect())) == [("a", -1.0, 0.5), ("a", 0.5, 2.0), ("b", 0.0, 1.0)]


def test_padding(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0]), (3, [5.0])], "n long, steps array<double>")
    got = {r["n"]: (r["steps"], r["length"]) for r in M.pad_sequences(df, "n", 2, 2).collect()}
    assert got == {1: ([1.0, 0.0], 1), 2: ([2.0, 3.0], 2), 3: ([5.0], 1)}


def test_third_quarter_choices(spark):
    def chosen(kind, *labels):
        df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "doc_id long, row_idx long, label string")
        return [r["label"] for r in O.third_quarter_rows(df, "doc_id", "row_idx", "label", kind).orderBy("row_idx").collect()]

    assert chosen("accounting", "h", "上期金额", "c") == ["h", "c"]
    assert chosen("accounting", "h", "b", "c") == ["h", "c"]
    assert chosen("accounting", "h", "b") == ["h", "b"]
    assert chosen("profit", "a", "本报告期金额", "c") == ["本报告期金额"]
    assert chosen("profit", "a", "b", "c", "d", "e") == ["d"]


def test_picks_keep_first_of_ties(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("k", 3, 4)], "k string, arrival int, size int")
    assert A.pick_max(df, ["k"], "size", "arrival").first()["arrival"] == 1
    assert A.pick_first(df, ["k"], "arrival").first()["size"] == 5


def test_todo_and_done_make_the_grid(spark):
    codes = spark.createDataFrame([("a",), ("b",)], "code string")
    grid = J.work_grid(codes, F.lit(2018), F.lit(2020), ["x", "y"])
    done = grid.where("report_time = 2019")
    todo = J.outstanding(grid, done, ["code", "report_time", "report_type"])
    assert grid.count() == 12 and todo.unionByName(done).exceptAll(grid).isEmpty() and todo.count() == 8
    listing = spark.createDataFrame([("a", "x", 2018)], "code string, report_type string, listing_year int")
    assert J.after_listing(grid, listing).count() == 11


def test_page_budget(spark):
    df = spark.createDataFrame(
        [("t", i, i == 9) for i in range(6)] + [("u", 0, False), ("u", 1, True), ("u", 2, False)], "k string, page int, ended boolean"
    )
    got = sorted((r["k"], r["page"]) for r in S.page_budget(df, "k", "page", "ended", 2).collect())
    assert got == [("t", 0), ("t", 1), ("t", 2), ("u", 0), ("u", 1)]


def test_dupont_identity(spark):
    df = spark.createDataFrame(
        [("a", 2019, 100.0, 10.0, 50.0, 200.0), ("a", 2020, 120.0, 15.0, 60.0, 210.0)],
        "code string, year int, revenue double, net_profit double, equity double, total_assets double",
    )
    for m in R.PRIOR_MEASURES + ["operating_profit", "cost"]:
        if m not in df.columns:
            df = df.withColumn(m, F.lit(1.0))
    r = R.ratios(R.with_prior(df, ["code"]), ["ratio_dupont", "ratio_margins"], ["code", "year"]).where("year = 2020").first()
    assert r["return_on_equity"] == pytest.approx(r["net_margin"] * r["asset_turnover"] * r["equity_multiplier"])
    first = R.ratios(R.with_prior(df, ["code"]), ["ratio_dupont"], ["code", "year"]).where("year = 2019").first()
    assert first["return_on_equity"] is None


def test_prior_year_needs_no_gap(spark):
    from tidemark.operators.series import prior_period

    df = spark.createDataFrame([("a", 2017, 1.0), ("a", 2019, 2.0), ("a", 2020, 3.0)], "code string, year int, x double")
    assert [r["prev_x"] for r in prior_period(df, ["code"], "year", ["x"]).orderBy("year").collect()] == [None, None, 2.0]


def test_padding_keeps_all_steps(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(30)]), (2, [1.0])], "n long, steps array<double>")
    got = {r["n"]: r for r in M.pad_sequences(df, "n", 2).collect()}
    assert got[1]["length"] == 30 and got[1]["steps"] == [float(i) for i in range(30)] and len(got[2]["steps"]) == 30


def test_empty_texts_are_encoded_too(spark):
    got = {r["doc_id"]: r["char_ids"] for r in M.encode_chars(spark.createDataFrame([(1, "ba"), (2, "")], "doc_id long, text string")).collect()}
    assert got == {1: [1, 0], 2: []}


def test_positions_of_sparse_and_negative_keys(spark):
    from tidemark.operators.numbering import with_position, with_shuffled_rank

    keys = [hash((i, "x")) for i in range(500)] + [-(2**63), 2**63 - 1, 0, -1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["position"] for r in with_position(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert sorted(r["rank"] for r in with_shuffled_rank(df, "k", 3).collect()) == list(range(len(keys)))


def test_random_order_is_that_of_the_digests(spark, monkeypatch):
    import hashlib

    df = spark.range(-300, 900).withColumnRenamed("id", "k")
    want = sorted(range(-300, 900), key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    for rows in (1 << 16, 50, 1):
        monkeypatch.setattr(N, "BUCKET_ROWS", rows)
        got = {r["rank"]: r["k"] for r in N.with_shuffled_rank(df, "k", 5).collect()}
        assert [got[i] for i in range(1200)] == want


def test_folds_of_sparse_numbers_and_few_rows(spark):
    numbers = [-(2**63), -7, 0, 1, 10, 11, 5000, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r["n"]: (r["fold"], r["role"]) for r in M.assign_folds(df, "n", 4, 1).collect()}
    assert got == {n: (i // 2, "valid" if i // 2 == 1 else "train") for i, n in enumerate(sorted(numbers)[:8])}
    assert M.assign_folds(df, "n", 10, 1).count() == 0 and M.assign_folds(df.limit(0), "n", 2, 1).count() == 0


def test_texts_do_not_move_for_their_places(spark):
    """Beside the ranges of the keys, only the windows themselves are dealt out."""
    df = spark.createDataFrame([(i, "abcdefghij" * i) for i in range(1, 6)], "doc_id long, text string")
    plan = M.random_windows(df, 7, 4, seed=3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan, "ranges are stored tables"
    assert "SinglePartition" not in plan.split("Window")[0]


def test_many_invalid_rows_merge_in_linear_time(spark):
    import time

    rows = [(1, 0, ["项目", "2015年"])] + [(1, i, ["", "None"]) for i in range(1, 50001)] + [(1, 50001, ["营业收入", "1"])]
    df = spark.createDataFrame(rows, "doc_id long, row_idx long, cells array<string>")
    start = time.time()
    assert [r["cells"] for r in T.merge_headers(df, SPEC).orderBy("row_idx").collect()] == [["项目", "2015年"], ["营业收入", "1"]]
    assert time.time() - start < 60


def test_header_labels_over_several_columns(spark):
    df = table(spark, ["项目", "本期", "金额", "上期金额"], ["a", "1", "None", "5"], ["b", "2", "3", "6"])
    got = cells(T.merge_header_labels(df, ["项目", "本期金额", "上期金额"]))
    assert got == [["项目", "本期金额", "上期金额"], ["a", "1", "5"], ["b", "23", "6"]]
