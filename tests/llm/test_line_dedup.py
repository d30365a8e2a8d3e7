"""Near-duplicate lines against all pairs in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L

SCHEMA = "doc_id long, text string, doc string, gone string, n_chars long"


def near(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    p = next((i for i in range(n) if x[i] != y[i]), n)
    s = next((i for i in range(n) if x[-1 - i] != y[-1 - i]), n)
    return p + s >= max(len(x), len(y)) - 1


def model(docs):
    at = []
    for i, t in docs:
        for pos, line in enumerate(t.split("\n") if t is not None else []):
            words = line.strip(" \t\r\x0b\x0c").split(" ")
            if len(words) >= L.MIN_WORDS:
                at.append((float("inf") if i is None else i, pos, words))
    gone = {(i, p) for i, p, w in at if any((j, q) < (i, p) and near(w, v) for j, q, v in at)}
    out = []
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        keep = [x for p, x in enumerate(lines) if ((float("inf") if i is None else i), p) not in gone]
        out.append((i, len(lines) if t else 0, len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "d", "g", len(t or "")) for i, t in docs], SCHEMA)
    assert sorted((tuple(r) for r in L.report(df).collect()), key=str) == model(docs)
    return df


A = "a b c d e f g h i j"


def test_edges(spark):
    check(spark, [
        (1, A), (2, A), (3, None), (4, ""), (5, "\n\n"), (6, f"  {A}\t\nshort line"), (7, A.replace("e", "x")), (8, A.replace("e", "y")),
        (9, A.replace("e ", "")), (10, "z " + A), (11, A + " z"), (12, A.replace("a", "q").replace("j", "r")), (13, "short line\nshort line"),
        (14, f"{A}\n{A}\nend"), (15, A.replace("b", "b b")), (16, "w" * 100000), (17, " ".join(map(str, range(3000)))),
        (18, " ".join(map(str, range(1, 3000)))), (19, "a  b  c  d  e"), (20, " ".join("abcdefgh")), (21, " ".join("abcdefg")), (None, A + " n"), (0, "u v w x y z 1 2"),
        (-5, "u v w x y z 1 3"),
    ])


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choices("ab", k=r.randint(7, 11)))
    check(spark, [(i, "\n".join(line() for _ in range(r.randint(0, 4)))) for i in range(60)])


def test_edits_of_one_line(spark):
    r = random.Random(7)
    docs = []
    for i in range(150):
        words = [f"w{k}" for k in range(30)]
        for _ in range(r.randint(0, 2)):
            k, what = r.randrange(len(words)), r.randrange(3)
            words[k:k + (what > 0)] = [f"e{r.randrange(3)}"] if what < 2 else []
        docs.append((r.randrange(10**6), " ".join(words)))
    check(spark, list(dict(docs).items()))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "FILTER_BITS", 64)
    test_random(spark, 11)


def test_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, f"{A}\nx\n{A}", "d", "g", 0), (1, f"{A}\nx\n{A}", "d", "g", 0), (2, f"{A}\ny", None, None, None)], SCHEMA)
    out = L.dedup_lines(df, length_col="n_chars")
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, f"{A}\nx", 21)] * 2 + [(2, "y", 1)]
    empty = df.limit(0)
    assert L.dedup_lines(empty).count() == 0 and L.report(empty).count() == 0


def test_verification():
    assert near(A.split(), A.split()) and not near(A.split(), "b a c d e f g h i j".split())


def test_plan_is_native(spark, sf_dir):
    df = L.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
    assert df.agg(F.sum("n_removed")).first()[0] > 0


def test_places_are_longs_where_ids_allow(spark):
    rows = [(5, "x"), (-3, "y"), (None, "z")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    pick = lambda rows: spark.range(1).select(L._order(frame(rows), "doc_id")[1].alias("o")).schema["o"].dataType.simpleString()
    assert pick(rows) == "bigint" and pick([]) == "bigint" and pick([(None, "x")]) == "bigint"
    assert pick([(-(1 << 63), "x"), ((1 << 63) - 1, "y")]) == "decimal(34,0)"


@pytest.mark.parametrize("ids", [(-7, -5, 0, None), (-(1 << 63), -5, 0, None), (-5, 7, (1 << 63) - 1, None), ((1 << 63) - 3, (1 << 63) - 2, (1 << 63) - 1, None)])
def test_ids_of_any_size(spark, ids):
    a, b, c, d = ids
    check(spark, [(a, A), (b, A.replace("e", "x")), (c, f"\x0b{A} z\r"), (d, f"{A}\n{A}\nnew one")])


def test_white_space_of_any_kind_is_cut(spark):
    check(spark, [(1, A)] + [(2 + k, f"{c}{A}") for k, c in enumerate(" \t\r\x0b\x0c")] + [(9 + k, f"{A}{c}") for k, c in enumerate(" \t\r\x0b\x0c")] + [(20, " " + A), (21, " ")])
