"""Near duplicates against all pairs of full sets; the sketch against the properties it is used for."""

import random

import numpy as np
import pytest

from tidemark.llm import minhash as M
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, key string, component_id string, id string"


def model(rows):
    sets = [M.shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    label = [None if d is None else least[top(i)] for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), c, d is None or d == c) for (d, _), s, c in zip(rows, sets, label)), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "k", "c", "i") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in M.report(df).collect()), key=str) == model(rows)
    return df


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def test_edges(spark):
    base = [f"w{i}" for i in range(60)]
    check(spark, [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A  B\tC"), (6, "a b"), (7, "a b c d e"), (8, " ".join(base)), (9, " ".join(base).upper()),
        (10, " ".join(base[:-1])), (11, " ".join(base + ["x"])), (12, " ".join(f"v{i}" for i in range(30000))), (13, "é " + " ".join(base)),
        (14, "a b c d e a b c d e a b c d e"), (15, "z" * 100000), (None, " ".join(base)), (-3, "a b"),
    ])


def test_hot_group_of_near_copies(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(146)]
    rows = [(i, edited(r, base, r.randint(0, 8))) for i in range(120)] + [(200 + i, " ".join(base)) for i in range(40)]
    rows += [(300 + i, edited(r, [f"u{k}" for k in range(90)], 1)) for i in range(10)]
    check(spark, rows)


def test_chains_and_repeats(spark):
    words = [f"c{i}" for i in range(100)]
    rows = [(50 - k, " ".join(words[2 * k:2 * k + 70])) for k in range(12)]
    check(spark, rows + rows[:2] + [(50, "quite another text of more than five words")])


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.report(df).count() == 0
    rows = [(1, "one two three four five six", "k", "c", "i"), (2, "one two three four five six", "k", None, "i"), (None, "x", None, None, None), (3, None, "", "", "")]
    kept = M.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    least = lambda s: M.minima(s, np.array([0]))
    a, b = pool[:1500], pool[700:2200]
    assert (M.registers(np.minimum(least(a), least(b))) == np.maximum(M.registers(least(a)), M.registers(least(b)))).all()
    assert (M.registers(np.minimum(least(a), least(b))) == M.registers(least(np.union1d(a, b)))).all()
    errors = []
    for k in range(60):
        pool = r.integers(0, 2**63, 1500).astype(np.uint64)
        a, b = pool[:1000], pool[100:1100]
        j = M.estimate(M.registers(least(a)), M.registers(least(b)), np.array([1000]), np.array([1000]))[0]
        errors.append(j - 900 / 1100)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5200)]
    group = {}
    top = lambda i: i if group.setdefault(i, i) == i else top(group[i])
    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: top(i) for i in group}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in M.report(docs).collect()), key=str) == model(rows)


def test_pairs_of_a_template_that_meet_in_hot_buckets_only(spark):
    # 450 shared shingles, 10 of the pair, 38 of their own: 460 / 536 = 0.858 within a pair, 450 / 546 = 0.824 between pairs
    template = " ".join(f"t{i}" for i in range(454))
    own = lambda name, n: " ".join(f"{name}_{i}" for i in range(n))
    rows = [(2 * k + side, f"{template} {own(f'p{k}', 10)} {own(f'o{k}_{side}', 38)}") for k in range(200) for side in (0, 1)]
    df = spark.createDataFrame([(i, t, "k", "c", "i") for i, t in rows], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in M.report(df).collect()} == {i: i - i % 2 for i, _ in rows}
