"""Hard negatives against all products in whole numbers."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, vector string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def model(rows):
    """Result rows of the query, from (vec_id, vector, label)."""
    whole = []
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            whole.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in whole:
        if i % 100:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), N.LEAST), N.MOST), j, other) for j, w, other in whole]
        scored.sort(key=lambda s: s[:2])
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits[:10])]
    return sorted(out)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in N.report(df).collect())
    assert got == model(rows)
    return got


def vectors(rng, n, width, spread=1.0, centres=4):
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    out = []
    for i in range(n):
        c = rng.choice(middle)
        out.append((i, [x + rng.gauss(0, spread) for x in c], rng.randrange(10)))
    return out


@pytest.mark.parametrize("width, spread", [(1, 1.0), (3, 0.3), (16, 1.0)])
def test_random(spark, width, spread):
    assert check(spark, vectors(random.Random(width), 600, width, spread))


def test_ties_repeats_and_hot_vectors(spark):
    rng = random.Random(2)
    rows = vectors(rng, 150, 4)
    hot = [(200 + i, [0.5, 0.25, 0.0, -0.5], i % 3) for i in range(300)]
    again = [rows[100], rows[100], rows[7], hot[0], hot[0]]
    assert check(spark, rows + hot + again + [(100, [0.5, 0.25, 0.0, -0.5], 4)])


def test_rows_that_take_no_part_and_odd_vectors(spark):
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0, 1.0], 1), (701, None, 1), (702, [1.0, None], 1), (703, [nan, 1.0], 1), (704, [inf, 1.0], 2), (800, [1.0, 1.0], None),
        (900, [], 1), (901, [], 2), (902, [0.0, 0.0], 1), (1000, [0.0, 0.0, 0.0], 1), (903, [1.0], 1), (904, [1.0, 1.0, 1.0, 1.0, 1.0], 3),
        (1100, [2.0, 1.0, 0.5], 3), (905, [-1.0, -1.0], 3), (1200, [-1.0, -1.0], 3),
    ]
    check(spark, odd + vectors(rng, 60, 3, centres=2))
    check(spark, odd[:6])
    check(spark, [])


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    big = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([0, 18, 24, 60]) for _ in range(3)], rng.randrange(3)) for i in range(120)]
    check(spark, big)


def test_blocks_and_pilots_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = vectors(rng, 500, 6)
    base = check(spark, rows)
    monkeypatch.setattr(N, "BUCKET_ROWS", 16)
    monkeypatch.setattr(N, "BLOCK_VALUES", 12)
    assert check(spark, rows) == base


def test_pruning_leaves_out_rows_that_cannot_count():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(1000, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    vectors = np.floor(np.concatenate([unit[:500] * 100, unit[500:] * 4000]))
    bucket = N.Bucket(np.arange(500), np.zeros(500, np.int64), vectors[500:])
    queries = N.Queries([9999], [1], [vectors[500]], [int(0.95 * (vectors[500] @ vectors[500]))], [N.MOST], False, 1000)
    near, far = bucket.angles(queries, queries.low)
    rows = bucket.candidates(queries, 0, near[0], far[0])
    inside = np.nonzero(bucket.vectors @ vectors[500] >= queries.low[0])[0]
    assert set(inside) <= set(rows) and len(rows) < 100
    short = N.Bucket(np.arange(500), np.zeros(500, np.int64), vectors[:500])
    near, far = short.angles(queries, queries.low)
    assert near[0] > far[0], "no short vector reaches the bound"
