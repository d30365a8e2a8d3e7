"""Ranked search against sums over terms in whole numbers."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import search as S

DOCS = "doc_id long, text string, rank string, score string, id string"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def model(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        if item is None:
            continue
        scored = []
        for i, b, size in bags:
            m = 100 - 25 + (25 * size * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "r", "s", "i") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "d") for i, t in items], ITEMS)
    got = sorted(tuple(r) for r in S.rank(d, b, **options).collect())
    assert got == model(docs, items)
    return got


def words(rng, lo, hi, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 2))) for _ in range(rng.randint(lo, hi)))


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    r = random.Random(seed)
    assert check(spark, [(i, words(r, 0, 60)) for i in range(150)], [(i, words(r, 0, 30)) for i in range(70)])


def test_edges(spark):
    docs = [
        (1, None), (2, ""), (3, " ,;"), (4, "Alpha BETA alpha"), (5, "alpha-beta;gamma"), (None, "alpha alpha"), (6, "é É ß1 x_y"), (7, "w " * 30000 + "rare"),
        (8, "alpha beta"), (8, "alpha beta"), (8, "alpha"), (9, "z" * 100000), (-3, "alpha beta"), (10, "1 2 3 É"),
    ]
    items = [(1, "ALPHA"), (1, "ALPHA"), (1, "beta gamma"), (2, None), (3, ""), (4, "..."), (None, "alpha"), (5, "rare w w w"), (6, "É x 1 y"), (7, "absent"),
             (8, "alpha " * 50), (9, "z" * 100000)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)
    check(spark, [(1, None), (2, "")], items)


def test_many_equal_documents_are_ranked_by_id(spark):
    r = random.Random(4)
    docs = [(i, "one two three") for i in r.sample(range(100000), 3000)] + [(200000 + i, words(r, 5, 9)) for i in range(300)]
    got = check(spark, docs, [(1, "two"), (2, "three three four")])
    assert len({s for item, _, _, s in got if item == 1}) == 1


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    r = random.Random(5)
    docs, items = [(i, words(r, 0, 40)) for i in range(120)], [(i, words(r, 1, 20)) for i in range(40)]
    base = check(spark, docs, items)
    monkeypatch.setattr(S, "TILE_DOCS", 7)
    assert check(spark, docs, items, block_bytes=200) == base
    assert check(spark, docs, items, block_items=3) == base


def test_tiles_stay_exact():
    r = random.Random(6)
    weights = [r.choice([0, 1, 20000, 30000]) for _ in range(60)]
    bags = [{t: r.choice([1, 3, 900000]) for t in r.sample(range(60), r.randint(0, 40))} for _ in range(9)]
    tiles = S.tiles_of(bags, weights, tile_terms=8, tile_items=4)
    seen = Counter()
    for tile in tiles:
        assert (tile.matrix.sum(axis=0) * S.IMPACT < S.EXACT).all() and tile.matrix.shape[0] <= 8
        for (i, j), value in {(i, j): tile.matrix[i, j] for i in range(tile.matrix.shape[0]) for j in range(tile.matrix.shape[1])}.items():
            if value:
                seen[int(tile.items[j]), int(tile.terms[i])] += int(value)
    assert seen == Counter({(k, t): c * weights[t] for k, bag in enumerate(bags) for t, c in bag.items() if weights[t]})
