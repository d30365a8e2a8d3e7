"""Benchmark windows against a plain search over word lists."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontam as D

DOCS = "doc_id long, text string, row string, id string, hits string"
ITEMS = "item_id long, text string, row string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def model(text, items, window=10):
    w, hit, found, longest = words(text), set(), set(), 0
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(v) - n + 1):
                if w[a:a + n] == v[b:b + n]:
                    hit.update(range(a, a + n))
                    if i is not None:
                        found.add(str(i))
                    k = n
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    longest = max(longest, k)
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), longest


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "r", "i", "h") for i, t in enumerate(texts)], DOCS)
    return docs, spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)


def check(spark, texts, items):
    docs, bench = frames(spark, texts, items)
    rows = D.report(docs, bench).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == model(texts[r["doc_id"]], items), texts[r["doc_id"]]
    kept = {r["doc_id"] for r in D.decontaminate(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["contaminated"]}


ALPHA = "a b c d e f g h i j k l m n o p"


def test_edges(spark):
    items = [(1, ALPHA), (2, "short one"), (3, None), (4, ""), (5, "..."), (1, ALPHA), (None, "no id at all"), (10, "c d e f g h i j k l"), (20, "é ß Ñ x")]
    check(spark, [
        None, "", " ", ALPHA, ALPHA.upper(), "x " + ALPHA.replace(" ", ", ") + " y", "a b c d e f g h i", "short-one", "one short", "shortone",
        "short one short one one", "z " * 20000 + ALPHA, "no id at all", "é ß Ñ x", "É ß ñ x", "b c d e f g h i j k l " * 50, "w" * 100000,
        "a b c d e f g h i j x c d e f g h i j k l m n o p a b c d e f g h i j",
    ], items)


def test_no_items_no_documents(spark):
    check(spark, ["a", None], [])
    check(spark, ["a", None], [(1, None)])
    docs, bench = frames(spark, [], [(1, ALPHA)])
    assert D.report(docs, bench).count() == 0 and D.decontaminate(docs, bench).columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    text = lambda lo, hi: " ".join(r.choices("ab", k=r.randint(lo, hi)))
    check(spark, [text(0, 60) for _ in range(60)], [(i % 7, text(0, 16)) for i in range(12)])


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    r = random.Random(9)
    items = [(i, " ".join(r.choices("abc", k=14))) for i in range(30)]
    texts = [" ".join(r.choices("abc", k=200)) for _ in range(40)] + [None, ""]
    docs, bench = frames(spark, texts, items)
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    many = D.find_matches(docs, bench, block_bytes=200)
    for row in many.collect():
        want = model(texts[row["doc_id"]], items)
        assert (row["n_words"], sum(h["stop"] - h["start"] for h in row["hits"])) == want[:2]
        assert len({m["item"] for m in row["matches"]}) == want[2]
    kept = D.decontaminate(docs, bench, block_bytes=200)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not model(t, items)[4]}


def test_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, ALPHA, "", "", ""), (1, ALPHA, "", "", ""), (None, ALPHA, "", "", "")], DOCS)
    bench = spark.createDataFrame([(1, ALPHA, "")], ITEMS)
    assert [r["n_hit"] for r in D.report(docs, bench).collect()] == [16, 16, 16]
