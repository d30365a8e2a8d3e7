"""Quality rules against a model in plain Python: base measures from the contract, score from counted features."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SCHEMA = "doc_id long, text string, score string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    rows = Q.assess(docs, Q.Model(16, None, float("-inf"))).collect()
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == base(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["kept"] == (not r["base_failed"])


def test_edges(spark):
    long = " ".join(f"w{i % 900}" for i in range(20000))
    check(spark, [
        None, "", " ", "\n\n", "a", "a b c d e f g h", "a " * 9, "a " * 40, "x y\nx y\n \nx y", "é𝒳 # * é", long, "z" * 100000,
        "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8 " + " ".join(map(str, range(60))),
        "1 2 3 4 5 6 7 x 1 2 3 4 5 6 7", "a\x0bb\x0cc\rd\te f g h", "a b " * 11,
    ])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    check(spark, [" ".join(r.choice("abc#\n") for _ in range(r.randint(0, 60))) for _ in range(150)])


def test_score_and_threshold(spark):
    good = [f"alpha beta gamma g{i} " * 10 + " ".join(f"t{i}x{k}" for k in range(3)) for i in range(12)]
    poor = [f"zzz### qqq$$$ p{i} " * 10 + " ".join(f"u{i}x{k}" for k in range(3)) for i in range(12)]
    texts = good + poor
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 12), 0) for i in range(24) if i % 2 == 0] + [(None, 1, 0), (0, None, None)][:1], LABELS)
    buckets = 1 << 12
    model = Q.fit(docs, labels, buckets=buckets)
    hashes = Q.with_hashes(docs.select("doc_id", F.col("text").alias("_text"))).select("doc_id", F.concat("_one", "_two").alias("h"))
    found = {r["doc_id"]: [h % buckets for h in r["h"]] for r in hashes.collect()}
    raw, target = Counter(), Counter()
    for i, f in found.items():
        raw.update(f)
        if i < 12 and i % 2 == 0:
            target.update(f)
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + 1) / (m + buckets)) - math.log((raw[b] + 1) / (n + buckets))
    want = {i: sum(map(ratio, f)) / len(f) for i, f in found.items()}
    got = {r["doc_id"]: r for r in Q.assess(docs, model).collect()}
    for i, w in want.items():
        assert got[i]["score"] == pytest.approx(w, abs=1e-5)
    mean = lambda xs: sum(xs) / len(xs)
    up, down = mean([want[i] for i in range(0, 12, 2)]), mean([want[i] for i in range(12, 24, 2)])
    assert model.threshold == pytest.approx(up - (up - down) / 3, abs=1e-5)
    verdict = {i: r["score"] >= model.threshold for i, r in got.items()}
    assert all(verdict[i] for i in range(12)) and not any(verdict[i] for i in range(12, 24))


def test_no_labels_empty_and_nulls(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(None, None, None, None), (1, "a " * 7 + " ".join(map(str, range(40))), "", ""), (1, None, "", "")], SCHEMA)
    rows = Q.report(docs, none).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in rows) == [(-1, False), (1, False), (1, True)]
    assert Q.report(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, 1, None), (1, 1, 0), (2, None, 1)], LABELS)
    assert Q.report(docs, odd).count() == 3


def test_whole_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    rows = Q.report(docs, labels).collect()
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == base(texts[r["doc_id"]])
    fine = [r for r in rows if marks.get(r["doc_id"]) == (1, 0) and not r["base_failed"]]
    poor = [r for r in rows if marks.get(r["doc_id"], (1,))[0] == 0 and not r["base_failed"]]
    assert all(r["kept"] for r in fine)
    assert sum(r["kept"] for r in poor) <= len(poor) * 0.2
