"""Exact substring dedup against a dictionary of all windows."""

import hashlib
import random

import pytest

from tidemark.llm import substrings as S

SCHEMA = "doc_id long, text string, doc string, mark string, hash string"


def model(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p:p + 50]
                if w not in least or i < least[w]:
                    least[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p:p + 50]] < i:
                    gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "d", "m", "h") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in S.report(df).collect()), key=str) == model(rows)


def noise(r, n):
    return "".join(r.choices("abcdefghijklmnop éß\n", k=n))


def corpus(seed):
    r = random.Random(seed)
    shared = [noise(r, k) for k in (49, 50, 51, 80, 300)]
    rows = [(i, noise(r, r.randint(0, 200)) + r.choice(shared) + noise(r, r.randint(0, 60)) + r.choice(shared)[r.randint(0, 9):]) for i in range(60)]
    return rows + [(100 + i, rows[3][1]) for i in range(5)]


def test_edges(spark):
    r = random.Random(1)
    a = noise(r, 400)
    check(spark, [
        (1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 500), (6, "x" * 51), (7, a), (8, a), (9, a[:60] + a[200:260]), (10, "é" * 40), (11, "é" * 40),
        (12, "ab" * 300), (13, "ba" * 300), (-1, a[100:150]), (None, a), (14, a[:50] * 3), (15, " " + a[1:50]), (7, a), (7, noise(r, 100)), (16, "z" * 100000),
    ])


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    check(spark, corpus(seed))


def test_hot_hashes_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    check(spark, corpus(5))


def test_full_filters_slices_and_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "FILTER_BITS", 64)
    monkeypatch.setattr(S, "SLICE", 100)
    monkeypatch.setattr(S, "GROUP_BYTES", 2000)
    check(spark, corpus(6))


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in S.report(docs).collect()), key=str) == model(rows)


def test_what_is_sent_is_short(spark):
    """A stretch travels with the short hash of its gram, and without a hash of its text where ids stand once."""
    df = spark.createDataFrame([(1, "a" * 60), (2, None), (3, "b" * 60), (3, "c" * 60), (None, "d")], "doc_id long, text string")
    marks = S.marked(df).collect()
    assert all((r["mark"] != 0) == (r["doc"] == 3) for r in marks) and len({r["mark"] for r in marks if r["doc"] == 3}) == 2
    assert S._STRETCH.startswith("hash int,")


def test_equal_stretches_go_whole(spark, monkeypatch):
    """Windows are taken apart only where different texts meet: copies cost no more than their first."""
    import pyarrow as pa

    taken = []
    windows = S._windows
    monkeypatch.setattr(S, "_windows", lambda contents: taken.append(len(contents)) or windows(contents))
    text = noise(random.Random(3), 60).encode()
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 40, pa.int32()), pa.array(range(40), pa.int64()), pa.array([0] * 40, pa.int64()), pa.array([5] * 40, pa.int64()), pa.array([text] * 40, pa.binary())],
        ["hash", "doc", "mark", "at", "content"],
    )
    rows = [tuple(r.values()) for part in S._settle(iter([batch])) for r in part.to_pylist()]
    assert sorted(rows) == [(d, 0, 5, 5 + len(text)) for d in range(1, 40)] and not taken


def test_shuffles_of_a_pass_go_before_the_next(spark, monkeypatch):
    """Which of the driver's shuffles are known after each release: none of the pass that ended, however its results were handed over."""
    known, release = [], S._release
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    release(spark.range(1))
    before = tracker.size()
    monkeypatch.setattr(S, "_release", lambda rows: (release(rows), known.append(tracker.size())))
    check(spark, corpus(7))
    assert len(known) == 2 and max(known) <= before
