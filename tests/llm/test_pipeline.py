"""The pipeline: every stage against the brute-force models of the operators, on planted and on odd rows."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests_llm_models import decontam_model, line_model, near_model
from tidemark.llm import bpe, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VOCABULARY = [f"{a}{b}{c}" for a in ("ra", "ti", "no", "the") for b in ("ne", "lo", "mi") for c in ("sa", "ur", "el", "in", "o")]


def prose(r, lines=4):
    return "\n".join(" ".join(r.choices(VOCABULARY, k=r.randint(12, 25))) for _ in range(lines))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    docs = [(i, prose(r)) for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[4][1].replace(VOCABULARY[0], "edit", 1)), (52, docs[5][1] + " tail")]
    docs += [(60, "### $$$ " * 40), (61, None), (62, ""), (63, "short"), (64, prose(r, 2) + "\n" + docs[7][1].split("\n")[1] + "\n" + prose(r, 1))]
    bench = [(1, " ".join(r.choices(VOCABULARY, k=14))), (2, None)]
    docs += [(70, prose(r) + "\n" + "see " + bench[0][1] + " there\n" + prose(r))]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(60, 0, 0), (63, 0, None), (None, 1, 0)]
    return docs, bench, labels


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    docs, bench, labels = corpus
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_models(spark, folder, corpus):
    _, bench, _ = corpus
    docs = P._table(spark, folder, "documents")
    kept = P.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns
    model = quality.fit(docs, P._table(spark, folder, "labels"))
    verdict = {r["doc_id"] for r in quality.assess(docs, model).collect() if r["kept"]}
    now = rows_of(kept)
    assert set(now) == verdict and set(range(40)) <= verdict and not verdict & {60, 61, 62, 63}

    lines = P.line_dedup_stage(spark, kept, folder)
    assert lines.columns == docs.columns
    want = line_model(now)
    assert rows_of(lines) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = P.near_dedup(spark, lines, folder)
    assert near.columns == docs.columns
    want = near_model(want)
    assert rows_of(near) == want

    clean = P.decontamination(spark, near, folder)
    assert clean.columns == docs.columns
    want = {i: t for i, t in want.items() if not decontam_model(t, bench)}
    assert rows_of(clean) == want and 70 not in want

    library = Tokenizer.from_file(bpe.tokenizer_path())
    for r in P.tokenise(spark, clean, folder).collect():
        ids = library.encode(want[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    ran = {r["doc_id"] for r in P.run(spark, folder).collect()}
    assert ran == set(want)


def test_empty_table(spark, folder):
    docs = P._table(spark, folder, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_extra_and_clashing_columns(spark, folder):
    docs = P._table(spark, folder, "documents")
    for c in ("key", "doc", "gone", "row", "id", "component_id", "kept", "_text", "rep"):
        docs = docs.withColumn(c, docs["lang"])
    for _, stage in P.STAGES[:-1]:
        docs2 = stage(spark, docs, folder)
        assert docs2.columns == docs.columns and docs2.count() > 0


def test_near_copies_of_eighty_percent_go(spark, folder):
    words = [f"w{i}" for i in range(400)]
    eight = [f"x{i}" if i in range(20, 340, 40) else w for i, w in enumerate(words)]  # 356 / 436 = 0.817
    eleven = [f"y{i}" if i in range(30, 360, 30) else f"v{i}" for i in range(400)]
    plain = [f"v{i}" for i in range(400)]  # 341 / 451 = 0.756
    rows = [(k, " ".join(w), "en", None, 0) for k, w in enumerate((words, eight, plain, eleven))]
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()) == [0, 2, 3]
