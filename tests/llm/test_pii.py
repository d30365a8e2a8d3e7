"""Personal data against a row-at-a-time model written from the contract."""

import hashlib
import random
import re

import pytest

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def model(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, entities string")
    return {r["doc_id"]: r for r in pii.report(df).collect()}


def check(spark, texts):
    got = run(spark, texts)
    for i, t in enumerate(texts):
        want = model(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t, text, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN]
        base = [s for s in got[i]["spans"].split(",") if s and s.split(":")[0] in PLAIN]
        assert ",".join(base) == text


def test_edges(spark):
    check(spark, [
        None, "", "a@b", "a@b.c", "a@b@c.de", "a@b.co_x@d.ef", "a@b.c.d@e.f", "@@", "x" * 30000, "1" * 30000, "1 " * 20000,
        "1.2.3.4", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "001.2.3.255", "256.1.1.1", "1.2.3.99999999999999999999", "999.1.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "4111111111111111 4111111111111111", "+1 (437) 555-0689 x",
        "+1 (437) 555-0689 +1 (437) 555-0680", "++1234567890", "+12", "é𝒳 a@b.co 𝒳 1.2.3.4 é", "a.b@c-d.e-f, g@h.i",
        "\n\t+49 30 123456-78\n", "0000 0000 0000 0000", "+1.2.3.4.5.6.7.8.9.10", "x" * 50 + "@" + "y" * 30000,
    ])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    check(spark, ["".join(r.choices("a1 23.@+-()é_4\n", k=r.randint(1, 120))) for _ in range(400)])


def test_added_kinds(spark):
    got = run(spark, [
        "IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88370400440532013000", "ssn 123-45-6789", "part 123-45-6789",
        'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"', "commit ffc3105535f423f352535e4ac53b5fefe076ac6d",
    ])
    kinds = {i: [s.split(":")[0] for s in r["spans"].split(",") if s and s.split(":")[0] not in PLAIN] for i, r in got.items()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["secret"], 5: []}


def test_context_moves_the_score(spark):
    got = run(spark, ["call phone +1 (437) 555-0689", "zzz +1 (437) 555-0689"])
    assert float(got[0]["scores"]) > float(got[1]["scores"])


def test_empty_table_nulls_and_repeats(spark):
    schema = "doc_id long, text string, spans int"
    assert pii.report(spark.createDataFrame([], schema)).count() == 0
    rows = pii.report(spark.createDataFrame([(None, "a@b.co", 1), (1, None, None), (1, None, None)], schema)).collect()
    assert sorted((r["doc_id"] or -1, r["n_email"]) for r in rows) == [(-1, 1), (1, 0), (1, 0)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.report(docs).collect():
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in model(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_secrets_of_any_length(spark):
    key = "aB3dE5fG7h" * 64
    docs = spark.createDataFrame([(n, f"api_key = {key[:n]}") for n in (31, 32, 40, 256, 257, 320, 640)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert {n for n, spans in got.items() if f"secret:10:{10 + n}" in spans} == {32, 40, 256, 257, 320, 640}
