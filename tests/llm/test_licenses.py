"""License scans: the base phrases and the rules against row-at-a-time Python."""

import random
import re

from tidemark.llm import licenses as L

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
SCHEMA = "doc_id long, text string, label string"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def model(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hits = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def detect(text):
    low = (text or "").lower()
    if not any(g in low for g in L.GATES):
        return []
    found = sorted(
        (m.start(), -m.end(), -r.priority, i, r.label)
        for i, r in enumerate(L.rules()) if r.keyword in low for m in re.finditer(r.pattern, low)
    )
    out, end, top = [], -1, -1
    for start, back, weak, _, label in found:
        if -back > end:
            end, top = -back, -weak
            out.append(label)
        elif -weak > top:
            out.append(label)
    return out


def run(spark, texts):
    rows = L.report(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    return {r["doc_id"]: r for r in rows}


def check(spark, texts):
    got = run(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == model(t), t
        assert r["labels"] == ",".join(sorted(set(detect(t)) | set(filter(None, model(t)[4].split(","))))), t
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_edges(spark):
    check(spark, [
        None, "", " ", "license", "MIT License", "mit-license mit license MIT\tLICENSE", "the general public  license, license",
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "SPDX-License-Identifier: LGPL-2.1", "lİcense mİt license",
        "mit license " * 5000, "a" * 100000, "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "see LICENSE for details", "(c) 2020 X. All rights reserved", "é" * 1000 + " apache license", "commit licensees general public",
    ])


def test_labels_of_known_lines(spark):
    got = run(spark, [
        "Licensed under the Apache License, Version 2.0.", "licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "https://www.gnu.org/licenses/gpl-2.0.html", "plain words",
    ])
    assert [got[i]["labels"] for i in range(5)] == ["apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "gpl-2.0", ""]


def test_keywords_stand_in_every_match():
    """The keyword of a rule loses none of its matches."""
    samples = [
        "spdx-license-identifier: {}", "licensed under the {}", "released under the terms of {} license", "{} license", "{} licence", "{}",
    ]
    names = ["mit", "apache license, version 2.0", "gnu general public license version 3", "gpl-2.0", "lgpl v2.1", "agplv3", "bsd-3-clause", "isc",
             "mpl 2.0", "mozilla public license 1.1", "epl-2.0", "cddl-1.0", "wtfpl", "cc0 1.0", "cc by-sa 4.0", "creative commons attribution 3.0",
             "zlib", "unlicense", "psf", "open font license", "eupl-1.2", "cc-by-nc-nd-2.5", "expat", "lesser general public license 3"]
    for text in (s.format(n) for s in samples for n in names):
        for r in L.rules():
            if re.search(r.pattern, text):
                m = re.search(r.pattern, text)[0]
                assert r.keyword in m, (r, m)


def test_hundreds_of_rules():
    assert len(L.rules()) > 200 and len({r.label for r in L.rules()}) > 70


def test_random(spark):
    r = random.Random(5)
    parts = ["mit", "License", "apache", "general", "public", "GPL", "version", "2.0", "under", "licensed", "the", ",", "\n", "é", "cc", "by", "4.0"]
    check(spark, [" ".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(150)])


def test_empty_table_nulls_and_repeats(spark):
    assert L.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = L.report(spark.createDataFrame([(None, "mit license", None), (1, None, None), (1, None, None)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["n_base"]) for r in rows) == [(-1, 1), (1, 0), (1, 0)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in L.report(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == model(texts[r["doc_id"]])
        assert r["labels"] == ",".join(sorted(set(detect(texts[r["doc_id"]])) | set(filter(None, model(texts[r["doc_id"]])[4].split(",")))))
