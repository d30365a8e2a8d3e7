"""License scans: ordered signature rules, gated by keywords, with priority and containment settling overlaps.

A rule is a label, a keyword that every match of it holds, a regular expression, a priority and a confidence.  A text is first
asked for the few ``GATES``; only where one stands are the rules whose keyword stands there too applied.  A detection that lies
inside another of the same or a higher priority is suppressed.  All of it is a projection of one row; nothing is shuffled.

Defined results: a null or empty text has no words, no labels and score 0; rows that stand twice are answered twice; a null id stays
null; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import located

#: What separates words once A-Z is lower case: every ASCII character but digits and letters.
SEPARATOR = r"[\x00-/:-@\[-`{-\x7F]+"
BASE_PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
BASE_SCORE = 0.75


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


#: Families: identifier, pattern of the name, keyword of the name, pattern of the address (or none). Versions are in the names.
FAMILIES = (
    ("mit", r"(?:the )?(?:mit|expat)", "", r"opensource\.org/licenses?/mit\b"),
    ("mit-0", r"mit no attribution", "attribution", None),
    ("apache-2.0", r"apache(?: software)?(?: licen[sc]e)?,? (?:version |v\.? ?)?2(?:\.0)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"apache(?: software)?(?: licen[sc]e)?,? (?:version |v\.? ?)?1\.1", "apache", r"apache\.org/licenses/license-1\.1"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[sc]e|gpl),?\s?(?:version |v\.? ?|-)?3(?:\.0)?", "3", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[sc]e|gpl),?\s?(?:version |v\.? ?|-)?2(?:\.0)?", "2", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),?\s?(?:version |v\.? ?|-)?3(?:\.0)?", "l", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),?\s?(?:version |v\.? ?|-)?2\.1", "2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public licen[sc]e|lgpl),?\s?(?:version |v\.? ?|-)?2(?:\.0)?(?![.\d])", "l", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl),?\s?(?:version |v\.? ?|-)?3(?:\.0)?", "a", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", r"(?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)?1\.3", "documentation", r"gnu\.org/licenses/fdl-1\.3"),
    ("gfdl-1.2", r"(?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)?1\.2", "documentation", None),
    ("bsd-2-clause", r"(?:simplified|2-clause|two-clause) bsd|bsd[ -]2-clause", "bsd", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause) bsd|bsd[ -]3-clause", "bsd", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"(?:original|4-clause|four-clause) bsd|bsd[ -]4-clause", "bsd", None),
    ("0bsd", r"(?:zero-clause bsd|0bsd|bsd zero clause)", "bsd", r"opensource\.org/licenses?/0bsd"),
    ("isc", r"isc", "isc", r"opensource\.org/licenses?/isc"),
    ("mpl-2.0", r"(?:mozilla public licen[sc]e|mpl),?\s?(?:version |v\.? ?|-)?2\.0", "2.0", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", r"(?:mozilla public licen[sc]e|mpl),?\s?(?:version |v\.? ?|-)?1\.1", "1.1", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("epl-2.0", r"(?:eclipse public licen[sc]e|epl),?\s?(?:version |v\.? ?|-)?2\.0", "2.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("epl-1.0", r"(?:eclipse public licen[sc]e|epl),?\s?(?:version |v\.? ?|-)?1\.0", "1.0", r"eclipse\.org/legal/epl-v10"),
    ("cddl-1.0", r"(?:common development and distribution licen[sc]e|cddl)(?:,?\s?(?:version |v\.? ?|-)?1\.0)?", "", r"opensource\.org/licenses?/cddl"),
    ("eupl-1.2", r"(?:european union public licen[sc]e|eupl),?\s?(?:version |v\.? ?|-)?1\.2", "1.2", r"joinup\.ec\.europa\.eu/.{0,60}eupl"),
    ("artistic-2.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?2\.0", "artistic", r"opensource\.org/licenses?/artistic-2\.0"),
    ("artistic-1.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?1\.0", "artistic", None),
    ("bsl-1.0", r"boost software licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "boost", r"boost\.org/license_1_0"),
    ("busl-1.1", r"business source licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?", "business", r"mariadb\.com/bsl11"),
    ("zlib", r"zlib(?:/libpng)?", "zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", r"libpng", "libpng", r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", r"unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[sc]e)", "", r"wtfpl\.net"),
    ("psf-2.0", r"(?:python software foundation|psf)(?: licen[sc]e)?(?:,? (?:version |v\.? ?)?2)?", "p", r"docs\.python\.org/3?/?license"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql\.org/about/licence"),
    ("openssl", r"openssl", "openssl", r"openssl\.org/source/license"),
    ("php-3.01", r"php licen[sc]e,? (?:version |v\.? ?)?3\.01", "php", r"php\.net/license/3_01"),
    ("ruby", r"ruby", "ruby", r"ruby-lang\.org/.{0,20}license"),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?", "font", r"scripts\.sil\.org/ofl"),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft", r"opensource\.org/licenses?/ms-rl"),
    ("ncsa", r"university of illinois/ncsa(?: open source)?", "ncsa", r"opensource\.org/licenses?/ncsa"),
    ("afl-3.0", r"academic free licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?", "academic", r"opensource\.org/licenses?/afl-3\.0"),
    ("osl-3.0", r"open software licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?", "software", r"opensource\.org/licenses?/osl-3\.0"),
    ("cpl-1.0", r"common public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "common", r"opensource\.org/licenses?/cpl1\.0"),
    ("ecl-2.0", r"educational community licen[sc]e(?:,? (?:version |v\.? ?)?2\.0)?", "educational", r"opensource\.org/licenses?/ecl-2\.0"),
    ("upl-1.0", r"universal permissive licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "universal", r"oss\.oracle\.com/licenses/upl"),
    ("blueoak-1.0.0", r"blue oak model licen[sc]e(?:,? (?:version |v\.? ?)?1\.0(?:\.0)?)?", "blue oak", r"blueoakcouncil\.org/license"),
    ("odbl-1.0", r"open (?:data commons )?(?:open )?database licen[sc]e", "database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e", "attribution", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"public domain dedication (?:and|&) licen[sc]e", "dedication", r"opendatacommons\.org/licenses/pddl"),
    ("sspl-1.0", r"server side public licen[sc]e", "server side", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", r"elastic licen[sc]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?", "elastic", r"elastic\.co/licensing/elastic-license"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?:-[ms]{1,2})?", "rail", None),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?:[ -]?1\.0)?(?: universal)?", "c", r"creativecommons\.org/publicdomain/zero/1\.0"),
)

#: Creative Commons: elements by their short and long form; versions multiply.
CC_ELEMENTS = (
    ("by", "attribution"), ("by-sa", "attribution[- ]share ?alike"), ("by-nd", "attribution[- ]no ?deriv(?:s|atives)"),
    ("by-nc", "attribution[- ]non-?commercial"), ("by-nc-sa", "attribution[- ]non-?commercial[- ]share ?alike"),
    ("by-nc-nd", "attribution[- ]non-?commercial[- ]no ?deriv(?:s|atives)"),
)
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

#: Sentences of the texts themselves and of their usual headers.
TEXTS = (
    ("mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy", 85, 0.95),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software", 60, 0.7),
    ("x11", "x consortium", r"name of the x consortium shall not be used in advertising", 90, 0.95),
    ("isc", "with or without fee", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted", 85, 0.95),
    ("bsd", "redistribution", r"redistributions? (?:and use )?in source and binary forms?,? with or without modification,? (?:are|is) permitted", 70, 0.85),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products derived", 80, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 88, 0.95),
    ("apache-2.0", "apache", r"licensed under the apache license,? version 2\.0 \(the [\"']license[\"']\)", 90, 1.0),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license.{0,80}apache\.org", 88, 0.95),
    ("gpl-2.0-or-later", "later version", r"general public license.{0,90}either version 2 of the license,? or \(at your option\) any later version", 92, 1.0),
    ("gpl-3.0-or-later", "later version", r"general public license.{0,90}either version 3 of the license,? or \(at your option\) any later version", 92, 1.0),
    ("lgpl-2.1-or-later", "later version", r"lesser general public license.{0,90}either version 2\.1 of the license,? or \(at your option\) any later version", 95, 1.0),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation", 55, 0.9),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license", 58, 0.9),
    ("agpl", "affero", r"under the terms of the gnu affero general public license", 58, 0.9),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license,? v\.? ?2\.0", 92, 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1", 92, 1.0),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0", 92, 1.0),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?\.? ?2\.0", 92, 1.0),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 80, 0.9),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 78, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 92, 1.0),
    ("bsl-1.0", "boost", r"distributed under the boost software license,? version 1\.0", 92, 1.0),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license", 92, 1.0),
    ("psf-2.0", "python software foundation", r"psf is making python available to licensee on an [\"']as is[\"'] basis", 92, 1.0),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights", 90, 0.95),
    ("public-domain", "public domain", r"(?:is|are|been|placed|released|dedicated) (?:in|into|to) the public domain", 60, 0.8),
    ("proprietary", "all rights reserved", r"(?:copyright|\(c\)|©)[^\n]{0,80}all rights reserved", 40, 0.6),
    ("proprietary", "confidential", r"proprietary and confidential[^\n]{0,60}(?:licen|copyright)|(?:licen|copyright)[^\n]{0,60}proprietary and confidential", 45, 0.7),
    ("cc-by", "creative commons", r"creative commons attribution licen[sc]e", 45, 0.8),
    ("cc", "creative commons", r"creative commons licen[sc]e", 40, 0.6),
    ("gpl", "gpl", r"(?<![a-z])(?:gnu )?gpl(?![a-z])(?=[^\n]{0,40}licen)", 30, 0.6),
    ("lgpl", "lgpl", r"(?<![a-z])lgpl(?![a-z])", 32, 0.6),
    ("agpl", "agpl", r"(?<![a-z])agpl(?![a-z])", 32, 0.6),
    ("bsd", "bsd", r"(?<![a-z])bsd[- ]style licen[sc]e|(?<![a-z])bsd licen[sc]e", 35, 0.8),
    ("unknown-license", "licen", r"see (?:the )?licen[sc]e(?:\.txt|\.md)? (?:file )?for (?:more )?(?:details|information|terms)", 20, 0.4),
)

GATES = ("licen", "copyright", "spdx", "gpl", "public domain", "creative commons", "creativecommons", "cc0", "cc by", "cc-by", "permission",
         "redistribution", "as-is", "altered source", "advertising", "endorse", "(c)", "©", "unlicense", "wtfpl", "mozilla.org", "gnu.org",
         "boost.org", "sil.org", "eclipse.org", "bsl11", "substantial portions", "psf is")


def rules() -> list[Rule]:
    """All rules, strongest first: written texts, then the forms in which a family or a Creative Commons version is named."""
    out = [Rule(label, key, pattern, priority, score) for label, key, pattern, priority, score in TEXTS]
    families = list(FAMILIES)
    for (short, long), version in ((e, v) for e in CC_ELEMENTS for v in CC_VERSIONS):
        tail = rf"(?:[ -]|,? (?:version )?|licen[sc]e )*{re.escape(version)}"
        name = rf"(?:cc[ -]{short.replace('-', '[ -]')}|creative commons {long}){tail}"
        families.append((f"cc-{short}-{version}", name, version, rf"creativecommons\.org/licenses/{short}/{re.escape(version)}"))
    grant = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered)(?: (?:to you|for use))? (?:under|by)(?: the)?(?: terms of(?: the)?)? "
    for label, name, key, address in families:
        word = rf"(?<![a-z0-9])(?:{name})(?![a-z0-9]|\.\d)"
        out.append(Rule(label, "spdx", rf"spdx-license-identifier:\s*\(?{re.escape(label)}(?![a-z0-9.])", 100, 1.0))
        out.append(Rule(label, key, rf"{grant}{word}(?: licen[sc]e)?", 75, 0.95))
        if label.startswith(("cc-", "cc0")) or "licen" in name:
            out.append(Rule(label, key, word, 50, 0.85))
        else:
            out.append(Rule(label, "licen", rf"{word} (?:public |software )?licen[sc]e", 50, 0.85))
        if address:
            out.append(Rule(label, "/" if "/" in address else ".", address, 80, 0.9))
    return sorted(out, key=lambda r: -r.priority)


def _rule_table() -> Column:
    fields = lambda i, r: F.struct(
        F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"),
        F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"), F.lit(i).alias("rank"),
    )
    return F.array(*[fields(i, r) for i, r in enumerate(rules())])


_HIT = "array<struct<start:int,stop:int,priority:int,rank:int,label:string,score:double>>"


def detections(lowered: Column) -> Column:
    """Detections by start that no other of the same or a higher priority contains."""

    def matches(r: Column) -> Column:
        return F.transform(located(lowered, r["pattern"]), lambda s: F.struct(
            s["start"].alias("start"), (-s["stop"]).alias("back"), (-r["priority"]).alias("weak"), r["rank"].alias("rank"),
            r["label"].alias("label"), r["score"].alias("score"),
        ))

    def settle(acc: Column, x: Column) -> Column:
        stop, priority = -x["back"], -x["weak"]
        wider = stop > acc["stop"]
        kept = wider | (priority > acc["priority"])
        one = F.array(F.struct(
            x["start"].alias("start"), stop.alias("stop"), priority.alias("priority"), x["rank"].alias("rank"),
            x["label"].alias("label"), x["score"].alias("score"),
        ))
        return F.struct(
            F.greatest(stop, acc["stop"]).alias("stop"), F.when(wider, priority).otherwise(acc["priority"]).alias("priority"),
            F.when(kept, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    asked = F.filter(_rule_table(), lambda r: F.contains(lowered, r["keyword"]))
    found = F.array_sort(F.flatten(F.transform(asked, matches)))
    nothing = F.struct(F.lit(-1).alias("stop"), F.lit(-1).alias("priority"), F.array().cast(_HIT).alias("out"))
    return F.aggregate(found, nothing, settle, lambda acc: acc["out"])


def _phrase_starts(words: Column, phrase: tuple[str, ...]) -> Column:
    def here(i: Column) -> Column:
        test = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            test = test & (F.get(words, i + k) == word)
        return test

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _places(words: Column, phrase: tuple[str, ...], label: str) -> Column:
    return F.transform(_phrase_starts(words, phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_words``, ``base`` (label, start word) and ``detections`` (spans with label, priority, score)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    text, words = F.col("_text"), F.col("_words")
    gated = F.contains(text, F.lit(GATES[0]))
    for gate in GATES[1:]:
        gated = gated | F.contains(text, F.lit(gate))
    rows = rows.withColumn("_words", F.filter(F.split(text, SEPARATOR), lambda w: w != ""))
    starts = F.concat(*[_places(words, phrase, label) for label, phrase in BASE_PHRASES])
    return rows.select(
        F.col("_id").alias(id_col),
        F.size("_words").cast("long").alias("n_words"),
        F.when(F.contains(text, F.lit("license")) & (F.size("_words") > 0), starts)
        .otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("base"),
        F.when(gated, detections(text)).otherwise(F.array().cast(_HIT)).alias("detections"),
    )


def report(docs: DataFrame) -> DataFrame:
    base, found = F.col("base"), F.col("detections")
    starts = F.transform(base, lambda b: b["start"])
    labels_of = lambda c: F.transform(c, lambda x: x["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform(found, lambda d: d["score"])), F.lit(0.0))
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(labels_of(base)).alias("base_labels"),
        listed(F.concat(labels_of(base), labels_of(found))).alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
        F.size(found).cast("long").alias("n_detections"),
    )
