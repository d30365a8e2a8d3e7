"""Archives: exact round trips, the revisit rule against a plain model, and archives of other writers."""

import gzip
import hashlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, key string, digest string"
BIG = "x" * 1000


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "k", "d") for r in rows], SCHEMA)
    out = warc.report(df, str(tmp_path / "w")).collect()
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)


def model(rows):
    last = {}
    for i, _, html in rows:
        body = html or ""
        if len(body.encode()) >= 1000:
            last[body] = max(last.get(body, -1), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = last.get(html or "", i)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def test_edges(spark, tmp_path):
    rows = [
        (1, "http://a/b?c", BIG), (2, "http://a/", BIG), (3, None, BIG[:-1]), (4, "", BIG[:-1]), (5, "u", None), (6, "u", ""),
        (7, "http://a/\r\nWARC/1.1", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 90), (8, "x", "é" * 500), (9, "x", "é" * 500),
        (10, "x", "é" * 499), (11, "x", "é" * 499), (12, "x", "\r\n\r\n"), (13, "x", "\x00\n" * 600), (14, "x", "z" * 3_000_000), (15, "x", BIG),
    ]
    assert run(spark, tmp_path, rows) == model(rows)


def test_equal_rows_are_captures_of_their_own(spark, tmp_path):
    got = run(spark, tmp_path, [(1, "u", BIG), (1, "u", BIG), (None, "u", BIG)])
    assert sorted((r[0] or 0, r[3], r[4]) for r in got if r[0] or r[3] == "revisit") == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1)]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_nested_row_holds_all_three(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://h/p?q", "<p>é</p>", "", "")], SCHEMA)
    warc.write_archives(df, str(tmp_path / "w"))
    row = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()[0]
    assert bytes(row["response"]["payload"]).decode() == "<p>é</p>"
    assert row["request"]["target_uri"] == "http://h/p?q" and row["request"]["record_id"] != row["response"]["record_id"]
    assert [(f["name"], f["value"]) for f in row["metadata"]["fields"]] == [("page", "1")]


def other(kind, name, block, extra=""):
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [b"".join, lambda rs: b"".join(map(gzip.compress, rs)), lambda rs: gzip.compress(b"".join(rs))])
def test_archives_of_other_writers(spark, tmp_path, pack):
    records = [
        other("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields\r\n"),
        other("response", "r", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", "Content-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://a\r\n"),
        other("request", "q", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>\r\nContent-Type: application/http\r\n"),
        other("metadata", "m", b"a: b\r\n c\r\n", "WARC-Concurrent-To: <r>\r\nContent-Type: application/warc-fields\r\n"),
    ]
    (tmp_path / "x.warc").write_bytes(pack(records))
    rows = {r["transaction"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert bytes(rows["<r>"]["response"]["payload"]) == b"body"
    assert rows["<r>"]["metadata"]["fields"][0]["value"] == "b c" and rows["<i>"]["response"] is None


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"junk"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(other("response", "r", b"abc")[:-6]))


def test_whole_table(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    out = warc.report(pages, str(tmp_path / "w")).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    assert got == model(rows)
