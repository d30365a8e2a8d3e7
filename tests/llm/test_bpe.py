"""Tokens against the tokenizers library, windows against whole pieces, and exact round trips."""

import hashlib
import random
from itertools import chain

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


TEXTS = [
    "", " ", "\n", "Hello world's they're'll 'd don't", "x" * 5000, "ab" * 4000, "a1 2é𝒳  \t\n  end ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "<|endoftext|", " " * 70000 + "x", "é" * 40000, "word " * 30000, "'r" * 40000, "  x\u0085y", "1234567890" * 900, "日本語のテキスト" * 50,
    "!?*&" * 3000, "\x00\x01\x7f", "à́ ½ Ⅷ ²", "the theory of thethethethe" * 300, "Don'T I'LL 's",
]


def test_equals_the_library(codec, library):
    encoder, decoder = bpe.Encoder(codec), bpe.Decoder(codec)
    r = random.Random(1)
    more = ["".join(r.choices("aethinos 's.,\n\té𝒳1*", k=r.randint(0, 300))) for _ in range(500)]
    more += ["".join(r.choices("etaoinsr", k=4000)) for _ in range(5)]
    for text in TEXTS + more:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(encoder(text)) == ids, text[:80]
        assert decoder(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([]) == 0
    # "ab" then "ca": an unseen b takes the a, so the c before it may settle differently
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"c", b"a")]) == 2
    assert bpe.sufficient_lookahead([(b"c", b"a"), (b"a", b"b")]) == 1


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_whole(codec, seed, monkeypatch):
    r = random.Random(seed)
    for _ in range(40):
        data = "".join(r.choices(["th", "e", "in", "er", "a", "on", "re", "é", "z"], k=r.randint(0, 1500))).encode()
        whole = codec._merged_by_heap([codec.single[b] for b in data])
        assert list(chain.from_iterable(codec.stream(data))) == whole


def test_lookahead_is_sufficient_for_random_lists():
    """Small made-up merge lists, all continuations: what lies beyond the bound never changes."""
    r = random.Random(3)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 8:
            pair = (r.choice(tokens), r.choice(tokens))
            if pair not in merges and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        ids = {t: i for i, t in enumerate(tokens)}
        c = bpe.Codec.__new__(bpe.Codec)
        c.single = [ids.get(bytes([b]), 0) for b in range(256)]
        c.rank_of = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        c.product = [ids[a + b] for a, b in merges]
        look = bpe.sufficient_lookahead(merges)
        for _ in range(60):
            head = bytes(r.choices(b"abc", k=look + r.randint(1, 12)))
            stable = None
            for tail in [b""] + [bytes(r.choices(b"abc", k=r.randint(1, 8))) for _ in range(8)]:
                out, n, cut = c.merged(head + tail), 0, []
                for i in out:
                    n += len(tokens[i])
                    if n > len(head) - look:
                        break
                    cut.append(i)
                assert stable is None or cut == stable, (merges, head, tail)
                stable = cut


def test_unfinished_characters(codec):
    ids = [codec.single[b] for b in "é€𝒳".encode()]
    assert bpe.Decoder(codec)(ids) == "é€𝒳"
    assert bpe.Decoder(codec)(ids[:1]) == "�"
    assert bpe.Decoder(codec)([10**9]) == ""


def test_query(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, None])]
    got = {r["doc_id"]: r for r in bpe.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table_nulls_and_repeats(spark):
    assert bpe.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = bpe.report(spark.createDataFrame([(None, "a", None, None), (1, None, None, None), (1, None, None, None)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == [(-1, 1), (1, 0), (1, 0)]


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    once = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == texts[r["doc_id"]] and once[r["doc_id"]] == r


def test_a_worker_keeps_few_pieces(codec):
    """The cache of a worker, both generations, stays small beside the worker; pieces that left it are merged again, to the same ids."""
    encoder = bpe.Encoder(codec)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(420_000))
    first = encoder(text)
    size = sum(len(k) + 49 + len(v) + 33 + 100 for known in (codec.known, codec.known.old) for k, v in known.items())
    assert size < 80 << 20 and len(codec.known) + len(codec.known.old) <= 2 * 150_000
    again = encoder(text[:5999])  # whole words
    assert again == first[:len(again)]
