"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge can reach back over what was already read only through a chain of merges of rising rank, each touching the start of
the last.  ``sufficient_lookahead`` follows all such chains through the merge list and returns the farthest reach in bytes: a token that
ends that far before the end of what was read can never change.  A piece is therefore merged in windows of fixed size, tokens
are emitted once they are stable, and the window starts again at the first token that is not.  Text is cut into pieces in
windows too.  Decoding turns ids back into bytes and bytes into text, keeping the unfinished character between chunks.

Memory per task is a bounded cache, one window and the ids of the row at hand.  The tables come from the tokenizer file, read by
the driver and sent once; their size is that of the vocabulary.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that stand twice are answered twice; a null id
stays null; other columns of the input are not looked at; ids outside the vocabulary are left out when decoding.
"""

from __future__ import annotations

import codecs
import heapq
import json
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions of this module travel with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "byte_bpe_50k.json"
#: How texts are cut into pieces before merging.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 1 << 16
#: A piece can depend on up to three characters after it, and every piece has one at least.
GUARD = 4
CHUNK = 512
#: Pieces of a generation of the cache; a worker holds two at most, of some 200 bytes a piece.
CACHE = 150_000
NONE = 1 << 60
ROWS = 128


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Most bytes by which an unseen continuation can move the point up to which tokens are settled.

    ``reach[t]``: how far back that point can lie when token t begins there.  Any byte can begin the unseen part.  The merge (c, d)
    moves the point over c when d can begin there; the token there is then c, or c and d merged; c can also grow to the right in place.
    Merges apply in rank order, so one pass over the list follows every chain.
    """
    reach = {bytes([b]): 0 for b in range(256)}
    for c, d in merges:
        both = max(reach.get(c, -1), reach[d] + len(c) if d in reach else -1)
        if d in reach:
            reach[c] = max(reach.get(c, -1), reach[d] + len(c))
        if both >= 0:
            reach[c + d] = max(reach.get(c + d, -1), both)
    return max(reach.values())


class Codec:
    """Tables of one tokenizer file and the transducer over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = _visible()
        raw = lambda token: bytes(visible[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.single[b[0]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.product = [vocab[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.longest = max(map(len, self.bytes_of.values()))

    def merged(self, data: bytes) -> list[int]:
        """Ids of a short run of bytes: always the pair of lowest rank, leftmost first."""
        ids = [self.single[b] for b in data]
        if len(ids) > 64:
            return self._merged_by_heap(ids)
        rank_of, product = self.rank_of, self.product
        ranks = [rank_of.get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < NONE:
            i = ranks.index(rank)
            ids[i:i + 2] = [product[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of.get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank_of.get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, rank_of, product = len(ids), self.rank_of, self.product
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := rank_of.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = product[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Ids of a run of bytes of any length, in stable portions."""
        start, chunk = 0, max(CHUNK, 2 * self.longest)
        while True:
            stop = min(len(data), start + self.lookahead + chunk)
            ids = self.merged(data[start:stop])
            if stop == len(data):
                yield ids
                return
            settled, n = stop - start - self.lookahead, 0
            for k, i in enumerate(ids):
                if n + len(self.bytes_of[i]) > settled:
                    yield ids[:k]
                    break
                n += len(self.bytes_of[i])
            start += n


def pieces(text: str, split: regex.Pattern) -> Iterator[list[str]]:
    """The pieces of a text, window by window; the last of a window are cut again with the next one."""
    pos, n = 0, len(text)
    while pos < n:
        end = min(n, pos + WINDOW)
        found = split.findall(text, pos, end)
        if end < n:
            # a piece longer than the window is found by itself
            found = found[:-GUARD] if len(found) > GUARD else [split.match(text, pos).group()]
        pos = pos + sum(map(len, found)) if end < n else n
        yield found


class _Known(dict):
    """Ids by piece, as the bytes of an array. When full, it becomes the old generation, from which pieces still in use come back; so memory
    stays bounded.

    Long pieces are streamed and not kept.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            if len(data) > 64:
                return array("i", chain.from_iterable(self.codec.stream(data))).tobytes()
            ids = array("i", self.codec.merged(data)).tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, codec: Codec):
        self.special = codec.special
        # kept with the tables, which a worker keeps between tasks
        self.known = codec.__dict__.setdefault("known", _Known(codec))
        self.split = regex.compile(PIECE)
        words = sorted(map(regex.escape, codec.special), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(words) + ")") if words else None

    def __call__(self, text: str) -> array:
        ids = array("i")
        for part in self.cut.splititer(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for found in pieces(part, self.split):
                ids.frombytes(b"".join(map(self.known.__getitem__, found)))
        return ids


class _Bytes(dict):
    """Bytes by id; an id outside the vocabulary has none."""

    def __missing__(self, i: int) -> bytes:
        return b""


class Decoder:
    """Ids to text, chunk by chunk; bytes of an unfinished character wait for the next chunk."""

    def __init__(self, codec: Codec):
        self.bytes_of = _Bytes(codec.bytes_of)

    def __call__(self, ids) -> str:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        out, rest, get = [], iter(ids), self.bytes_of.__getitem__
        while part := list(islice(rest, WINDOW)):
            out.append(state.decode(b"".join(map(get, part))))
        out.append(state.decode(b"", True))
        return "".join(out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _shared(docs: DataFrame, path: str | None):
    return docs.sparkSession.sparkContext.broadcast(Codec(path or tokenizer_path()))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids``, the tokens of the whole text."""
    codec = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec.value)
        for batch in _slices(batches):
            values, offsets = array("i"), array("i", [0])
            for text in batch.column(1):
                values.extend(encoder(text.as_py() or ""))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(values), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text its ids stand for."""
    codec = _shared(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(codec.value)
        for batch in _slices(batches):
            texts = [decoder(() if ids.values is None else ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = tokens.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnsRenamed({"id": id_col, "ids": ids_col})


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass: id, ``ids`` and ``decoded``, without the ids leaving the worker in between."""
    codec = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(codec.value), Decoder(codec.value)
        for batch in _slices(batches):
            values, offsets, texts = array("i"), array("i", [0]), []
            for text in batch.column(1):
                ids = encoder(text.as_py() or "")
                texts.append(decoder(ids))
                values.extend(ids)
                offsets.append(len(values))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(values), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the tokens and of what they decode to."""
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
