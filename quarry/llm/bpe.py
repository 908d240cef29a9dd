"""Byte-pair encoding and decoding from a tokenizer's vocabulary file.

A pre-token's symbols form a doubly linked list. A priority queue holds (merge rank, place of the left symbol); the
lowest rank, leftmost first, is popped, and skipped when the pair that stands there now has another rank. Each merge
relinks the list and pushes the two new pairs. Decoding concatenates vocabulary strings. Encoded units are cached in
each worker, in caches of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import resident
from quarry.llm.units import ByteEncoder, byte_chars

_SHIFT = 21


class LinkedBpe:
    """vocab: token string to id; merges in order of rank; both over the printable stand-ins of bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        self.vocab, self.merges, self.specials = vocab, merges, specials
        chars = byte_chars()
        self.byte_ids = [vocab.get(c) for c in chars]
        to_byte = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *specials.values()], default=-1) + 1
        self.strings = [b""] * size
        for token, i in (vocab | specials).items():
            self.strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id by pair of ids; made when something is first encoded, as decoding needs none."""
        found: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(self.merges):
            found.setdefault(self.vocab[a] << _SHIFT | self.vocab[b], (rank, self.vocab[a + b]))
        self.vocab, self.merges = {}, []
        return found

    @cached_property
    def encoder(self) -> ByteEncoder:
        return ByteEncoder(self.merge, "<u4", self.specials, 400_000, 200_000)

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token. Bytes without a vocabulary entry are left out, as the vocabulary has no id for them."""
        ids = [i for i in map(self.byte_ids.__getitem__, piece.encode()) if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        get = self.pairs.get
        queue = [(found[0], k, found[1]) for k in range(n - 1) if (found := get(ids[k] << _SHIFT | ids[k + 1]))]
        heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            rank, k, made = heappop(queue)
            j = after[k]
            if ids[k] < 0 or j < 0 or (found := get(ids[k] << _SHIFT | ids[j])) is None or found[0] != rank:
                continue  # stale
            ids[k], ids[j] = made, -1
            after[k] = j = after[j]
            if j >= 0:
                before[j] = k
                if found := get(made << _SHIFT | ids[j]):
                    heappush(queue, (found[0], k, found[1]))
            if (i := before[k]) >= 0 and (found := get(ids[i] << _SHIFT | made)):
                heappush(queue, (found[0], i, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        return self.encoder.packed(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> LinkedBpe:
    """From a tokenizers file with a byte-level BPE model; made once per worker."""
    return resident(f"bpe {path}", lambda: _load(path))


def _load(path: str) -> LinkedBpe:
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in conf["model"]["merges"]]
    return LinkedBpe(conf["model"]["vocab"], merges, {t["content"]: t["id"] for t in conf["added_tokens"]})


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers): one row per input row.

    A null text is encoded as empty, to no ids. Special tokens' strings in a text become their ids. Repeated rows and
    null ids give a row each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text of what bpe_encode returns. Bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from quarry.llm.common import documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_decode(bpe_encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
