"""Operators over token ids against the tokenizers library."""

import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, packing, token_binary, token_counts
from quarry.llm.common import Scratch
from quarry.llm.units import library_encoder
from tests.llm.texts import SCHEMA, frame, rows

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_units_equal_whole_texts(path):
    encoder, library = library_encoder(path), tokenizer(path)
    for _, text, *_ in rows(2, 300):
        assert encoder.ids(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library_and_round_trips(spark):
    library = tokenizer(BYTE)
    found = {r["doc_id"]: r for r in bpe.bpe_decode(bpe.bpe_encode(frame(spark), BYTE), BYTE).collect()}
    assert len(found) == len(rows())
    for d, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert bytes(found[d]["ids"]) == packed(ids)
        assert found[d]["text"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_takes_ranks_leftmost_first():
    own = bpe.LinkedBpe({"a": 0, "b": 1, "aa": 2, "ab": 3, "aaa": 4}, [("a", "a"), ("a", "b"), ("aa", "a")], {})
    assert own.merge("aaab") == [2, 3]
    assert own.merge("aaa") == [4]
    assert own.merge("") == []


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 0, 34])
    free = token_binary.code_lengths(counts, 16)
    queue, inner = [int(c) for c in counts if c], 0
    heapify(queue)
    while len(queue) > 1:
        pair = heappop(queue) + heappop(queue)
        inner += pair
        heappush(queue, pair)
    assert (counts * free).sum() == inner and free[8] == 0
    tight = token_binary.code_lengths(counts, 4)
    assert tight.max() == 4 and np.isclose((2.0 ** -tight[tight > 0].astype(float)).sum(), 1)


def test_token_file_round_trip(spark):
    path = Scratch(spark, "test-token-file").path
    token_binary.write_token_file(frame(spark), WORD, path, end_id=1)
    found = token_binary.read_token_file(spark, path).orderBy("start").collect()
    library, start = tokenizer(WORD), 0
    for (d, text, *_), r in zip(sorted(rows(), key=lambda x: x[0]), found, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (d, start, len(ids), packed(ids))
        assert r["ids_crc32"] == zlib.crc32(packed(ids))
        start += len(ids)


def test_token_file_of_empty_table_null_and_repeated_ids(spark):
    path = Scratch(spark, "test-token-file").path
    token_binary.write_token_file(spark.createDataFrame([], SCHEMA), WORD, path, end_id=1)
    assert token_binary.read_token_file(spark, path).count() == 0
    path = Scratch(spark, "test-token-file").path
    data = [(None, "b", *[None] * 5, 1), (4, "two words", *[None] * 5, 1), (4, "two words", *[None] * 5, 1)]
    token_binary.write_token_file(spark.createDataFrame(data, SCHEMA), WORD, path, end_id=1)
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_binary.read_token_file(spark, path).orderBy("start").collect()] == [(None, 0, 2), (4, 2, 3), (4, 5, 3)]


def check_packing(found, capacity, documents):
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for d, ids in documents.items():
        pieces = sorted((r for r in found if r["doc_id"] == d), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == capacity or k == 0)
            assert r["ids_crc32"] == zlib.crc32(packed(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    return len(bins)


def test_packing(spark):
    library = tokenizer(BYTE)
    documents = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t, *_ in rows()}
    result = packing.best_fit_packing(frame(spark).repartition(7), BYTE, capacity=256, fan_in=2).cache()
    used = check_packing(result.collect(), 256, documents)
    whole = [n for ids in documents.values() for n in [256] * (len(ids) // 256) + [len(ids) % 256] if n]
    assert used <= len(packing.best_fit(whole, 256)[2]) + 2
    for r in packing.sequences(result).collect():
        assert r["n_tokens"] * 2 == len(r["ids"])
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_packing_keeps_what_a_node_does_not_pass_on(spark):
    library = tokenizer(BYTE)
    documents = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t, *_ in rows()}
    result = packing.best_fit_packing(frame(spark).repartition(9), BYTE, capacity=300, fan_in=2, most_open=1)
    check_packing(result.collect(), 300, documents)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert (bins, offsets, fills) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8], [10, 10])


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_follow_the_rule(spark, rule):
    library = tokenizer(BYTE)
    found = {}
    for r in token_counts.section_token_counts(frame(spark), BYTE, rule).collect():
        found.setdefault(r["doc_id"], {})[r["section"]] = (r["n_bytes"], r["n_tokens"])
    for d, text, *_ in rows():
        raw = (text or "").encode()
        lines = [x + b"\n" for x in raw.split(b"\n")[:-1]] + ([raw.split(b"\n")[-1]] if not raw.endswith(b"\n") else [])
        lines = lines or [b""]
        assert [found[d][k][0] for k in range(len(lines))] == [len(x) for x in lines]
        of_byte = [k for k, x in enumerate(lines) for _ in x]
        want, at = [0] * len(lines), 0
        for i in library.encode(text or "", add_special_tokens=False).ids:
            inside = of_byte[at : at + len(bpe.load(BYTE).strings[i])]
            place = inside[0] if rule == "first" else inside[-1] if rule == "last" else max(sorted(set(inside)), key=inside.count)
            want[place] += 1
            at += len(inside)
        assert at == len(raw)
        assert [found[d][k][1] for k in range(len(lines))] == want


def test_section_counts_refuse_an_unknown_rule(spark):
    with pytest.raises(ValueError):
        token_counts.section_token_counts(frame(spark), BYTE, "nearest")


def test_a_chunk_of_pieces_is_handed_over_in_slices(monkeypatch):
    import pyarrow as pa

    from quarry.llm import packing

    class Docs:
        selectExpr = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    class Encoder:
        dtype = np.dtype("<u2")
        packed = staticmethod(lambda text: text.encode("utf-16-le"))

    monkeypatch.setattr(packing, "library_encoder", lambda path: Encoder)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    run = packing.tokenised_pieces(Docs(), "", 8, 0, "doc_id", "text")
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(["abc"] * 2500)], ["doc_id", "text"])
    found = list(run([batch]))
    assert [b.num_rows for b in found] == [1024, 1024, 452] and [d for b in found for d in b.column(0).to_pylist()] == list(range(2500))
