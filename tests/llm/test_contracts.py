"""The queries' contracts over one small made folder, each against brute force with the tokenizers library or plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import queries
from quarry.llm.common import Scratch
from tests.llm.test_dedup import brute
from tests.llm.test_models import LOWER, brute_base, language_rows, toxic_rows
from tests.llm.texts import rows


@pytest.fixture(scope="module")
def made(spark):
    """Odd texts, texts of three languages, and toxic ones with labels; ids apart."""
    data = {10 * d + 1: (t, "en") for d, t, *_ in rows(3, 25)}
    data |= {100_000 + d: (t, lang) for d, t, lang, *_ in language_rows(90)}
    toxic, labels = toxic_rows(400)
    data |= {200_000 + d: (t, None) for d, t, *_ in toxic}
    data[300_000] = ("long " * 9000, "en")
    folder = Scratch(spark, "contracts").path
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, (t, lang) in data.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(200_000 + d, 1, v) for d, v in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {d: t for d, (t, _) in data.items()}, {d: lang for d, (_, lang) in data.items()}, {200_000 + d: v for d, v in labels}


def run(spark, made, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, made[0]).collect()}


def tokenizer(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def remainder(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_op1(spark, made):
    tok, found, start = tokenizer("word_bpe_49k.json"), run(spark, made, "op1_token_binary"), 0
    for d in sorted(made[1]):
        ids = [*tok.encode(made[1][d] or "", add_special_tokens=False).ids, 1]
        assert tuple(found[d][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(made[1])


def test_op2(spark, made):
    found = run(spark, made, "op2_jaccard_join")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == brute(list(made[1].items()))


def test_op4(spark, made):
    tok, sums = tokenizer("byte_bpe_50k.json"), Counter()
    n_bytes = Counter()
    for r in queries.QUERIES["op4_token_counts"](spark, made[0]).collect():
        sums[r["doc_id"]] += r["n_tokens"]
        n_bytes[r["doc_id"]] += r["n_bytes"]
    for d, t in made[1].items():
        assert (sums[d], n_bytes[d]) == (len(tok.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))


def test_op5(spark, made):
    found = run(spark, made, "op5_media")
    for d, t in made[1].items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = found[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
    by_text = {}
    for d, t in made[1].items():
        assert by_text.setdefault(t or "", tuple(found[d][c] for c in ("media_sha256", "feature"))) == tuple(found[d][c] for c in ("media_sha256", "feature"))


def test_op6(spark, made):
    tok, per, bins = tokenizer("byte_bpe_50k.json"), {}, {}
    for r in queries.QUERIES["op6_best_fit_packing"](spark, made[0]).collect():
        per.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for d, t in made[1].items():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 0], 0
        total += len(ids)
        pieces = sorted(per[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048))) and all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            assert (r["start"], r["ids_crc32"]) == (at, crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for pieces in bins.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_op7(spark, made):
    found = run(spark, made, "op7_toxicity")
    assert set(found) == set(made[1]) and all(r["held_out"] == (remainder(d, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in found.items())
    held = [d for d in made[3] if remainder(d, 4) == 2]
    assert len(held) > 50 and all(found[d]["predicted"] == made[3][d] for d in held)


def test_op8(spark, made):
    tok, found = tokenizer("byte_bpe_50k.json"), run(spark, made, "op8_bpe")
    for d, t in made[1].items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(found[d][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_op9(spark, made):
    found = run(spark, made, "op9_lm_scores")
    want = brute_base([(d, t) for d, t in made[1].items()], lambda d: remainder(d, 7) != 2)
    for d, (n, known, total, base) in want.items():
        r = found[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(d, 7) == 2, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_op10(spark, made):
    found = run(spark, made, "op10_language_id")
    for d, t in made[1].items():
        r = found[d]
        assert r["held_out"] == (remainder(d, 3) == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    held = [d for d in made[2] if 100_000 <= d < 200_000 and remainder(d, 3) == 1]
    assert len(held) > 15 and np.mean([found[d]["lang_pred"] == made[2][d] for d in held]) > 0.95


def test_op3_matches_plain_python(spark, made):
    found = run(spark, made, "op3_exact_dedup")
    groups = {}
    for d, t in made[1].items():
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    for t, ids in groups.items():
        for d in ids:
            r = found[d]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, made, name):
    folder = Scratch(spark, "empty").path
    for table in ("documents", "labels"):
        spark.read.parquet(f"{made[0]}/{table}.parquet").where("false").write.parquet(f"{folder}/{table}.parquet")
    assert queries.QUERIES[name](spark, folder).count() == 0
