"""JPEG: exact payloads, and images that another encoder's rules describe."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from quarry.llm import jpeg_media
from tests.llm.texts import SCHEMA, frame, rows


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_payloads_round_trip():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * k, dtype=np.uint8).tobytes() for k in (1, 2, 342, 7281, 7282)] + [b"\xff" * 576, b"\0\xff" * 576]
    for payload, (images, thumbs) in zip(payloads, jpeg_media.read_media(jpeg_media.store_payloads(payloads)), strict=True):
        assert jpeg_media.payload_of(images, thumbs) == payload


def test_text_media_features(spark):
    media = jpeg_media.text_media(frame(spark))
    found = {r["doc_id"]: r for r in jpeg_media.media_features(media, with_thumbnail=True).collect()}
    for d, text, *_ in rows():
        p, r = padded(text), found[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r["width"] * r["height"] == 64 * len(p) and r["error"] is None and bytes(r["thumbnail"]) == p
    same = {}
    for d, text, *_ in rows():
        same.setdefault(text or "", set()).add((found[d]["media_sha256"], found[d]["mean_hash"]))
    assert all(len(x) == 1 for x in same.values())
    assert jpeg_media.text_media(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damaged_media_give_an_error(spark):
    good = jpeg_media.store_payloads([padded("abc")])[0]
    bad = [None, b"", b"no", good[:-40], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good]
    media = spark.createDataFrame([(k, 3, m) for k, m in enumerate(bad)], "doc_id long, n_bytes long, media binary")
    found = {r["doc_id"]: r for r in jpeg_media.media_features(media).collect()}
    assert all(found[k]["error"] and found[k]["width"] is None for k in range(5))
    assert found[4]["error"] == "not baseline" and found[5]["error"] is None


def bits_of(value, size):
    return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def general_image(width, height, sampling, restart, seed):
    """A baseline image with AC coefficients and subsampled colour, written symbol by symbol; its luminance DC values by block."""
    rng = np.random.default_rng(seed)
    dc = {k: 4 for k in range(12)}
    ac = {0: 2, 0xF0: 4, **{run << 4 | size: 7 for run in (0, 1, 5) for size in (1, 2, 3)}}
    codes = {}
    for name, lengths in (("dc", dc), ("ac", ac)):
        code, last = 0, 0
        for s in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            codes[name, s] = format(code, f"0{last}b")
            code += 1
    h, v = sampling
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    luma = np.zeros((down * v, across * h), int)
    scan, bits, previous, count, marks = b"", "", [0, 0, 0], 0, 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for my in range(down):
        for mx in range(across):
            if restart and count and count % restart == 0:
                scan += flush(bits) + bytes([0xFF, 0xD0 + marks % 8])
                bits, previous, marks = "", [0, 0, 0], marks + 1
            count += 1
            for c, blocks in ((0, h * v), (1, 1), (2, 1)):
                for b in range(blocks):
                    value = int(rng.integers(-60, 60))
                    if c == 0:
                        luma[my * v + b // h, mx * h + b % h] = value
                    size = abs(value - previous[c]).bit_length()
                    bits += codes["dc", size] + bits_of(value - previous[c], size)
                    previous[c] = value
                    k = 1
                    while k < 50 and rng.random() < 0.6:
                        if rng.random() < 0.1:
                            bits, k = bits + codes["ac", 0xF0], k + 16
                            continue
                        run, size = int(rng.choice([0, 1, 5])), int(rng.integers(1, 4))
                        bits += codes["ac", run << 4 | size] + bits_of(int(rng.integers(1 << (size - 1), 1 << size)) * int(rng.choice([-1, 1])), size)
                        k += run + 1
                    bits += codes["ac", 0]
    scan += flush(bits)
    tables = b"".join(b"\xff\xc4" + struct.pack(">HB", 3 + len(x), kind) + x for kind, x in ((0, jpeg_media.huffman_table(dc)), (0x10, jpeg_media.huffman_table(ac))))
    frame_ = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8\xff\xdb\0\x43\0\x05" + b"\x02" * 63 + frame_ + tables + (b"\xff\xdd\0\x04" + struct.pack(">H", restart) if restart else b"")
    return head + b"\xff\xda\0\x0c\x03\x01\0\x02\0\x03\0\0\x3f\0" + scan + b"\xff\xd9", luma


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
@pytest.mark.parametrize("restart", [0, 3])
def test_general_baseline_images(sampling, restart):
    made = [general_image(50, 37, sampling, restart, s) for s in (1, 2)]
    for (_, luma), (images, thumbs) in zip(made, jpeg_media.read_media([m[0] for m in made]), strict=True):
        want = np.clip((luma * 5 + 4) // 8 + 128, 0, 255)[:5, :7]
        assert (images[0].width, images[0].height) == (50, 37) and (thumbs[0] == want).all()
        assert jpeg_media.payload_of(images, thumbs) is None
