"""Baseline JPEG in numpy: parsing, Huffman decoding of scans, and DC-only luminance thumbnails.

A thumbnail has one sample for each 8x8 block: the block's mean, which its DC coefficient gives without an inverse
transform. Scans are decoded in step: every restart segment of many images that share their tables is one lane, and a
step decodes one block in each lane. A 16-bit look-up holds every block that is short (a DC code, its bits and the end
of block); other blocks are decoded symbol by symbol.

Payloads are stored as images of flat blocks: byte v is one block whose 64 samples all are v (DC quantiser 8, so the
quantised DC coefficient is v - 128 exactly). Any baseline decoder shows them, and the thumbnail is the payload. A comment
segment holds the number of payload bytes. A payload over `IMAGE` bytes becomes several images, one after another.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Payload bytes are padded to a positive multiple of this, with bytes 255.
UNIT = 576
#: Most payload bytes of one image, and payload bytes that one numpy call handles.
IMAGE = UNIT * 7281
GROUP = 1 << 22
RESTART = 96
#: Fixed value: the end of a scan is a marker other than stuffing and restarts.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
#: Code length of each DC category in the images written here; differences of text bytes are mostly of category 3, 4 and 7.
DC_LENGTHS = {7: 2, 4: 2, 3: 3, 2: 3, 5: 3, 1: 4, 0: 5, 6: 6, 8: 7}


def huffman_table(lengths: dict[int, int]) -> bytes:
    """Body of a DHT entry: codes per length, then symbols by length."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(symbols)


class Table:
    """A Huffman table as a look-up of the next 16 bits: symbol and code length (0: no code)."""

    def __init__(self, body: bytes):
        self.symbol, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                at, span = code << (16 - n), 1 << (16 - n)
                self.symbol[at : at + span], self.size[at : at + span] = body[k], n
                code, k = code + 1, k + 1
            code <<= 1


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of `size` bits."""
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


_tables: dict = {}


def tables(dc: bytes, ac: bytes) -> tuple:
    """DC and AC look-ups, and for each 16 bits that hold a whole short block, its difference and length."""
    if (dc, ac) not in _tables:
        d, a, x = Table(dc), Table(ac), np.arange(1 << 16)
        cat, used = d.symbol, d.size + d.symbol
        bits = (x >> np.clip(16 - used, 0, 16)) & ((1 << cat) - 1)
        rest = (x << np.clip(used, 0, 16)) & 0xFFFF
        whole = used + a.size[rest]
        short = (d.size > 0) & (a.size[rest] > 0) & (a.symbol[rest] == 0) & (whole <= 16) & (cat <= 11)
        if len(_tables) > 64:
            _tables.clear()
        _tables[dc, ac] = d, a, np.where(short, extend(bits, cat), 0), np.where(short, whole, 0)
    return _tables[dc, ac]


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[bytes, bytes]]
    restart: int
    data: tuple[int, int]


@dataclass
class Image:
    raw: bytes
    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[int] = field(default_factory=list)  # DC quantiser of each component
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)


def parse(raw: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that begins at `at`, and where it ends. ValueError if it isn't a whole baseline JPEG."""
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(raw), at + 2
    quant: dict[int, int] = {}
    huff: dict[int, bytes] = {}
    ids: list[int] = []
    q_of: list[int] = []
    restart = 0
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind, at = raw[at + 1], at + 2
        if kind == 0xFF:
            at -= 1
            continue
        if kind == 0xD9:
            if not image.scans:
                raise ValueError("no scan")
            image.quant = [quant.get(q, 1) for q in q_of]
            return image, at
        if at + 2 > len(raw):
            raise ValueError("a segment is cut short")
        size = int.from_bytes(raw[at : at + 2], "big")
        body = raw[at + 2 : at + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut short")
        at += size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 65 + 64 * wide
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = 17 + sum(body[k + 1 : k + 17])
                huff[body[k]] = body[k + 1 : k + n]
                k += n
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            image.height, image.width, n = struct.unpack(">HHB", body[1:6])
            ids = [body[6 + 3 * c] for c in range(n)]
            image.sampling = [(body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(n)]
            q_of = [body[8 + 3 * c] for c in range(n)]
            if not image.width or not image.height:
                raise ValueError("no size")
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            image.comments.append(body)
        elif kind == 0xDA:
            n = body[0]
            chosen = [ids.index(body[1 + 2 * c]) for c in range(n)]
            used = [(huff[body[2 + 2 * c] >> 4], huff[0x10 | body[2 + 2 * c] & 15]) for c in range(n)]
            end = SCAN_END.search(raw, at)
            if not end:
                raise ValueError("the scan has no end")
            image.scans.append(Scan(chosen, used, restart, (at, end.start())))
            at = end.start()


def scan_blocks(image: Image, scan: Scan) -> tuple[list[int], int, int]:
    """Component (by place in the scan) of each block of an MCU, MCUs in a row, MCU rows."""
    wide, high = (max(s[k] for s in image.sampling) for k in (0, 1))
    if len(scan.components) == 1:
        h, v = image.sampling[scan.components[0]]
        return [0], -(-(-(-image.width * h // wide)) // 8), -(-(-(-image.height * v // high)) // 8)
    order = [c for c, k in enumerate(scan.components) for _ in range(image.sampling[k][0] * image.sampling[k][1])]
    return order, -(-image.width // (8 * wide)), -(-image.height // (8 * high))


def _lanes(images: list[tuple[Image, Scan]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Entropy-coded bytes without stuffing and markers, the lanes' first bytes, and lanes per image."""
    data = np.frombuffer(b"".join(i.raw[s.data[0] : s.data[1]] for i, s in images), np.uint8)
    sizes = np.array([s.data[1] - s.data[0] for _, s in images])
    begins = np.cumsum(sizes) - sizes
    after_ff = np.zeros(len(data), bool)
    after_ff[1:] = data[:-1] == 255
    after_ff[begins[sizes > 0]] = False
    mark = after_ff & (data >= 0xD0) & (data <= 0xD7)
    keep = ~(after_ff & (data == 0)) & ~mark
    keep[np.flatnonzero(mark) - 1] = False
    kept = np.cumsum(keep) - keep
    at_mark = np.flatnonzero(mark)
    of = np.searchsorted(begins, at_mark, "right") - 1
    starts = np.concatenate([begins, at_mark])
    order = np.lexsort((starts, np.concatenate([np.arange(len(images)), of])))
    place = np.append(kept, int(keep.sum()))[starts]
    return data[keep], place[order], (1 + np.bincount(of, minlength=len(images))).tolist()


def dc_values(images: list[tuple[Image, Scan]]) -> list[np.ndarray]:
    """Quantised DC coefficients of each image's scan in coded order. The images share their tables and MCU shape."""
    order, _, _ = scan_blocks(*images[0])
    data, starts, n_lanes = _lanes(images)
    totals = [(g := scan_blocks(i, s))[1] * g[2] * len(order) for i, s in images]
    blocks, first_out = [], []
    out_at = 0
    for (_, scan), lanes, total in zip(images, n_lanes, totals, strict=True):
        each = scan.restart * len(order) or total
        if lanes != max(1, -(-total // each)):
            raise ValueError("restart markers don't fit the size")
        first = np.arange(lanes, dtype=np.int64) * each
        blocks.append(np.minimum(each, total - first))
        first_out.append(out_at + first)
        out_at += total
    count, place = np.concatenate(blocks), np.concatenate(first_out)
    by_size = np.argsort(-count, kind="stable")
    count, place, at = count[by_size], place[by_size], starts[by_size].astype(np.int64) * 8
    wide = np.concatenate([data, np.full(16, 255, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(wide) - 4, np.uint64)
    for k in range(5):
        window |= wide[k : len(wide) - 4 + k] << np.uint64(8 * (4 - k))
    last = len(window) - 1

    def peek(pos: np.ndarray) -> np.ndarray:
        return (window[np.minimum(pos >> 3, last)] >> (24 - (pos & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFF

    out = np.zeros(out_at, np.int32)
    predicted = np.zeros((len(images[0][1].components), len(count)), np.int64)
    used = [tables(*t) for t in images[0][1].tables]
    live = len(count)
    for step in range(int(count[0])):
        while count[live - 1] <= step:
            live -= 1
        part = order[step % len(order)]
        dc, ac, short_diff, short_size = used[part]
        pos, pred = at[:live], predicted[part, :live]
        bits = peek(pos)
        size = short_size[bits]
        pred += short_diff[bits]
        pos += size
        if len(slow := np.flatnonzero(size == 0)):
            p = pos[slow]
            bits = peek(p)
            if not dc.size[bits].all():
                raise ValueError("a code that no table has")
            cat = dc.symbol[bits]
            p += dc.size[bits]
            pred[slow] += extend(peek(p) >> (16 - cat), cat)
            p += cat
            todo, k = np.arange(len(slow)), np.ones(len(slow), np.int64)
            while len(todo):
                bits = peek(p[todo])
                if not ac.size[bits].all():
                    raise ValueError("a code that no table has")
                symbol = ac.symbol[bits]
                p[todo] += ac.size[bits] + (symbol & 15)
                k[todo] += (symbol >> 4) + 1
                todo = todo[(symbol != 0) & (k[todo] < 64)]
            pos[slow] = p
        out[place[:live] + step] = pred
    if (at >> 3).max(initial=0) > len(data) + 8:
        raise ValueError("the scan is cut short")
    return np.split(out, np.cumsum(totals)[:-1])


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The luminance (first component) of each image with one sample per block."""
    found: list = [None] * len(images)
    groups: dict = {}
    for k, image in enumerate(images):
        scan = next((s for s in image.scans if 0 in s.components), None)
        if scan is None:
            raise ValueError("no luminance")
        shape = tuple(image.sampling[c] for c in scan.components) if len(scan.components) > 1 else ()
        groups.setdefault((tuple(scan.components), tuple(scan.tables), shape), []).append((k, image, scan))
    for members in groups.values():
        for (k, image, scan), dc in zip(members, dc_values([(i, s) for _, i, s in members]), strict=True):
            order, across, down = scan_blocks(image, scan)
            part = scan.components.index(0)
            mean = np.clip((dc.reshape(-1, len(order))[:, [b for b, c in enumerate(order) if c == part]] * image.quant[0] + 4) // 8 + 128, 0, 255)
            h, v = image.sampling[0] if len(order) > 1 else (1, 1)
            grid = mean.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            wide, high = (max(s[k] for s in image.sampling) for k in (0, 1))
            h, v = image.sampling[0]
            found[k] = grid[: -(-(-(-image.height * v // high)) // 8), : -(-(-(-image.width * h // wide)) // 8)].astype(np.uint8)
    return found


def area_means(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    cut = [np.arange(n) * size // n for n, size in ((rows, thumb.shape[0]), (columns, thumb.shape[1]))]
    if thumb.shape[0] < rows or thumb.shape[1] < columns:
        return thumb[np.ix_(*cut)].astype(np.float64)
    sums = np.add.reduceat(np.add.reduceat(thumb, cut[0], 0, np.int64), cut[1], 1)
    return sums / np.outer(np.diff(cut[0], append=thumb.shape[0]), np.diff(cut[1], append=thumb.shape[1]))


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Mean hash (8x8 areas against their mean) and gradient hash (rising to the right), in hexadecimal."""
    eight, nine = area_means(thumb, 8, 8), area_means(thumb, 8, 9)
    return tuple(np.packbits(x.ravel()).tobytes().hex() for x in (eight > eight.mean(), nine[:, 1:] > nine[:, :-1]))


class _Writer:
    def __init__(self):
        lengths, code, by_diff = DC_LENGTHS, 0, {}
        for cat in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[cat] - (by_diff[max(by_diff)][1] if by_diff else lengths[cat])
            by_diff[len(by_diff)] = (cat, lengths[cat], code)
            code += 1
        self.code, self.size = np.zeros(512, np.uint64), np.zeros(512, np.int64)
        prefix = {cat: (value, n) for cat, n, value in by_diff.values()}
        for diff in range(-255, 256):
            cat = abs(diff).bit_length()
            value, n = prefix[cat]
            bits = diff if diff >= 0 else diff + (1 << cat) - 1
            self.code[diff + 256], self.size[diff + 256] = (value << cat | bits) << 1, n + cat + 1  # and the end of block, code 0
        self.tables = b"\xff\xdb\x00\x43\x00\x08" + b"\x01" * 63
        self.huffman = b"".join(b"\xff\xc4" + struct.pack(">HB", 3 + len(body), kind) + body for kind, body in ((0, huffman_table(lengths)), (0x10, huffman_table({0: 1}))))

    def head(self, n: int) -> bytes:
        across = 24 if n <= 24 * 8191 else UNIT
        size = struct.pack(">HH", n // across * 8, across * 8)
        return (
            b"\xff\xd8\xff\xfe" + struct.pack(">H", 14) + b"QPAY" + struct.pack(">Q", n) + self.tables
            + b"\xff\xc0\x00\x0b\x08" + size + b"\x01\x01\x11\x00" + self.huffman + b"\xff\xdd\x00\x04" + struct.pack(">H", RESTART) + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
        )

    def images(self, payloads: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64)
        sizes = np.array([len(p) for p in payloads])
        lanes = -(-sizes // RESTART)
        in_image = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = np.repeat(np.cumsum(sizes) - sizes, lanes) + in_image * RESTART
        diff = np.diff(data, prepend=128)
        diff[first] = data[first] - 128
        diff += 256
        bits = self.size[diff]
        ends = np.cumsum(bits)
        lane_end = ends[np.append(first[1:], len(data)) - 1]
        lane_bits = np.diff(lane_end, prepend=0)
        lane_bytes = (lane_bits + 7) // 8
        lane_at = np.cumsum(lane_bytes) - lane_bytes
        blocks = np.diff(first, append=len(data))
        at = ends - bits + np.repeat(lane_at * 8 - (lane_end - lane_bits), blocks)
        wide = self.code[diff] << (64 - bits - (at & 31)).astype(np.uint64)
        n = int(lane_bytes.sum()) // 4 + 2
        words = np.bincount(at >> 5, (wide >> np.uint64(32)).astype(np.float64), n)
        words[1:] += np.bincount(at >> 5, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:-1]
        raw = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: int(lane_bytes.sum())].copy()
        raw[lane_at + lane_bytes - 1] |= ((1 << (lane_bytes * 8 - lane_bits)) - 1).astype(np.uint8)
        width = 1 + (raw == 255)
        last_of_image = np.cumsum(lanes) - 1
        extra = np.full(len(lane_at), 2)
        extra[last_of_image] = 0
        width[lane_at + lane_bytes - 1] += extra
        ends = np.cumsum(width)
        out = np.zeros(int(ends[-1]), np.uint8)
        out[ends - width] = raw
        lane_ends = ends[lane_at + lane_bytes - 1]
        marked = np.flatnonzero(extra)
        out[lane_ends[marked] - 2], out[lane_ends[marked] - 1] = 255, 0xD0 + in_image[marked] % 8
        cuts, stream = lane_ends[last_of_image].tolist(), out.tobytes()
        return [self.head(len(p)) + stream[a:b] + b"\xff\xd9" for p, a, b in zip(payloads, [0, *cuts[:-1]], cuts, strict=True)]


_writer: list[_Writer] = []


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of items of about GROUP bytes together."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > GROUP:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """JPEG bytes of payloads whose sizes are positive multiples of UNIT."""
    if not _writer:
        _writer.append(_Writer())
    cut = [(k, p[a : a + IMAGE]) for k, p in enumerate(payloads) for a in range(0, len(p), IMAGE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _groups([len(p) for _, p in cut]):
        for (k, _), image in zip(cut[a:b], _writer[0].images([p for _, p in cut[a:b]]), strict=True):
            out[k].append(image)
    return [b"".join(x) for x in out]


def parse_all(raw: bytes) -> list[Image]:
    images, at = [], 0
    while at < len(raw):
        image, at = parse(raw, at)
        images.append(image)
    if not images:
        raise ValueError("no start of image")
    return images


def read_media(media: list[bytes]) -> Iterator[tuple[list[Image], list[np.ndarray]]]:
    """Images and thumbnails of each item."""
    parsed = [parse_all(m) for m in media]
    for a, b in _groups([len(m) for m in media]):
        flat = [i for images in parsed[a:b] for i in images]
        if sum(len(i.raw) for i in flat[:1]) > 4 * GROUP:  # one very long item: image by image
            thumbs = [t for i in flat for t in thumbnails([i])]
        else:
            thumbs = thumbnails(flat)
        at = 0
        for images in parsed[a:b]:
            yield images, thumbs[at : at + len(images)]
            at += len(images)


def payload_of(images: list[Image], thumbs: list[np.ndarray]) -> bytes | None:
    """The stored payload; None if the images hold none."""
    out = []
    for image, thumb in zip(images, thumbs, strict=True):
        note = next((c for c in image.comments if c[:4] == b"QPAY" and len(c) == 12), None)
        if note is None:
            return None
        out.append(thumb.ravel()[: int.from_bytes(note[4:], "big")].tobytes())
    return b"".join(out)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded to a positive multiple of UNIT with bytes 255, as JPEG.

    A null text is empty. Repeated rows and null ids give rows of their own; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            for lo, hi in _groups([len(r) for r in raw]):
                padded = [r + b"\xff" * (-len(r) % UNIT if r else UNIT) for r in raw[lo:hi]]
                sizes = pa.array([len(r) for r in raw[lo:hi]], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), sizes, pa.array(store_payloads(padded), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, width int, height int, n_images int, mean_hash string, gradient_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def joined(thumbs: list[np.ndarray]) -> np.ndarray:
    """All images' thumbnails one below the other; narrower ones are filled up with their last column."""
    if len(thumbs) == 1:
        return thumbs[0]
    width = max(t.shape[1] for t in thumbs)
    return np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1])), "edge") for t in thumbs])


def media_features(media: DataFrame, with_thumbnail: bool = False) -> DataFrame:
    """Reads doc_id, n_bytes, media; returns dimensions (of the first image), their number, hashes of all thumbnails, and what is read back.

    Null, empty or damaged media and JPEG that isn't baseline give null features and the reason in `error`; payload columns
    are null for images that hold no payload. With `with_thumbnail`, the first image's thumbnail is a binary column.
    """

    def row(raw: bytes, images: list[Image], thumbs: list[np.ndarray]) -> tuple:
        mean, gradient = thumbnail_hashes(joined(thumbs))
        payload = payload_of(images, thumbs)
        read = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        own = (images[0].width, images[0].height, len(images), mean, gradient, *read, len(raw), hashlib.sha256(raw).hexdigest(), None)
        return own + ((thumbs[0].tobytes(),) if with_thumbnail else ())

    def one(raw: bytes | None) -> tuple:
        try:
            images, thumbs = next(read_media([raw or b""]))
            return row(raw, images, thumbs)
        except (ValueError, IndexError, KeyError) as e:
            return (None,) * 8 + (len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), str(e) or type(e).__name__) + ((None,) if with_thumbnail else ())

    names = [c.split()[0] for c in FEATURES.split(", ")] + ["thumbnail"] * with_thumbnail
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_thumbnail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            for lo, hi in _groups([len(r or b"") for r in raw]):
                try:
                    rows = [row(r, *x) for r, x in zip(raw[lo:hi], read_media(raw[lo:hi]), strict=True)]
                except (ValueError, IndexError, KeyError, TypeError):
                    rows = [one(r) for r in raw[lo:hi]]
                columns = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)]
                columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES + ", thumbnail binary" * with_thumbnail)


def op5_media(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm.common import documents

    found = media_features(text_media(documents(spark, sf_dir)))
    feature = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("x"), F.col("n_images").cast("string"), F.lit(":"), "mean_hash", F.lit(":"), "gradient_hash")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
