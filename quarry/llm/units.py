"""Cached encoding: a text is cut where no token can cross, and each distinct unit is encoded once per worker.

A unit is a stretch that the tokenizer's own pre-tokenizer never joins to its neighbours: a word with the space before
it, a line break, or (for tokenizers that drop white space) a word. Texts whose white space does not allow that cut take
the tokenizer's whole-text path. Ids are kept as packed little-endian integers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

import numpy as np
import regex

from quarry.llm.common import resident

#: Fixed value: the published pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and line feed.
OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]
MOST_UNITS, MOST_PIECES = 700_000, 300_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def byte_units(text: str, specials: Iterable[str] = ()) -> list[str] | None:
    """Units of a byte-level tokenizer with PATTERN; None if white space or a special token forbids the cut."""
    if "\0" in text or any(c in text for c in (OTHER_SPACE[:8] if text.isascii() else OTHER_SPACE)):
        return None
    if any(r in text for r in RUNS) or text[-2:].isspace() and len(text) > 1 or any(s in text for s in specials):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Cache(dict):
    """Unit to packed ids; emptied when it has grown to `most` units, so memory is bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = made = self.make(key)
        return made


class ByteEncoder:
    """Byte-level BPE by a function from pre-token to ids."""

    def __init__(self, piece: Callable[[str], list[int]], dtype: str, specials: dict[str, int], most_units: int = MOST_UNITS, most_pieces: int = MOST_PIECES):
        self.dtype, self.find, self.specials = np.dtype(dtype), regex.compile(PATTERN).findall, specials
        self.pieces = Cache(lambda p: np.array(piece(p), self.dtype).tobytes(), most_pieces)
        self.units = Cache(self._unit, most_units)
        self.units[""] = b""
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _unit(self, unit: str) -> bytes:
        if unit.isalpha() or unit[:1] == " " and unit[1:].isalpha():
            return self.pieces[unit]
        return b"".join([self.pieces[p] for p in self.find(unit)])

    def packed(self, text: str) -> bytes:
        units = byte_units(text, self.specials)
        if units is not None:
            return b"".join(map(self.units.__getitem__, units))
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(np.array([self.specials[p]], self.dtype).tobytes() if k % 2 else b"".join([self.pieces[x] for x in self.find(p)]) for k, p in enumerate(parts))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


class WordEncoder:
    """A tokenizer of the tokenizers library that drops white space: words are encoded alone.

    A word of Latin letters, with punctuation behind it or not, goes straight to the library's BPE model as the
    configured normaliser and splitter would hand it over; any other word goes through the library's whole path.
    """

    def __init__(self, tok, dtype: str):
        self.dtype, self.tok, self.model = np.dtype(dtype), tok, tok.model
        self.shape = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,./:;?@|()=-]*)").fullmatch
        self.table = str.maketrans({b: c for b, c in enumerate(byte_chars())})
        self.pieces = Cache(self._piece, MOST_PIECES)
        self.words = Cache(self._word, MOST_UNITS)

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece.lower().encode().decode("latin1").translate(self.table))], self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if m := self.shape(word):
            return self.pieces[m[1].lower()] + (self.pieces[m[2]] if m[2] else b"")
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def packed(self, text: str) -> bytes:
        if not text.isascii() and any("̀" <= c <= "ͯ" for c in set(text)):  # a mark may compose across the cut
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


class WholeEncoder:
    """Any other tokenizer: whole texts, no cutting."""

    def __init__(self, tok, dtype: str):
        self.tok, self.dtype = tok, np.dtype(dtype)

    def packed(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


def id_type(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def library_encoder(path: str):
    """The encoder of a tokenizers file, made once per worker."""
    return resident(f"encoder {path}", lambda: _library_encoder(path))


def _library_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    dtype = id_type(tok.get_vocab_size())
    pre = json.dumps(conf.get("pre_tokenizer") or {})
    specials = {t["content"]: t["id"] for t in conf["added_tokens"]}
    bpe = conf["model"].get("type") == "BPE" and not conf["model"].get("ignore_merges")
    if bpe and conf["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not conf["normalizer"]:
        table, model = str.maketrans({b: c for b, c in enumerate(byte_chars())}), tok.model
        return ByteEncoder(lambda p: [t.id for t in model.tokenize(p.encode().decode("latin1").translate(table))], dtype, specials)
    if bpe and conf["normalizer"] == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]} and '"behavior": "Removed", "invert": true' in pre:
        return WordEncoder(tok, dtype)
    return WholeEncoder(tok, dtype)
