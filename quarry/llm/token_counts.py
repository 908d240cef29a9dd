"""Token counts of sections, from one encoding of the whole document.

The document is encoded once. Its tokens' spans and its sections' spans, both sorted and measured in UTF-8 bytes, are
joined by interval: a merge by binary search, no pairs. A token that crosses a boundary is allocated by a stated rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import bpe
from quarry.llm.common import resident
from quarry.llm.units import library_encoder

RULES = ("first", "last", "majority")


def line_starts(text: bytes) -> np.ndarray:
    """Start of each line in bytes; a line feed belongs to the line that it ends. An empty text has one empty section."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(text)]]).astype(np.int64)


def attribute(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its boundaries.

    first: a token counts where its first byte lies; last: where its last byte lies; majority: in the section that holds
    most of its bytes, the earliest of equals.
    """
    begins = np.concatenate([[0], token_ends])[:-1].astype(np.int64)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, np.maximum(token_ends - 1, begins), "right") - 1
    place = last if rule == "last" else first
    if rule == "majority" and len(crossing := np.flatnonzero(first != last)):
        place, ends = first.copy(), np.append(starts[1:], size)
        for t in crossing:
            inside = np.arange(first[t], last[t] + 1)
            place[t] = inside[np.argmax(np.minimum(ends[inside], token_ends[t]) - np.maximum(starts[inside], begins[t]))]
    n = len(starts)
    return np.bincount(place, minlength=n), np.bincount(place[first != last], minlength=n)


def section_token_counts(
    docs: DataFrame,
    tokenizer: str,
    rule: str = "first",
    starts: Callable[[bytes], np.ndarray] = line_starts,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, section, start_byte, n_bytes, n_tokens, n_crossing: one row per section of each input row.

    Over a row's sections, n_tokens sums to the tokens of the whole text and n_bytes to its bytes. `starts` gives the
    sections' first bytes, ascending from 0; the default cuts lines. A null or empty text has one section without tokens.
    A token is never divided. Repeated rows and null ids give their own rows; an empty table gives none.
    The tokenizer is byte-level, so that its tokens' strings tile the text.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, widths = resident(f"sections {tokenizer}", lambda: (library_encoder(tokenizer), np.array([len(s) for s in bpe.load(tokenizer).strings], np.int64)))
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                begin = starts(raw)
                counts, crossing = attribute(np.cumsum(widths[enc.ids(text or "")]), begin, len(raw), rule)
                for column, values in zip(out, (np.full(len(begin), 0), np.arange(len(begin)), begin, np.diff(begin, append=len(raw)), counts, crossing), strict=True):
                    column.append(values)
                out[0][-1] = [doc_id] * len(begin)
            if out[0]:
                ids = pa.array([x for xs in out[0] for x in xs], pa.int64())
                rest = [pa.array(np.concatenate(c).astype(np.int32 if k == 0 else np.int64)) for k, c in enumerate(out[1:])]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "section", "start_byte", "n_bytes", "n_tokens", "n_crossing"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(
        run, "doc_id long, section int, start_byte long, n_bytes long, n_tokens long, n_crossing long"
    )


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import documents

    return section_token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
