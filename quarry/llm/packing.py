"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenises its documents, cuts long ones into pieces and packs chunks of pieces by best fit, longest first.
Bins that are nearly full are final. The others go up a tree as items: each round, the underfull bins of `fan_in`
neighbouring nodes are packed by best fit into parent bins, until one node is left. A node passes on at most `most_open`
bins, the emptiest; what it holds beyond that is final as it is, so no task's input grows with the table and every piece
is placed. Pieces are written once, before any bin is moved; a bin's moves are joined to its pieces at the end.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, text_slices
from quarry.llm.units import library_encoder

#: Pieces that a task packs at once.
CHUNK = 16384
#: Pieces that a task hands over at once.
SENT = 1024


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Longest first, each into the fullest bin that has room. Bin and offset of each item; fill of each bin."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    sizes: list[int] = []  # free sizes that some open bin has, sorted
    by_free: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        k = bisect_left(sizes, need)
        if k < len(sizes):
            free = sizes[k]
            b = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], sizes[k]
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        if left := free - need:
            if left not in by_free:
                by_free[left] = []
                insort(sizes, left)
            by_free[left].append(b)
    return bins, offsets, fills


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their ids and their place in a local bin; bin_fill only at the bin's first piece."""

    def packed(rows: list[tuple], task: int, made: int) -> tuple[pa.RecordBatch, int]:
        lengths = [r[3] for r in rows]
        bins, offsets, fills = best_fit(lengths, capacity)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        columns += [pa.array([(task << 32) + made + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
        columns.append(pa.array([fills[b] if o == 0 else None for b, o in zip(bins, offsets, strict=True)], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, [*names, "bin", "offset", "bin_fill"]), made + len(fills)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = library_encoder(tokenizer), TaskContext.get().partitionId()
        rows: list[tuple] = []
        made, width, end = 0, enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.packed(text or "") + end
                n, start, piece = len(ids) // width, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    part = ids[start * width : (start + length) * width]
                    crc = zlib.crc32(np.frombuffer(part, enc.dtype).astype("<u4").tobytes())
                    rows.append((doc_id, piece, start, length, crc, part))
                    start, piece = start + length, piece + 1
                if len(rows) >= CHUNK:
                    out, made = packed(rows, task, made)
                    rows = []
                    yield from text_slices([out], 5, SENT)
        if rows:
            yield from text_slices([packed(rows, task, made)[0]], 5, SENT)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, offset long, bin_fill long"
    )


def merge_residuals(scratch: Scratch, open_bins: DataFrame, capacity: int, full: int, fan_in: int, most_open: int) -> DataFrame | None:
    """bin, into, shift: where the bins (bin, fill) of the leaves end up; None if there are none."""
    moves, level = None, 0
    items = scratch.write(open_bins.select("bin", "fill", (F.col("bin") / (1 << 32)).cast("long").alias("node")), "open0")
    while True:
        top = items.agg(F.max("node")).first()[0]
        if top is None:
            return moves
        nodes = items.withColumn("node", F.floor(F.col("node") / fan_in))

        def node(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin", ignore_index=True)
            bins, offsets, fills = best_fit(pdf["fill"].tolist(), capacity)
            first: dict[int, int] = {}
            into = [first.setdefault(b, int(x)) for b, x in zip(bins, pdf["bin"], strict=True)]
            fill = [fills[b] for b in bins]
            left = sorted({b for b in range(len(fills)) if fills[b] < full}, key=lambda b: fills[b])[:most_open]
            keep = set(left)
            return pd.DataFrame({"bin": pdf["bin"], "into": into, "shift": offsets, "fill": fill, "open": [b in keep and o == 0 for b, o in zip(bins, offsets, strict=True)], "node": pdf["node"]})

        level += 1
        done = scratch.write(nodes.groupBy("node").applyInPandas(node, "bin long, into long, shift long, fill long, open boolean, node long"), f"moves{level}")
        step = done.select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
            joined = moves.join(later, "into", "left").select("bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
            moves = scratch.write(joined, f"path{level}")
        if top < fan_in:
            return moves
        items = scratch.write(done.where("open").select(F.col("into").alias("bin"), "fill", "node"), f"open{level}")


def best_fit_packing(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: int = 8,
    fan_in: int = 16,
    most_open: int = 4096,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: one row per piece.

    A document is its ids and then end_id; one longer than capacity is cut so that only its first piece is shorter. A null
    text is empty and has the end id alone. Rows that repeat an id are packed as documents of their own (their pieces
    repeat doc_id and piece); rows with a null id are packed too. An empty table gives no rows. Other columns are not read.
    A bin within `slack` tokens of capacity counts as nearly full.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    open_bins = pieces.where(f"bin_fill < {capacity - slack}").select("bin", F.col("bin_fill").alias("fill"))
    moves = merge_residuals(scratch, open_bins, capacity, capacity - slack, fan_in, most_open)
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    if moves is None:
        return pieces.select(*own, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moves, "bin", "left").select(
        *own, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, doc_ids: the packed sequences themselves, ids in the pieces' integer width."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens")).select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import documents

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
