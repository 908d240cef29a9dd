"""Token ids as canonical length-limited Huffman code, decoded by table in independent blocks.

Written: a codebook (id, code length) from the counts of all documents, and segments. A segment holds the ids of
consecutive documents as one bit stream, with the bit offset of every block of `BLOCK` ids as a checkpoint. Each block
decodes alone, so numpy decodes all blocks of many segments in step. Segments lie in Parquet files, so that any
store and committer that Spark knows serves; parts ascend in doc_id, and within a part segments ascend in `start`.

Segment payload, little-endian: 4 bytes b"QHF1"; uint32 documents, uint32 block size, uint64 ids, uint64 bits; per document
int64 doc_id, uint8 whether it is null, uint32 ids; a uint32 bit offset for each block; the bit stream, most significant bit first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, sum_slices
from quarry.llm.units import library_encoder

MAGIC, HEAD, BLOCK = b"QHF1", struct.Struct("<4sIIQQ"), 256
#: Ids after which a segment ends with the document at hand.
SEGMENT = 1 << 18
#: Longest code, unless there are more than 2^16 ids.
LONGEST = 16


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, (len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    n = len(used)
    rows, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):  # from the deepest level up: leaves merged with pairs of the level below
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        rows.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(rows):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = depth
    return lengths


class Code:
    """Canonical codes: shorter first, then ascending ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.longest = int(lengths.max(initial=0))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        sizes = lengths[order].astype(np.int64)
        # in units of the longest code, each code begins where the one before it ends
        spans = np.left_shift(1, self.longest - sizes) if len(order) else np.zeros(0, np.int64)
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = begins >> (self.longest - sizes)
        self.symbol = np.zeros(1 << self.longest, np.uint32)
        self.symbol[: int(spans.sum())] = np.repeat(order, spans)
        self.used = np.zeros(1 << self.longest, np.uint8)
        self.used[: int(spans.sum())] = np.repeat(sizes, spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, int, bytes]:
        """Bit offset of every block, number of bits, bit stream."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        bits = int(ends[-1]) if len(ends) else 0
        wide = self.codes[ids].astype(np.uint64) << (64 - size - (begins & 31)).astype(np.uint64)
        word, n = begins >> 5, bits // 32 + 2
        out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)  # codes don't overlap, so sums are exact
        out[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:-1]
        return begins[::BLOCK].astype(np.uint32), bits, out.astype(">u4").tobytes()[: (bits + 7) // 8]

    def decode(self, stream: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of the blocks that begin at the bits `starts` and have `sizes` ids, one after another."""
        out = np.zeros(int(sizes.sum()), np.uint32)
        if not len(out):
            return out
        raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-4].astype(np.uint64) << np.uint64(32)
        for k in range(1, 5):
            window |= raw[k : len(raw) - 4 + k].astype(np.uint64) << np.uint64(8 * (4 - k))
        order = np.argsort(-sizes, kind="stable")
        at, size = starts[order].astype(np.int64), sizes[order]
        place, live = (np.cumsum(sizes) - sizes)[order], len(order)
        mask, base = (1 << self.longest) - 1, 40 - self.longest
        for step in range(int(size[0])):
            while size[live - 1] <= step:
                live -= 1
            pos = at[:live]
            peek = (window[pos >> 3] >> (base - (pos & 7)).astype(np.uint64)).astype(np.int64) & mask
            out[place[:live] + step] = self.symbol[peek]
            pos += self.used[peek]
        return out


def pack_segment(code: Code, doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    checkpoints, bits, stream = code.encode(ids)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return HEAD.pack(MAGIC, len(doc_ids), BLOCK, len(ids), bits) + known + null + np.array(sizes, "<u4").tobytes() + checkpoints.astype("<u4").tobytes() + stream


def unpack_segment(code: Code, payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, all ids."""
    magic, n_docs, block, n, _ = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = HEAD.size
    known = np.frombuffer(payload, "<i8", n_docs, at)
    null = np.frombuffer(payload, np.uint8, n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(payload, "<u4", n_docs, at := at + n_docs).astype(np.int64)
    n_blocks = -(-n // block)
    checkpoints = np.frombuffer(payload, "<u4", n_blocks, at := at + 4 * n_docs)
    of_block = np.full(n_blocks, block, np.int64)
    if n_blocks:
        of_block[-1] = n - block * (n_blocks - 1)
    ids = code.decode(payload[at + 4 * n_blocks :], checkpoints, of_block)
    return [None if x else int(d) for d, x in zip(known, null, strict=True)], sizes, ids


def _tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents in order within each part, and one row of counts per task and range of 4096 ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = library_encoder(tokenizer), TaskContext.get().partitionId()
        end, total, counts = np.array([end_id], enc.dtype).tobytes(), 0, np.zeros(0, np.int64)
        names = ["part", "doc_id", "local", "n_tokens", "ids", "counts"]
        for b in batches:
            packed = [enc.packed(t or "") + end for t in b.column(1).to_pylist()]
            sizes = np.array([len(p) // enc.dtype.itemsize for p in packed], np.int64)
            new = np.bincount(np.frombuffer(b"".join(packed), enc.dtype))
            counts = np.pad(counts, (0, max(0, len(new) - len(counts))))
            counts[: len(new)] += new
            local = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            n = len(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), b.column(0), pa.array(local), pa.array(sizes), pa.array(packed, pa.binary()), pa.nulls(n, pa.binary())], names
            )
        cuts = [counts[k : k + 4096].astype("<i8").tobytes() for k in range(0, len(counts), 4096)]
        n = len(cuts)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.arange(n)), pa.array(np.full(n, -1)), pa.nulls(n, pa.binary()), pa.array(cuts, pa.binary())], names
            )

    ordered = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids binary, counts binary")


def _sum_counts(table: DataFrame) -> np.ndarray:
    """Counts of all ids: at most 8 bytes for each id of the vocabulary come to the driver."""

    found = sum_slices(table.where("n_tokens = -1").select("part", F.col("local").alias("slice"), "counts"), "<i8")
    total = np.zeros(4096 * (max(found, default=-1) + 1), np.int64)
    for k, a in found.items():
        total[4096 * k : 4096 * k + len(a)] = a
    return total


def write_token_file(
    docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every text and writes codebook and segments below path (any path that Spark can write).

    Documents are in ascending id, null ids first, repeated ids by text. A null text has the end id alone. An empty table gives
    an empty codebook and no segments. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "token-ids")
    table = scratch.write(_tokenise(docs, tokenizer, end_id, id_col, text_col), "ids")
    counts = _sum_counts(table)
    lengths = code_lengths(counts)
    ids = np.flatnonzero(lengths)
    book = spark.createDataFrame(pd.DataFrame({"id": ids.astype(np.int64), "length": lengths[ids].astype(np.int32), "n": counts[ids]}), "id long, length int, n long")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    bases: dict[int, int] = {}
    total = 0
    rows = table.where("n_tokens >= 0")
    for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each task that wrote
        bases[r["part"]], total = total, total + r["n"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc_type = library_encoder(tokenizer).dtype
        code = Code(lengths)
        for b in batches:
            parts, doc_ids, local, sizes = (b.column(k).to_pylist() for k in range(4))
            packed, k, n = b.column(4), 0, b.num_rows
            while k < n:
                j, size = k, 0
                while j < n and parts[j] == parts[k] and local[j] == local[k] + size and (size < SEGMENT):
                    size += sizes[j]
                    j += 1
                ids = np.frombuffer(b"".join(packed.slice(k, j - k).to_pylist()), enc_type)
                payload = pack_segment(code, doc_ids[k:j], sizes[k:j], ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([parts[k]], pa.int32()), pa.array([bases[parts[k]] + local[k]], pa.int64()), pa.array([payload], pa.binary())], ["part", "start", "payload"]
                )
                k = j

    rows.select("part", "doc_id", "local", "n_tokens", "ids").mapInArrow(segments, "part int, start long, payload binary").write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/segments")
    scratch.drop("ids")


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (packed little-endian unsigned 32-bit integers), all decoded from the files."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, sizes, ids = unpack_segment(code, payload.as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                each = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(each, pa.binary())] if with_ids else []), names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    segments = spark.read.schema("start long, payload binary, part int").parquet(f"{path}/segments")
    return segments.select("start", "payload").mapInArrow(run, schema)


def op1_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import documents

    path = Scratch(spark, "token-file").path
    write_token_file(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return read_token_file(spark, path, with_ids=False)
