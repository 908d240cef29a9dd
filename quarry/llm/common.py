"""What the operators of this subpackage share: the shared folder, written intermediate tables, key filters."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP = 32768


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """A new folder for one call's intermediate tables.

    Tables are written rather than kept by executors, so a lost executor costs no more than its running tasks,
    and nothing that was numbered by partition is computed a second time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, **options: str) -> DataFrame:
        out = df.write.options(**options)
        (out.partitionBy(partition_by) if partition_by else out).parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read.schema(like.schema) if like is not None else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def trim() -> None:
    """Gives freed memory back to the system, so that one operator's peak isn't kept under the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


_open: dict[str, Any] = {}


def resident(key: str, make: Callable[[], Any]) -> Any:
    """make(), kept in this worker until another key is asked for: what one operator holds doesn't add up with the next one's."""
    if _open.get("key") != key:
        _open.clear()
        trim()
        _open["thing"] = make()
        _open["key"] = key
    return _open["thing"]


def packed(thing: Any) -> bytes:
    return zlib.compress(pickle.dumps(thing, 5), 1)


def unpacked(raw: bytes) -> Any:
    return pickle.loads(zlib.decompress(raw))


class Sent:
    """A broadcast of an object as packed bytes, which workers open through `resident`; so one model at a time is held open."""

    def __init__(self, spark: SparkSession, thing: Any):
        self.key, self.raw = uuid.uuid4().hex, spark.sparkContext.broadcast(packed(thing))

    @classmethod
    def packed(cls, spark: SparkSession, raw: bytes) -> Sent:
        """Of what `packed` has made."""
        own = object.__new__(cls)
        own.key, own.raw = uuid.uuid4().hex, spark.sparkContext.broadcast(raw)
        return own

    def open(self, make: Callable[[Any], Any] = lambda x: x) -> Any:
        """make(the object), once per worker and stay."""
        return resident(self.key, lambda: make(unpacked(self.raw.value)))

    def again(self) -> Sent:
        """The same broadcast under another key, to open with another `make`."""
        other = object.__new__(Sent)
        other.key, other.raw = uuid.uuid4().hex, self.raw
        return other

    def destroy(self) -> None:
        self.raw.destroy()


class KeyFilter:
    """A one-hash Bloom filter of the long or binary keys of a table, as bitmaps that Spark's own functions build and test.

    It lets every key of the table pass and few others, so a later exact join meets a small input. It has at most `most_bits` bits (16 MB
    by default), whatever the number of keys, so it can be broadcast; beyond some 10^8 keys most rows pass, which costs time but no row.
    Integer keys of any width are compared as long.
    """

    def __init__(self, keys: DataFrame, key: str, n_keys: int, most_bits: int = 1 << 27):
        bits = 1 << 18
        while bits < 16 * n_keys and bits < most_bits:
            bits *= 2
        self._named(bits)
        place = self._place(_comparable(keys, key))
        self.maps = (
            keys.where(F.col(quoted(key)).isNotNull())
            .select(F.bitmap_bucket_number(place).alias(f"{self.own}_bucket"), F.bitmap_bit_position(place).alias("bit"))
            .groupBy(f"{self.own}_bucket")
            .agg(F.bitmap_construct_agg("bit").alias(f"{self.own}_map"))
        )

    def _named(self, bits: int) -> None:
        self.bits, self.own = bits, f"_filter_{uuid.uuid4().hex}"  # a name that no column of a user has

    def stored(self, write: Callable[[DataFrame], DataFrame]) -> KeyFilter:
        """The same filter over its written bitmaps: write takes and returns (bucket, map)."""
        kept, own = write(self.maps.toDF("bucket", "map")), object.__new__(KeyFilter)
        own._named(self.bits)
        own.maps = kept.toDF(f"{own.own}_bucket", f"{own.own}_map")
        return own

    @classmethod
    def opened(cls, maps: DataFrame, bits: int) -> KeyFilter:
        own = object.__new__(cls)
        own._named(bits)
        own.maps = maps.select("bucket", "map").toDF(f"{own.own}_bucket", f"{own.own}_map")
        return own

    def _place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)) + F.lit(1)

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of df whose key may be in the table."""
        return self._tested(df, key).where(self.own).select(*map(quoted, df.columns))

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose key may be in the table or is null, and the others."""
        tested, may, own = self._tested(df, key), F.coalesce(self.own, F.lit(False)) | F.col(quoted(key)).isNull(), [*map(quoted, df.columns)]
        return tested.where(may).select(*own), tested.where(~may).select(*own)

    def _tested(self, df: DataFrame, key: str) -> DataFrame:
        place = self._place(_comparable(df, key))
        bit = F.bitmap_bit_position(place)
        byte = F.substring(F.col(f"{self.own}_map"), (bit / 8).cast("int") + 1, F.lit(1))
        is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1
        placed = df.withColumn(f"{self.own}_bucket", F.bitmap_bucket_number(place))
        return placed.join(F.broadcast(self.maps), f"{self.own}_bucket", "left").withColumn(self.own, is_set)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _comparable(df: DataFrame, key: str) -> Column:
    return F.col(quoted(key)).cast("long") if df.schema[key].dataType.typeName() in ("byte", "short", "integer") else F.col(quoted(key))


def without_rows(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not in `dropped` (one column, of that name). Rows with a null key stay.

    Only rows that a filter of bounded size lets pass are shuffled; the others, with their texts, stay where they are.
    """
    maybe, rest = KeyFilter(dropped, key, dropped.count()).split(docs, key)
    own = f"_gone_{uuid.uuid4().hex}"
    return rest.unionByName(maybe.join(dropped.select(F.col(key).alias(own)), F.col(quoted(key)) == F.col(own), "left_anti"))


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, in slices of at most so many rows and, but for a longer single text, so many bytes of text in the column."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False) if b.num_rows else np.zeros(0)
        lo, held = 0, 0
        for k, n in enumerate(size.tolist()):
            if k > lo and (k - lo >= rows or held + n > chars):
                yield b.slice(lo, k - lo)
                lo, held = k, 0
            held += n
        if lo < b.num_rows:
            yield b.slice(lo)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of consecutive rows with equal first n_keys columns, for batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = tuple(k[lo].item() for k in keys)
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def sum_slices(df: DataFrame, dtype: str, compressed: bool = False) -> dict[int, np.ndarray]:
    """Sums, on the driver, the arrays of each slice in the rows (part int, slice int, counts binary of dtype, by zlib if compressed).

    Rows are added as they stream by, first per slice and group of parts, then per slice, so no task holds more than
    two arrays. The caller bounds the number of slices and their length.
    """

    def add(n_keys: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, np.zeros(0, np.int64)

            def out() -> pa.RecordBatch:
                names = ["salt", "slice", "counts"]
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1) if compressed and n_keys == 2 else total.tobytes()], pa.binary())], names)

            for b in batches:
                for salt, part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if (salt, part) != key:
                        if key is not None:
                            yield out()
                        key, total = (salt, part), np.zeros(0, np.int64)
                    own = zlib.decompress(raw.as_buffer()) if compressed else raw.as_buffer()
                    counts = np.frombuffer(own, dtype if n_keys == 2 else "<i8")
                    if len(counts) > len(total):
                        total = np.pad(total, (0, len(counts) - len(total)))
                    total[: len(counts)] += counts
            if key is not None:
                yield out()

        return run

    schema = "salt int, slice int, counts binary"
    rows = df.select((F.col("part") % 64).cast("int").alias("salt"), F.col("slice").cast("int"), "counts")
    some = rows.repartition("salt", "slice").sortWithinPartitions("salt", "slice").mapInArrow(add(2), schema)
    all_ = some.select(F.lit(0).alias("salt"), "slice", "counts").repartition("slice").sortWithinPartitions("slice").mapInArrow(add(1), schema)
    return {r["slice"]: np.frombuffer(r["counts"], "<i8") for r in all_.collect()}


def mean_slices(df: DataFrame) -> dict[int, np.ndarray]:
    """Means by weight, on the driver, of the arrays of each slice in the rows (part int, slice int, weight long, values binary of 32-bit floats).

    Rows are added in order of parts, first per slice and group of parts, so the means do not depend on the order in which tasks end. The caller
    bounds the number of slices and their length.
    """

    def add(dtype: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, weight, total = None, 0, np.zeros(0)

            def out() -> pa.RecordBatch:
                columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, ["salt", "slice", "weight", "values"])

            for b in batches:
                for salt, part, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                    values = np.frombuffer(raw.as_buffer(), dtype).astype(np.float64)
                    if (salt, part) != key:
                        if key is not None:
                            yield out()
                        key, weight, total = (salt, part), n, values if dtype == "<f8" else values * n
                    else:
                        weight, total = weight + n, total + (values if dtype == "<f8" else values * n)
            if key is not None:
                yield out()

        return run

    schema = "salt int, slice int, weight long, values binary"
    rows = df.select((F.col("part") % 64).cast("int").alias("salt"), F.col("slice").cast("int"), F.col("part").alias("place"), "weight", "values")
    some = rows.repartition("salt", "slice").sortWithinPartitions("salt", "slice", "place").mapInArrow(add("<f4"), schema)
    rows = some.select(F.lit(0).alias("salt"), "slice", F.col("salt").alias("place"), "weight", "values")
    all_ = rows.repartition("slice").sortWithinPartitions("slice", "place").mapInArrow(add("<f8"), schema)
    return {r["slice"]: np.frombuffer(r["values"], "<f8") / r["weight"] for r in all_.collect()}


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """node, root: the smallest node of each component, for every node of edges (a, b); both long.

    Alternates large-star and small-star steps until the edges no longer change. Each step writes its edges, combines
    on the map side and joins on a node, so a hub is one row per task or a join that may be split.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, step, before = scratch.write(both, f"{name}0"), 0, None
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        step += 1
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        around = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours and itself are linked to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        current = scratch.write(small, f"{name}{step}")
        after = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())
        scratch.drop(f"{name}{step - 1}")
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
