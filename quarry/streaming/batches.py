"""Results of a stream's batches: written under the batch's id, published by a marker, folded now and then.

A stream's folder outlives the call that made it: it holds the checkpoint and the log, so a later call goes on with the files that are new. A batch that runs again after a failure has the
id it had before: if it was published, nothing is written; if not, what it left is overwritten and nobody has read it. All tables of a batch are published by one marker, so
they change together or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.shared import exists, new_folder

Tables = dict[str, DataFrame]


class BatchLog:
    """Tables of published batches below one folder: batch-<id>/<table>, fold-<id>/<table> and markers of the same names in _published.

    A fold holds what its merge made of all batches up to its id, so reading costs one fold and the batches after it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[int]:
        if not exists(self.spark, f"{self.folder}/_published"):
            return []
        names = [s.getPath().getName() for s in self._system().listStatus(self._path("_published"))]
        return sorted(int(n.removeprefix(f"{kind}-")) for n in names if n.startswith(f"{kind}-"))

    def batches(self) -> list[int]:
        """Ids of the published batches that no fold has taken in."""
        done = self.folded()
        return [k for k in self._marked("batch") if k > done]

    def folded(self) -> int:
        """The id up to which batches are folded; -1 if none is."""
        return max(self._marked("fold"), default=-1)

    def last(self) -> int:
        return max([self.folded(), *self._marked("batch")])

    def _put(self, name: str, tables: Tables) -> None:
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{table}")
        self._system().create(self._path(f"_published/{name}"), True).close()  # an empty file: there or not there

    def publish(self, batch: int, tables: Callable[[], Tables]) -> bool:
        """Writes and publishes a batch's tables; False, without calling for them, if it was published before."""
        if batch <= self.folded() or batch in self._marked("batch"):
            return False
        self._put(f"batch-{batch}", tables())
        return True

    def read(self, table: str, schema: StructType | str | None = None) -> DataFrame:
        """The table's rows of all published batches, with the column `batch`; a table that no batch has has no rows of the schema."""
        done = self.folded()
        parts = [(done, f"fold-{done}")] if done >= 0 else []
        parts += [(k, f"batch-{k}") for k in self.batches()]
        if not parts:
            return self.spark.createDataFrame([], schema or "batch long").withColumn("batch", F.lit(0).cast("long"))
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(*[f"{self.folder}/{name}/{table}" for _, name in parts])
        return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), rf"/(?:batch|fold)-(\d+)/{table}/[^/]*\z", 1).cast("long"))

    def fold(self, merges: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Takes all published batches into one fold, table by table, and deletes what an older fold held. merges get the rows with `batch` and give the table without it."""
        last, before = self.last(), self.folded()
        if last <= before:
            return
        self._put(f"fold-{last}", {table: merge(self.read(table)).drop("batch") for table, merge in merges.items()})
        # folders that only readers of the fold before this one still need stay until the next fold
        for k in [x for x in self._marked("batch") if x <= before]:
            self._system().delete(self._path(f"_published/batch-{k}"), False)
            self._system().delete(self._path(f"batch-{k}"), True)
        for k in [x for x in self._marked("fold") if x < before]:
            self._system().delete(self._path(f"_published/fold-{k}"), False)
            self._system().delete(self._path(f"fold-{k}"), True)


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Files that arrive below path, as a stream; path may also be one file. At most so many files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm).isDirectory()
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path) if is_dir else reader.option("pathGlobFilter", name).parquet(folder)


def follow(
    rows: DataFrame,
    folder: str,
    tables: Callable[[DataFrame], Tables],
    mode: str = "append",
    merges: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    fold_every: int = 16,
) -> BatchLog:
    """Runs a stream over what is there and not yet read, and publishes the tables that each batch gives; the log below folder, which has all batches so far.

    With merges, batches are folded when so many have gathered.
    """
    spark = rows.sparkSession
    log = BatchLog(spark, f"{folder}/log")

    def keep(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            log.publish(batch, lambda: tables(df))
        finally:
            df.unpersist()
        if merges and len(log.batches()) >= fold_every:
            log.fold(merges)

    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return log


def result(rows: DataFrame, mode: str, folder: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """What a streaming query has given by now, over all calls with this folder: the last batch (complete), all batches (append), or the last row of each of `keys` (update)."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    log = follow(rows, folder or new_folder(rows.sparkSession, "stream"), lambda df: {"out": df}, mode)
    found, columns = log.read("out", rows.schema), rows.columns
    if mode == "complete":
        return found.where(F.col("batch") == log.last()).select(*columns)
    if mode == "append":
        return found.select(*columns)
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_last"))
    return last.select("_last.*")
