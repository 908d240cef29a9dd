"""Record tables that jobs replace while they read them.

A commit writes each new table to a folder of its own, beside the old one, and then moves a small file that names every table's folder over the file before it, by one rename. Whatever fails before
the rename leaves all tables as they were, and readers see the tables of one commit together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.shared import exists


class RecordStore:
    """Tables below one folder: <table>/<id>/part-*.parquet, and `current`, which names the id of each table. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> dict[str, str]:
        """The current folder of each table, below the store's."""
        if not exists(self.spark, f"{self.folder}/current"):
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/current", wholetext=True).first()[0])

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """The table as of now, whatever is committed later; no rows of the schema for one that was never written."""
        at = self.folders().get(table)
        if at is None:
            return self.spark.createDataFrame([], schema or "")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{at}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Replaces these tables at once; the others stay. The frames may read the tables that they replace."""
        named = self.folders()
        for table, df in tables.items():
            named[table] = f"{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{named[table]}")
        self._point(json.dumps(named))

    def _point(self, text: str) -> None:
        jvm, new = self.spark._jvm, f"current-{uuid.uuid4().hex}"
        out = self._system().create(self._path(new), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path("current"), how)

    def vacuum(self) -> int:
        """Deletes folders and files that `current` doesn't name, left by older commits and by those that failed; their number. Not while others read or write."""
        named, gone = set(self.folders().values()), []
        for entry in self._system().listStatus(self._path("")):
            name = entry.getPath().getName()
            if not entry.isDirectory():
                gone += [name] if name.startswith("current-") else []
            elif not name.startswith((".", "_")):
                gone += [at for s in self._system().listStatus(entry.getPath()) if (at := f"{name}/{s.getPath().getName()}") not in named]
        for name in gone:
            self._system().delete(self._path(name), True)
        return len(gone)
