"""Exact deduplication over a log-structured merge index of digests. DataFrame operations only.

Rows are hashed once into a log. Slices of the log are memtables: each is reduced to one entry per digest (smallest identifier, number of
rows) by map-side combining, and flushed as a run that is sorted and bucketed by digest, with a filter of its digests. A flush looks its
digests up in the older runs: those that a run's filter lets pass are joined with the run, bucket by bucket. What repeats in a memtable or is found in an older run is
a hit. When a level has `fan` runs, compaction merges them, bucket by bucket and without a shuffle, into one run of the next level and keeps
the smallest identifier of each digest. Hits are verified on the bytes: the texts' binary minimum and maximum must be the same string.
Digests that fail are resolved by grouping on digest and text together.

Size: buckets and memtables grow with the number of rows, so that a bucket of the last run has some `BUCKET_ROWS` entries and a memtable
`MEMTABLE_ROWS` rows. Runs that were merged are deleted, and a call leaves no table in the catalogue.

Skew: every grouping combines on the map side, so a text that a third of the rows share arrives as one row a task. Rows without a hit stay where they are; the
join of the others to their entry may be split by adaptive skew handling.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import KeyFilter, Scratch, ascii_lower, delete, quoted

#: Entries that a bucket of all rows' run should have, and the least number of buckets; Spark allows no more than MOST_BUCKETS.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 16, 100_000
#: Rows of a memtable, and the least number of memtables.
MEMTABLE_ROWS, LEAST_MEMTABLES = 1 << 30, 4


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The number of buckets for an index of so many rows."""
    return min(max(LEAST_BUCKETS, -(-rows // bucket_rows)), MOST_BUCKETS)


def memtables_for(rows: int, memtable_rows: int = MEMTABLE_ROWS) -> int:
    return max(LEAST_MEMTABLES, -(-rows // memtable_rows))


class Run(NamedTuple):
    name: str
    table: str
    level: int
    entries: DataFrame
    known: KeyFilter


class DigestIndex:
    """Runs of (digest, ident, copies) in levels below one folder, which can be opened again by another session.

    A run is a Parquet table sorted and bucketed by digest; beside it is its filter. `buckets` is fixed when the index is made, and
    bounds how much of a run one task merges or probes: take `buckets_for` the rows that the index is to hold.

    A merge deletes the runs that it has read, but for those that the stored index names: they go when `save` has named the new ones. So what
    `lookup` and `entries` return is to be used before the next `add`. Runs are tables of the session's catalogue until `close`.
    """

    SCHEMA = "digest BINARY, ident BIGINT, copies BIGINT"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, fan: int = 4):
        self.spark, self.folder, self.buckets, self.fan = spark, folder, buckets, fan
        self.runs: list[Run] = []  # oldest first
        self.saved: set[str] = set()  # runs that the stored index names
        self.merged: list[Run] = []  # those of them that later runs have replaced

    @classmethod
    def opened(cls, spark: SparkSession, folder: str) -> DigestIndex:
        """The index that `save` described."""
        head = spark.read.json(f"{folder}/head").first()
        index = cls(spark, folder, head["buckets"], head["fan"])
        for r in head["runs"] or []:
            table = f"quarry_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {table} ({cls.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS LOCATION '{folder}/{r['run']}'")
            known = KeyFilter.opened(spark.read.parquet(f"{folder}/{r['run']}-filter"), r["bits"])
            index.runs.append(Run(r["run"], table, r["level"], spark.table(table), known))
        index.saved = {r.name for r in index.runs}
        return index

    def save(self) -> None:
        """Writes what `opened` reads; runs that compaction has merged are not part of it, and are deleted."""
        rows = [(r.level, r.name, r.known.bits) for r in self.runs]
        one = self.spark.createDataFrame([(self.buckets, self.fan, rows)], "buckets int, fan int, runs array<struct<level:int,run:string,bits:long>>")
        one.write.mode("overwrite").json(f"{self.folder}/head")
        self.saved = {r.name for r in self.runs}
        for run in self.merged:
            self._delete(run)
        self.merged = []

    def close(self) -> None:
        """Takes the runs' tables out of the session's catalogue; their files stay."""
        for run in self.runs + self.merged:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")

    def discard(self) -> None:
        """Closes the index and deletes its folder."""
        self.close()
        delete(self.spark, self.folder)

    def _delete(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")  # an external table: its files are not touched by that
        delete(self.spark, f"{self.folder}/{run.name}")
        delete(self.spark, f"{self.folder}/{run.name}-filter")

    def _store(self, entries: DataFrame, level: int) -> Run:
        name = f"run-{uuid.uuid4().hex}"
        table = f"quarry_{name.replace('-', '_')}"
        dealt = entries.repartition(self.buckets, "digest") if level == 0 else entries
        dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.folder}/{name}").saveAsTable(table)
        stored = self.spark.table(table)
        known = KeyFilter(stored.select("digest"), "digest", stored.count()).stored(lambda maps: self._written(maps, f"{name}-filter"))
        return Run(name, table, level, stored, known)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The rows of digests (one column) that some run has: those that its filter lets pass, joined with the run."""
        found = digests.where("false")
        for run in self.runs:
            found = found.unionByName(run.known.apply(digests, "digest").join(run.entries.select("digest"), "digest", "left_semi"))
        return found

    def add(self, log: DataFrame) -> DataFrame:
        """Flushes a memtable (rows ident, digest); the digests that were hit by it: repeated in it or found in an older run."""
        run = self._store(log.groupBy("digest").agg(F.min("ident").alias("ident"), F.count(F.lit(1)).alias("copies")), 0)
        hits = run.entries.where("copies > 1").select("digest").unionByName(self.lookup(run.entries.select("digest")))
        self.runs.append(run)
        hits = self._written(hits.distinct(), f"hits-{uuid.uuid4().hex}")
        while len(last := [r for r in self.runs if r.level == self.runs[-1].level]) >= self.fan:
            self._merge(len(last))
        return hits

    def _merge(self, n: int) -> None:
        """The last n runs as one of the next level."""
        last = self.runs[-n:]
        merged = functools.reduce(_joined, (r.entries for r in last))
        self.runs[-n:] = [self._store(merged, max(r.level for r in last) + 1)]
        for run in last:
            self.merged.append(run) if run.name in self.saved else self._delete(run)

    def entries(self) -> DataFrame:
        """One entry per digest, after merging all runs into one."""
        if len(self.runs) > 1:
            self._merge(len(self.runs))
        return self.runs[0].entries if self.runs else self.spark.createDataFrame([], self.SCHEMA)


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs merged in order of their digests: the smaller identifier, the sum of the copies. Both are sorted and bucketed alike, so nothing is shuffled."""
    other = b.select("digest", F.col("ident").alias("ident_b"), F.col("copies").alias("copies_b"))
    both = a.hint("merge").join(other.hint("merge"), "digest", "full_outer")
    zero = F.lit(0).cast("long")
    return both.select("digest", F.least("ident", "ident_b").alias("ident"), (F.coalesce("copies", zero) + F.coalesce("copies_b", zero)).alias("copies"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    memtables: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each input row, those that are dropped included.

    Texts are equal when their normalised bytes are equal; a null text counts as empty. The row with the largest
    (or smallest) id stays. Rows with a null id are counted in their group, but only stay if it has no other ids.
    Rows that repeat an id with the same text stay or go together. An empty table gives an empty result; other columns
    of the input, whatever their names, are not looked at. Nothing is read by prefix: a text is hashed and compared whole.
    Where `memtables` and `buckets` are not given, they follow from the number of rows.
    """
    spark, scratch, sign = docs.sparkSession, Scratch(docs.sparkSession, "exact"), -1 if keep == "largest" else 1
    rows = docs.select((F.col(quoted(id_col)).cast("long") * sign).alias("ident"), normalise(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("norm"))
    n = docs.count() if memtables is None or buckets is None else 0
    memtables, buckets = memtables or memtables_for(n), buckets or buckets_for(n)
    memtable = F.pmod(F.xxhash64("ident"), F.lit(memtables)).cast("int").alias("memtable")
    log = scratch.write(rows.select("ident", digest(F.col("norm")).alias("digest"), memtable), "log", "memtable")
    index, hits = DigestIndex(spark, f"{scratch.path}/index", buckets), None
    for k in range(memtables):
        found = index.add(log.where(F.col("memtable") == k).select("ident", "digest"))
        hits = found if hits is None else hits.unionByName(found)
    entries = index.entries().withColumnRenamed("ident", "first")
    hit = scratch.write(entries.join(hits.distinct(), "digest", "left_semi"), "hit")
    index.discard()
    n_hits = hit.count()
    known = KeyFilter(hit.select("digest"), "digest", n_hits)
    hashed = rows.withColumn("digest", digest(F.col("norm")))
    clashes = known.apply(hashed, "digest").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")
    clash = scratch.write(clashes, "clashes")
    maybe, alone = known.split(log.select("ident", "digest"), "digest")
    found = maybe.join(hit, "digest", "left").select("ident", "digest", F.when(F.col("copies").isNull(), F.col("ident")).otherwise(F.col("first")).alias("first"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    found = found.unionByName(alone.select("ident", "digest", F.col("ident").alias("first"), F.lit(1).cast("long").alias("copies")))
    if not clash.isEmpty():
        exact = scratch.write(hashed.join(clash, "digest", "left_semi"), "clash_rows")
        by_text = exact.groupBy("digest", "norm").agg(F.min("ident").alias("first"), F.count(F.lit(1)).alias("copies"))
        split = exact.join(by_text, ["digest", "norm"]).select("ident", "digest", "first", "copies")
        found = found.join(clash, "digest", "left_anti").unionByName(split)
    return found.select(
        (F.col("ident") * sign).alias("doc_id"),
        (F.col("first") * sign).alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("ident").eqNullSafe(F.col("first")).alias("kept"),
        "digest",
    )


def drop_known(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """docs, with all its columns, without the rows whose text's digest the index has from earlier batches; then the batch itself is added to the index.

    Texts of earlier batches aren't kept, so what they hit is by SHA-256 alone. Copies within the batch stay: see keep_one.
    """
    own = f"_digest_{uuid.uuid4().hex}"
    scratch = Scratch(docs.sparkSession, "known")
    hashed = docs.withColumn(own, sha256(normalise(F.coalesce(F.col(quoted(text_col)), F.lit("")))))
    found = scratch.write(index.lookup(hashed.select(F.col(own).alias("digest")).distinct()).distinct().withColumnRenamed("digest", own), "found")
    maybe, rest = KeyFilter(found, own, found.count()).split(hashed, own)
    left = scratch.write(rest.unionByName(maybe.join(found, own, "left_anti")).drop(own), "left")
    index.add(hashed.select(F.col(quoted(id_col)).cast("long").alias("ident"), F.col(own).alias("digest")))
    return left


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs, with all its columns, without the rows whose text another row has that stays; of rows that repeat an id with one text, one stays."""
    scratch, mark = Scratch(docs.sparkSession, "keep-one"), uuid.uuid4().hex
    ident, own, gone, gone_digest = (f"_{name}_{mark}" for name in ("ident", "digest", "gone", "gone_digest"))  # names that docs doesn't have
    found = exact_duplicates(docs, id_col, text_col, keep).select(F.col("doc_id").alias(ident), F.col("digest").alias(own), "kept")
    found = scratch.write(found, "found")
    dropped = found.where("not kept").select(ident, own).distinct()
    repeated = found.where("kept").groupBy(ident, own).count().where("count > 1").select(ident)
    touched = scratch.write(dropped.select(ident).union(repeated).distinct(), "touched")
    maybe, rest = KeyFilter(touched, ident, touched.count()).split(docs.withColumn(ident, F.col(quoted(id_col)).cast("long")), ident)
    maybe = maybe.withColumn(own, sha256(ascii_lower(F.coalesce(F.col(quoted(text_col)), F.lit("")))))
    out = dropped.select(F.col(ident).alias(gone), F.col(own).alias(gone_digest))
    left = maybe.join(out, F.col(ident).eqNullSafe(F.col(gone)) & (F.col(own) == F.col(gone_digest)), "left_anti")
    return rest.drop(ident).unionByName(left.dropDuplicates([ident, own]).drop(ident, own))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
