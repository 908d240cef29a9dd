"""Crawler visits and citation checks, as batch operators and as streams with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.mentions import crawler_of
from quarry.sources.shared import new_folder
from quarry.streaming import batches


def detected(requests: DataFrame) -> DataFrame:
    """The requests (agent and other columns) of known crawlers, with crawler and org."""
    return requests.withColumn("crawler", crawler_of(F.col("agent"))).withColumn("org", crawler_of(F.col("agent"), 2)).where("crawler IS NOT NULL")


def counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("crawler").agg(F.count(F.lit(1)).alias("visits"))


def daily(visits: DataFrame, late: str | None = None) -> DataFrame:
    """day, crawler, visits by event time. `late` is the watermark for streams in append or update mode."""
    visits = visits.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        visits = visits.withWatermark("ts", late)
    return visits.groupBy(F.window("ts", "1 day").alias("w"), "crawler").agg(F.count(F.lit(1)).alias("visits")).select(F.col("w.start").alias("day"), "crawler", "visits")


def daily_aggregates(checks: DataFrame) -> DataFrame:
    """checks: event_id, day, platform, entity, cited. Per day: totals, a map of platforms and the cited entities in order, repeats kept."""
    per = checks.groupBy("day", "platform").agg(F.count(F.lit(1)).alias("checked"), F.count_if("cited").alias("cited"), F.collect_list(F.when(F.col("cited"), F.struct("event_id", "entity"))).alias("found"))
    both = per.groupBy("day").agg(
        F.sum("checked").alias("total_checks"),
        F.sum("cited").alias("citations"),
        F.map_from_entries(F.collect_list(F.struct("platform", F.struct("checked", "cited")))).alias("platforms"),
        F.array_sort(F.flatten(F.collect_list("found")))["entity"].alias("cited_entities"),
    )
    return both


def retained(days: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """The rows of days (a date text `day`) later than `keep` days before as_of."""
    return days.where(F.col("day").cast("date") > F.date_sub(as_of, keep))


def run_once(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Runs a streaming query over the files that are there and new to its folder, and returns its result so far; see `batches.result` for the modes."""
    return batches.result(build(batches.source(spark, path, files)), mode, folder, keys)


def _newest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


class VisitLog:
    """The log of visits, kept by a stream: the last `n` visits, the visits of each crawler, and those of each day and crawler.

    A batch adds its own newest visits and counts, all published together, so a batch that runs twice counts once. Folding keeps the list at n rows and one row for each count; with
    `keep_days`, days that are that much older than the newest one go then and are left out of what is read before.
    """

    COUNTS, DAYS = "crawler string, visits long", "day string, crawler string, visits long"

    def __init__(self, spark: SparkSession, folder: str, n: int = 1000, keep_days: int | None = None):
        self.spark, self.folder, self.n, self.keep_days = spark, folder, n, keep_days
        self.log = batches.BatchLog(spark, f"{folder}/log")

    def follow(self, rows: DataFrame, fold_every: int = 16) -> VisitLog:
        """Takes in what a stream of visits (event_id, ts, crawler, ...) has that is new to this folder."""

        def tables(df: DataFrame) -> batches.Tables:
            day = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "crawler").agg(F.count(F.lit(1)).alias("visits"))
            return {"recent": _newest(df, self.n), "counts": counts(df), "daily": day}

        merges = {"recent": lambda df: _newest(df, self.n), "counts": self._summed("crawler"), "daily": lambda df: self._kept(self._summed("day", "crawler")(df))}
        batches.follow(rows, self.folder, tables, merges=merges, fold_every=fold_every)
        self.schema = rows.schema
        return self

    @staticmethod
    def _summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.groupBy(*keys).agg(F.sum("visits").alias("visits"))

    def _kept(self, days: DataFrame) -> DataFrame:
        if self.keep_days is None:
            return days
        newest = days.agg(F.max("day").cast("date").alias("_newest"))
        return days.join(F.broadcast(newest)).where(F.col("day").cast("date") > F.date_sub("_newest", self.keep_days)).drop("_newest")  # one row

    def recent(self) -> DataFrame:
        """The last n visits, newest first."""
        return _newest(self.log.read("recent", self.schema).drop("batch"), self.n)

    def totals(self) -> DataFrame:
        return self._summed("crawler")(self.log.read("counts", self.COUNTS))

    def daily(self) -> DataFrame:
        return self._kept(self._summed("day", "crawler")(self.log.read("daily", self.DAYS)))


def recent_by_stream(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], n: int, folder: str | None = None, files: int | None = None) -> DataFrame:
    """The last n visits, newest first (the list's size is the feature). Each batch adds its own newest visits; the list isn't rewritten but when batches are folded."""
    log = batches.follow(rows := build(batches.source(spark, path, files)), folder or _folder(spark), lambda df: {"recent": _newest(df, n)}, merges={"recent": lambda df: _newest(df, n)})
    return _newest(log.read("recent", rows.schema).drop("batch"), n)


class DailyRuns:
    """The daily aggregates of monitoring runs as they arrive: the checks of a run add up over all batches that have some, and the last run of a day replaces the ones before it.

    Checks have day, run (text that sorts by time) and the columns of daily_aggregates. A batch publishes sums by day, run and platform, and the cited entities as rows; days are put together when they are read. Days
    older than `keep_days` before the newest one go.
    """

    SUMS = "day string, run string, platform string, checked long, cited long"
    FOUND = "day string, run string, event_id long, entity string"

    def __init__(self, spark: SparkSession, folder: str, keep_days: int | None = None):
        self.spark, self.folder, self.keep_days = spark, folder, keep_days
        self.log = batches.BatchLog(spark, f"{folder}/log")

    def follow(self, checks: DataFrame, fold_every: int = 16) -> DailyRuns:
        def tables(df: DataFrame) -> batches.Tables:
            sums = df.groupBy("day", "run", "platform").agg(F.count(F.lit(1)).alias("checked"), F.count_if("cited").alias("cited"))
            return {"sums": sums, "found": df.where("cited").select("day", "run", F.col("event_id").cast("long").alias("event_id"), "entity")}

        batches.follow(checks, self.folder, tables, merges={"sums": self._sums, "found": self._found}, fold_every=fold_every)
        return self

    def _last(self) -> DataFrame:
        """day, run: the last run of each day that is kept."""
        last = self.log.read("sums", self.SUMS).groupBy("day").agg(F.max("run").alias("run"))
        if self.keep_days is None:
            return last
        newest = last.agg(F.max("day").cast("date").alias("_newest"))
        return last.join(F.broadcast(newest)).where(F.col("day").cast("date") > F.date_sub("_newest", self.keep_days)).drop("_newest")  # one row

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._last(), ["day", "run"], "left_semi").groupBy("day", "run", "platform").agg(F.sum("checked").alias("checked"), F.sum("cited").alias("cited"))

    def _found(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._last(), ["day", "run"], "left_semi")

    def days(self, entities: bool = True) -> DataFrame:
        """day, run, total_checks, citations, platforms and, for readers that show them, cited_entities in order of event_id."""
        per = self._sums(self.log.read("sums", self.SUMS))
        platforms = F.map_from_entries(F.collect_list(F.struct("platform", F.struct("checked", "cited"))))
        day = per.groupBy("day", "run").agg(F.sum("checked").alias("total_checks"), F.sum("cited").alias("citations"), platforms.alias("platforms"))
        if not entities:
            return day
        found = self._found(self.log.read("found", self.FOUND)).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("event_id", "entity")))["entity"].alias("cited_entities"))
        return day.join(found, "day", "left").withColumn("cited_entities", F.coalesce("cited_entities", F.array().cast("array<string>")))

    def index(self) -> DataFrame:
        """day, score: the kept days by the time of their last run, for ranges by score."""
        return self._last().select("day", F.col("run").alias("score"))


def upsert_daily_by_stream(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], keep_days: int | None = None, folder: str | None = None, files: int | None = None) -> DataFrame:
    """The daily aggregates of the runs that have arrived by now, over all calls with this folder; see DailyRuns."""
    return DailyRuns(spark, folder or _folder(spark), keep_days).follow(build(batches.source(spark, path, files))).days()


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def list_range(rows: DataFrame, newest: list[Column], first: int, last: int) -> DataFrame:
    """Rows first to last (counted from 0, both included) of a list whose head is the newest."""
    return rows.orderBy(*newest).limit(last + 1).offset(first)


def score_range(index: DataFrame, score: Column, first: int, last: int, reverse: bool = False) -> DataFrame:
    """Members first to last (counted from 0, both included) of a set that is sorted by score; the highest first if reverse."""
    return index.orderBy(score.desc() if reverse else score.asc()).limit(last + 1).offset(first)


def value_of(table: DataFrame, column: str, key) -> DataFrame:
    """The row of a key; no row for an unknown one."""
    return table.where(F.col(column) == key).limit(1)


def decoded(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """A list's JSON values as columns; a value that doesn't parse has nulls."""
    return rows.select(F.from_json(column, schema).alias("v")).select("v.*")


def next_run(as_of: Column, weekday: int = 2, hour: int = 9) -> Column:
    """The next run at or after as_of (UTC) of a weekly schedule: weekday 1 is Sunday, so 2 is Monday."""
    day = F.date_trunc("day", as_of)
    ahead = (F.lit(weekday + 7) - F.dayofweek(as_of)) % 7
    on = lambda days: F.timestamp_add("HOUR", F.lit(hour), F.timestamp_add("DAY", days, day))
    return F.when(on(ahead) >= as_of, on(ahead)).otherwise(on(ahead + 7))
