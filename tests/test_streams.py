"""Streams over several batches, with restarts, repeats and late rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.sources.shared import new_folder
from quarry.streaming import batches, visits

CHECK = "event_id long, day string, run string, platform string, entity string, cited boolean"
VISIT = "event_id long, ts timestamp, crawler string"


def put(spark, folder, schema, *files):
    """One file for each list of rows, in this order."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(day, hour=0):
    return datetime.datetime(2026, 1, day, hour)


def shown(days):
    return {r["day"]: (r["run"], r["total_checks"], r["citations"], {k: tuple(v) for k, v in r["platforms"].items()}, r["cited_entities"]) for r in days.collect()}


def test_a_run_in_several_batches_adds_up_and_a_later_run_replaces_it(spark):
    folder, state = new_folder(spark, "runs"), new_folder(spark, "state")
    one = [(1, "2026-01-01", "09", "p", "a", True), (2, "2026-01-01", "09", "q", "b", False)]
    two = [(3, "2026-01-01", "09", "p", "c", True), (9, "2026-01-02", "09", "p", "z", True)]
    three = [(0, "2026-01-01", "09", "q", "d", True)]
    put(spark, folder, CHECK, one, two, three)
    runs = visits.DailyRuns(spark, state)
    take = lambda: runs.follow(batches.source(spark, folder, 1))
    want = {"2026-01-01": ("09", 4, 3, {"p": (2, 2), "q": (2, 1)}, ["d", "a", "c"]), "2026-01-02": ("09", 1, 1, {"p": (1, 1)}, ["z"])}
    assert shown(take().days()) == want and len(runs.log.batches()) == 3
    assert shown(take().days()) == want and len(runs.log.batches()) == 3  # nothing is new
    put(spark, folder, CHECK, [(5, "2026-01-01", "17", "p", "x", False)], [(6, "2026-01-01", "17", "p", "y", True), (7, "2026-01-01", "08", "p", "late", True)])
    want["2026-01-01"] = ("17", 2, 1, {"p": (2, 1)}, ["y"])
    assert shown(take().days()) == want and len(runs.log.batches()) == 5
    runs.log.fold({"sums": runs._sums, "found": runs._found})
    assert runs.log.batches() == [] and shown(runs.days()) == want
    assert [tuple(r) for r in runs.index().orderBy("score", "day").collect()] == [("2026-01-02", "09"), ("2026-01-01", "17")]
    assert "cited_entities" not in runs.days(False).columns


def test_days_expire_and_leave_the_log(spark):
    folder, state = new_folder(spark, "runs"), new_folder(spark, "state")
    put(spark, folder, CHECK, *[[(d, f"2026-{m:02}-01", "1", "p", "e", True)] for d, m in enumerate((1, 2, 5))])
    runs = visits.DailyRuns(spark, state, 60).follow(batches.source(spark, folder, 1), fold_every=2)
    assert set(shown(runs.days())) == {"2026-05-01"}
    runs.log.fold({"sums": runs._sums, "found": runs._found})
    assert {r["day"] for r in runs.log.read("sums").collect()} == {"2026-05-01"}


def test_a_batch_that_runs_again_changes_nothing(spark):
    log = batches.BatchLog(spark, new_folder(spark, "log"))
    rows = lambda n: spark.createDataFrame([(n,)], "n int")
    assert log.publish(0, lambda: {"a": rows(1), "b": rows(10)})
    assert not log.publish(0, lambda: pytest.fail("written again"))
    # a batch that ended between its tables: not seen, and overwritten when it runs again
    rows(2).write.parquet(f"{log.folder}/batch-1/a")
    assert [r["n"] for r in log.read("a").collect()] == [1]
    assert log.publish(1, lambda: {"a": rows(3), "b": rows(30)})
    assert sorted((r["n"], r["batch"]) for r in log.read("a").collect()) == [(1, 0), (3, 1)]
    total = lambda df: df.agg(F.sum("n").cast("int").alias("n"))
    log.fold({"a": total, "b": total})
    assert not log.publish(1, lambda: pytest.fail("written again")) and log.batches() == []
    assert log.publish(2, lambda: {"a": rows(5), "b": rows(50)})
    assert sorted((r["n"], r["batch"]) for r in log.read("a").collect()) == [(4, 1), (5, 2)]
    log.fold({"a": total, "b": total})
    log.publish(3, lambda: {"a": rows(1), "b": rows(1)})
    log.fold({"a": total, "b": total})
    assert [r["n"] for r in log.read("b").collect()] == [91] and log._marked("fold") == [2, 3] and log._marked("batch") == [3]


def test_the_visit_log_over_stops_restarts_and_folds(spark):
    folder, state = new_folder(spark, "visits"), new_folder(spark, "state")
    rows = [(k, at(1 + k % 20, k % 24), "ab"[k % 3 == 0]) for k in range(60)]
    put(spark, folder, VISIT, rows[:10], rows[10:20])
    log = visits.VisitLog(spark, state, 7, 10)
    take = lambda: log.follow(batches.source(spark, folder, 1), 3)

    def check(rows):
        newest = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:7]
        assert [r["event_id"] for r in log.recent().collect()] == [r[0] for r in newest]
        assert {r["crawler"]: r["visits"] for r in log.totals().collect()} == {c: sum(r[2] == c for r in rows) for c in "ab"}
        last = max(r[1] for r in rows).date()
        kept = [r for r in rows if r[1].date() > last - datetime.timedelta(days=10)]
        assert {(r["day"], r["crawler"]): r["visits"] for r in log.daily().collect()} == {k: sum((str(r[1].date()), r[2]) == k for r in kept) for k in {(str(r[1].date()), r[2]) for r in kept}}

    take()
    check(rows[:20])
    put(spark, folder, VISIT, *[rows[k : k + 8] for k in range(20, 60, 8)])
    take()
    check(rows)
    assert log.log.folded() >= 2 and log.log.last() == 6  # seven files, a batch each
    assert log.log.spark.read.parquet(f"{state}/log/fold-{log.log.folded()}/recent").count() == 7


def test_results_of_all_modes_over_calls(spark):
    folder = new_folder(spark, "visits")
    states = {m: new_folder(spark, m) for m in ("complete", "append", "update")}
    put(spark, folder, VISIT, [(1, at(1), "a"), (2, at(1), "b")], [(3, at(2), "a")])
    run = lambda m, build, keys=None: sorted(tuple(r) for r in visits.run_once(spark, folder, build, m, keys, states[m], 1).collect())
    plain = lambda s: s.select("event_id", "crawler")
    assert run("append", plain) == [(1, "a"), (2, "b"), (3, "a")]
    assert run("complete", visits.counts) == run("update", visits.counts, ["crawler"]) == [("a", 2), ("b", 1)]
    put(spark, folder, VISIT, [(4, at(3), "c"), (5, at(3), "b")])
    assert run("append", plain) == [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")]
    assert run("complete", visits.counts) == run("update", visits.counts, ["crawler"]) == [("a", 2), ("b", 2), ("c", 1)]
    with pytest.raises(ValueError):
        visits.run_once(spark, folder, visits.counts, "update")


def test_late_rows_count_within_the_watermark_only(spark):
    folder, state = new_folder(spark, "visits"), new_folder(spark, "state")
    take = lambda: {(str(r["day"])[:10], r["crawler"]): r["visits"] for r in visits.run_once(spark, folder, lambda s: visits.daily(s, "2 days"), "append", folder=state, files=1).collect()}
    put(spark, folder, VISIT, [(1, at(1, 5), "a")], [(2, at(2, 5), "a"), (3, at(1, 9), "a")], [(4, at(3, 5), "a"), (5, at(1, 7), "a")])
    assert take() == {}  # the watermark is at the 1st
    put(spark, folder, VISIT, [(6, at(9), "a")], [(7, at(10), "a")], [(8, at(1, 8), "a"), (9, at(8, 1), "b")])
    assert take() == {("2026-01-01", "a"): 3, ("2026-01-02", "a"): 1, ("2026-01-03", "a"): 1}
    put(spark, folder, VISIT, [(10, at(20), "z")])
    found = take()
    assert found[("2026-01-08", "b")] == 1 and found[("2026-01-01", "a")] == 3
