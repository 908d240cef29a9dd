"""Robots, crawls, notes, streams and drafts on small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.operators import corpus, crawl, drafts, extraction, ingest, monitor
from quarry.plans import record_catalog
from quarry.sources import connectors, documents, records
from quarry.sources.shared import new_folder
from quarry.streaming import visits


def test_robots_groups():
    """A line with an empty value doesn't count, so it doesn't end a list of agents."""
    assert urls.parse_robots("User-agent: a\nDisallow:\nUser-agent: b\nDisallow: /\n") == [{"agents": ["a", "b"], "rules": [(False, "/")], "delay": None}]
    assert urls.parse_robots("User-agent:\nDisallow: /\nAllow: /x") == []
    found = urls.parse_robots("USER-AGENT: A # x\nCrawl-delay: 2s\nUser-agent: b\nCrawl-delay: -1\nCrawl-delay: no\nUser-agent: c\nAllow: /y")
    assert found == [{"agents": ["a"], "rules": [], "delay": 2.0}, {"agents": ["b", "c"], "rules": [(True, "/y")], "delay": None}]
    assert urls.crawl_delay_ms(found, "A-bot", 1000) == 2000 and urls.crawl_delay_ms(found, "b", 1000) == 1000 and urls.crawl_delay_ms(found, "z", 7) == 7
    assert urls.robots_sitemaps("Sitemap: https://e.org/a.xml\nsitemap:\nSITEMAP: b") == ["https://e.org/a.xml", "b"]


def test_dot_segments(spark):
    cases = {"http://e.org/a/./b/../c": "http://e.org/a/c", "http://e.org/../x": "http://e.org/x", "http://e.org/a/..": "http://e.org/", "http://e.org/a.b/..c/d?q=/../": "http://e.org/a.b/..c/d?q=/../", "http://e.org/a/b/../../../c/.": "http://e.org/c/"}
    rows = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert [r for r in rows.withColumn("got", urls.without_dots(F.col("url"))).collect() if r["got"] != r["want"]] == []


def test_crawl_order_limit_and_resume(spark):
    u = lambda x: f"https://e.org/{x}"
    links = {"s": ["b", "a", "bad"], "a": ["s", "c"], "b": ["c", "d", "no/x"], "c": ["e"], "d": [], "e": []}
    rows = [(u(k), None, [u(x) for x in v]) for k, v in links.items()] + [(u("bad"), "HTTP 403", [u("e")])]
    pages = spark.createDataFrame(rows, "url string, error string, links array<string>")
    config = crawl.CrawlConfig.of(u("s"), max_pages=4, max_depth=5, exclude=("/no/**",), include=None)
    assert config.include == () and config.with_robots("User-agent: *\nCrawl-delay: 3").delay_ms == 3000
    seen = lambda df: [(r["url"].rsplit("/", 1)[1], r["status"]) for r in df.orderBy("depth", "place").collect()]
    want = [("s", 200), ("b", 200), ("a", 200), ("bad", 403), ("c", 200)]
    assert seen(crawl.crawl(spark, pages, config)) == want
    folder = new_folder(spark, "resume")
    for n in (1, 2, 4, 5):
        found = crawl.crawl(spark, pages, config, folder=folder, levels=1)
        assert seen(found) == want[: {1: 1, 2: 4, 4: 5, 5: 5}[n]]
    assert seen(crawl.crawl(spark, pages, config, robots="User-agent: *\nDisallow: /a")) == [("s", 200), ("b", 200), ("bad", 403), ("c", 200), ("d", 200)]
    assert crawl.crawl(spark, pages, crawl.CrawlConfig.of(u("s")), robots="User-agent: *\nDisallow: /").count() == 0


def test_daily_upsert_over_several_files(spark):
    folder = new_folder(spark, "runs")
    runs = [("2026-01-01", "1", [("p", "e1", True), ("q", "e2", False)]), ("2026-01-01", "2", [("p", "e3", True)]), ("2026-01-02", "1", [("p", "e1", False)]), ("2025-01-01", "1", [("p", "e9", True)])]
    schema = "event_id long, day string, run string, platform string, entity string, cited boolean"
    for day, run, checks in runs:
        spark.createDataFrame([(k, day, run, *c) for k, c in enumerate(checks)], schema).coalesce(1).write.mode("append").parquet(folder)
    found = {r["day"]: (r["run"], r["total_checks"], r["citations"], r["cited_entities"]) for r in visits.upsert_daily_by_stream(spark, folder, lambda s: s.select("*"), 90).collect()}
    assert found == {"2026-01-01": ("2", 1, 1, ["e3"]), "2026-01-02": ("1", 1, 0, [])}


def test_connectors_and_prompts(spark):
    one = spark.createDataFrame([("https://e.org/a", "t" * 99), ("https://e.org/b", "t" * 100)], "url string, text string")
    rec = spark.createDataFrame([(u, '{"entities": [], "claims": [], "sourceInfo": {"title": "t", "publisher": "p", "type": "pdf", "confidence": "low"}}', 1, 2) for u in ("https://e.org/a", "https://e.org/b")], "url string, answer string, input_tokens int, output_tokens int")
    assert {r["url"][-1]: (r["x"] is not None, r["input_tokens"]) for r in connectors.extraction_replies(one, rec).collect()} == {"a": (False, None), "b": (True, 1)}
    sites = spark.createDataFrame([("https://E.org/x?y",), ("nonsense",)], "url string")
    assert [(r["host"], r["text"]) for r in connectors.robots_fetch(sites, spark.createDataFrame([], "url string, status int, body string")).collect()] == [("e.org", "")]
    asked = monitor.platform_requests(spark.createDataFrame([("x" * 20000,)], "prompt string"), ["chatgpt"])
    assert len(asked.collect()) == 1 and asked.select(F.length(F.get_json_object("payload", "$.prompt"))).first()[0] == 4000
    assert monitor.mention_history(spark, new_folder(spark, "none")).count() == 0
    assert monitor.summary_alert(monitor.run_summary(spark.createDataFrame([], monitor.RESULT), F.lit("t"))).count() == 0


def test_replies_that_break_the_schema(spark):
    good = {"name": "n", "type": "person", "description": "d", "confidence": "high"}
    import json

    make = lambda **k: json.dumps({"entities": [good | k.get("e", {})], "claims": [{"title": "t", "statement": "s", "entityRole": "subject", "confidence": "low"} | k.get("c", {})], "sourceInfo": {"title": "", "publisher": "", "type": "book", "confidence": "low"} | k.get("s", {})})
    cases = [(make(), True), (make(e={"type": "robot"}), False), (make(e={"description": None}), False), (make(c={"title": "t" * 121}), False), (make(c={"quote": "q" * 301}), False), (make(c={"quote": None}), True), (make(s={"confidence": "sure"}), False), ("no json", False), (f"```json\n{make()}\n```", True)]
    rows = spark.createDataFrame(cases, "answer string, good boolean").withColumn("x", extraction.reply(F.col("answer")).isNotNull())
    assert [r for r in rows.collect() if r["x"] != r["good"]] == []


def test_notes_need_all_their_parts(spark):
    texts = [("a", "# T\nS\nsource: https://www.e.org/x"), ("b", "# T\nsource: https://e.org"), ("c", "S only\nsource: https://e.org"), ("d", "# T\nS"), ("e", "# T\nS\nsource: not a url")]
    entities, topics = spark.createDataFrame([("x",)], "slug string"), spark.createDataFrame([], "slug string")
    found = ingest.notes(spark.createDataFrame(texts, "key string, text string"), F.lit("x"), F.lit(None).cast("string"), entities, topics, "2026-01-01")
    assert {r["key"]: r["source"]["publisher"] for r in found.collect()} == {"a": "e.org", "e": "Unknown"}
    assert ingest.notes(spark.createDataFrame(texts, "key string, text string"), F.lit("y"), F.lit(""), entities, topics, "2026-01-01").count() == 0


def test_dedup_prefers_home_then_confidence(spark):
    rows = [("a", "home-1", 3, "low", 1), ("a", "away", 1, "high", 9), ("b", "x", 1, "low", 1), ("b", "y", 2, "high", 1), ("b", "z", 3, "high", 2), ("v", "x", 1, "high", 1), ("n", "x", 1, "low", 1), ("n", "y", 2, "high", 1)]
    inventory = spark.createDataFrame(rows, "slug string, batch string, batch_ord int, confidence string, n_pages int")
    moves, homes = spark.createDataFrame([("v", "w")], "variant string, canonical string"), spark.createDataFrame([("a", "home")], "slug string, home string")
    found = {(r["slug"], r["batch"]): r["action"] for r in drafts.dedup_actions(inventory, moves, homes, (F.col("slug") == "n") & (F.col("batch") == "x")).collect()}
    assert found == {("a", "home-1"): "keep", ("a", "away"): "duplicate", ("b", "x"): "duplicate", ("b", "y"): "duplicate", ("b", "z"): "keep", ("v", "x"): "merge", ("n", "x"): "duplicate", ("n", "y"): "noise"}


def test_next_run(spark):
    rows = spark.createDataFrame([("2026-01-05 08:59:00", "2026-01-05 09:00"), ("2026-01-05 09:00:00", "2026-01-05 09:00"), ("2026-01-05 09:01:00", "2026-01-12 09:00"), ("2026-01-04 23:00:00", "2026-01-05 09:00")], "at string, want string")
    got = rows.withColumn("got", F.date_format(visits.next_run(F.to_timestamp("at")), "yyyy-MM-dd HH:mm"))
    assert [r for r in got.collect() if r["got"] != r["want"]] == []


def test_a_shared_folder_is_asked_for():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        new_folder(Session(), "x")


def test_numbers_without_one_task(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one range
    try:
        found = corpus.numbered(rows, [F.desc("v")], "place")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    values = sorted((r["v"] for r in rows.collect()), reverse=True)
    assert {r["place"]: r["v"] for r in found.collect()} == dict(enumerate(values, 1))
    assert corpus.numbered(rows.where("false"), ["v"], "place").collect() == []


def test_load_json(spark):
    rows = spark.createDataFrame([('{"name": "a"}', "a"), ("{bad", None), ("[1]", None), (None, None)], "t string, want string")
    assert [r for r in rows.withColumn("got", records.load_json(F.col("t"), "name STRING")["name"]).collect() if r["got"] != r["want"]] == []


def test_a_document_is_handed_on_once(spark):
    path = f"{new_folder(spark, 'document')}/x.txt"
    documents.write_document(spark.createDataFrame([(1, 2, "é"), (1, 1, ""), (0, None, "a\tb")], "place int, order int, line string"), path)
    found = documents.read_document(spark, path)
    assert [tuple(r) for r in found.collect()] == [("a\tb\n\né\n",)]
    assert found.columns == ["body"]


def test_a_document_beyond_a_value_is_refused_before_it_is_read(spark, tmp_path):
    path = tmp_path / "x.txt"
    for size in (2**31 - 1, 2**31, 2_340_239_022):
        with path.open("ab") as file:
            file.truncate(size)  # takes no space on the disk
        if size < 2**31:
            assert documents.read_document(spark, str(path)).columns == ["body"]
        else:
            with pytest.raises(ValueError, match=str(size)):
                documents.read_document(spark, str(path))
    assert path.stat().st_size == size


def test_the_feed_is_not_copied_beside_its_reader(spark):
    folder = new_folder(spark, "feed")
    spark.sql("SELECT id AS o_orderkey, 'LOW' AS o_orderpriority, TIMESTAMP '2026-01-01 00:00:00' AS o_orderdate FROM range(5)").write.parquet(f"{folder}/orders.parquet")
    feed = record_catalog.rss_file(record_catalog.Tables(spark, folder))
    plan = feed._jdf.queryExecution().sparkPlan().toString()
    assert "Project" not in plan  # it builds the row again while the reader holds it
    assert "Exchange SinglePartition" in plan  # the task that uses the row isn't the reader's
    assert feed.count() == 1 and feed.first()["body"].count("<item>") == 5
