"""Crawls from raw pages to a manifest, redirects, and robots rules as rows."""

import http.server
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.operators import crawl
from quarry.sources import connectors
from quarry.sources.shared import new_folder

REC = "url string, status int, location string, body string"


def u(x):
    return f"https://e.org/{x}"


def recording(spark, rows):
    return spark.createDataFrame(rows, REC).repartition(3)


def test_redirects_settle_and_loops_end(spark):
    rows = [(u(f"r{k}"), 301, f"r{k + 1}", None) for k in range(12)] + [(u("r12"), 200, None, "end"), (u("a"), 302, "/b", None), (u("b"), 302, "c?x=1", None), (u("c?x=1"), 302, "a#f", None), (u("self"), 301, "self", None), (u("gone"), 308, "//e.org/404", None), (u("404"), 404, None, None), (u("none"), 302, None, None)]
    found = {r["url"].rsplit("/", 1)[1]: (r["final_url"] and r["final_url"].rsplit("/", 1)[1], r["hops"]) for r in connectors.settled_redirects(recording(spark, rows)).collect()}
    assert all(found[f"r{k}"] == ("r12", 12 - k) for k in range(12)) and all(found[k][0] is None for k in ("a", "b", "c?x=1", "self")) and found["gone"] == ("404", 1)
    short = {r["url"]: r["final_url"] for r in connectors.settled_redirects(recording(spark, rows), 5).collect()}
    assert {k: v is not None for k, v in short.items() if "/r" in k} == {u(f"r{k}"): 12 - k <= 5 for k in range(12)}
    got = {r["url"]: (r["status"], r["body"], r["error"]) for r in connectors.replay(recording(spark, [*rows, (u("r12"), 500, None, "twice")]))(spark.createDataFrame([(u(x),) for x in ("r0", "a", "gone", "lost", "r0")], "url string")).collect()}
    assert got == {u("r0"): (200, "end", None), u("a"): (0, None, "too many redirects"), u("gone"): (404, None, "HTTP 404"), u("lost"): (0, None, "not recorded")}


def links(*to):
    return "<html><head><title>T</title></head><body>" + "".join(f"<a href='{x}'>x</a>" for x in to) + "some text</body></html>"


def site():
    return [
        (u(""), 200, None, links("b", "a", "/secret/x", "bad", "far?q=2&p=1")),
        (u("a"), 200, None, links("/", "c", "no/x")),
        (u("b"), 301, "/b2", None), (u("b2"), 200, None, links("c", "d", "loop")),
        (u("c"), 200, None, links("e")), (u("d"), 200, None, links()), (u("d"), 200, None, links("e", "zz")), (u("e"), 200, None, ""), (u("loop"), 302, "loop", None), (u("bad"), 403, None, None), (u("far?p=1&q=2"), 200, None, None),
        (u("robots.txt"), 200, None, "User-agent: *\nDisallow: /secret\\E(\nDisallow: /secret/\nCrawl-delay: 3\nSitemap: https://e.org/s.xml # all\nsitemap:  b\nUser-agent: other\nDisallow: /"),
    ]


WANT = [("", 0, 200), ("b", 1, 200), ("a", 1, 200), ("bad", 1, 403), ("far?p=1&q=2", 1, 200), ("c", 2, 200), ("d", 2, 200), ("loop", 2, 0), ("e", 3, 200), ("zz", 3, 0)]


def shown(df):
    return [(r["url"][14:], r["depth"], r["status"]) for r in df.orderBy("depth", "place").collect()]


def test_a_crawl_from_html_to_manifest(spark):
    config = crawl.CrawlConfig.of(u(""), max_pages=50, max_depth=5, exclude=("/no/**",), started="20260101_000000")
    fetch, folder = connectors.replay(recording(spark, site())), new_folder(spark, "run")
    found = crawl.crawl_run(spark, config, fetch, folder, "2026-01-01T00:00:00.000Z")
    assert [x for x in shown(found) if x[0] != "zz"] == WANT[:-1]
    m = spark.read.parquet(f"{folder}/manifest").first()
    assert (m["domain"], m["crawlId"], m["status"], m["stats"]["pages_ok"], m["stats"]["pages_failed"]) == ("e.org", "e.org_20260101_000000", "completed", 7, 2 + ("zz" in {x[0] for x in shown(found)}))
    assert {p["url"][14:] for p in m["pages"]} == {x for x, _, s in WANT if s == 200} and {(e["url"][14:], e["error"]) for e in m["errors"]} >= {("bad", "HTTP 403"), ("loop", "too many redirects")}
    assert spark.read.parquet(f"{folder}/hosts0").select("host", "delay_ms", "sitemaps").first() == ("e.org", 3000, ["https://e.org/s.xml", "b"])
    page = spark.read.parquet(f"{folder}/pages1").where(F.col("url") == u("b")).first()
    assert page["final_url"] == u("b2") and page["metadata"]["title"] == "T" and page["text"].endswith("some text") and page["bytes"] == len(page["html"])


def test_a_crawl_that_stops_and_goes_on(spark):
    config = crawl.CrawlConfig.of(u(""), max_pages=5, max_depth=5, exclude=("/no/**",))
    fetch, folder = connectors.replay(recording(spark, site())), new_folder(spark, "run")
    want = [x for x in WANT[:6] if x[0] != "d"]
    for n, levels in ((1, 1), (5, 1), (6, 1), (6, None)):
        assert shown(crawl.crawl_run(spark, config, fetch, folder, levels=levels)) == want[:n]
    assert spark.read.parquet(f"{folder}/manifest").first()["status"] == "in progress"
    forbidden = connectors.replay(recording(spark, [*site()[:-1], (u("robots.txt"), 200, None, "User-agent: *\nDisallow: /")]))
    assert crawl.crawl_run(spark, config, forbidden, new_folder(spark, "run")).count() == 0


def test_a_page_that_is_recorded_twice_is_visited_once(spark):
    pages = spark.createDataFrame([(u("s"), None, [u("a")]), (u("a"), "HTTP 404", []), (u("a"), None, [u("b")]), (u("b"), None, []), (u("b"), None, [])], "url string, error string, links array<string>")
    found = crawl.crawl(spark, pages, crawl.CrawlConfig.of(u("s"), max_pages=3, max_depth=5))
    assert shown(found) == [("s", 0, 200), ("a", 1, 200), ("b", 2, 200)]


def brute_allowed(url, rules):
    subject, best = re.sub(r"^https?://[^/]*", "", url) or "/", (-1, True)
    for allow, pattern in rules:
        end = pattern.endswith("$")
        regex = "^" + "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if end else pattern)) + (r"\Z" if end else "")
        if re.match(regex, subject, re.S):
            best = max(best, (len(pattern.replace("*", "")), allow))
    return best[1]


def test_rules_are_looked_up(spark):
    rules = [("a", x, p) for x, p in ((False, "/"), (True, "/p"), (False, "/p/*.html$"), (True, "/p/*.htm"), (False, r"/a\E("), (False, "/q?x=[1]"), (True, "*z$"), (False, "/$"), (False, "/$x"), (True, "/e*"), (False, "/eq"), (True, "/eq"), (False, "/l" + "o" * 3000), (False, "*"))]
    rules += [("many", k % 2 == 0, f"/d/{k}") for k in range(20_000)] + [("star", False, "/*"), ("b", False, "/x")]
    subjects = ["", "/", "/p", "/p/a.html", "/p/a.htm", "/p/a.html?x", "/a\\E(", "/a\\E", "/q?x=[1]2", "/yz", "/yz1", "/$x", "/e", "/eq1", "/l" + "o" * 3001, "/other", "/d/777", "/d/77", "/d/4", "/x"]
    pages = [(h, f"https://{h}{s}", k) for h in ("a", "many", "star", "b", "none") for k, s in enumerate(subjects)]
    df = spark.createDataFrame([*pages, ("a", "https://a/p", 99), ("a", None, 100), ("a", "nonsense", 101)], "host string, url string, allowed_k int")
    found = urls.rule_verdicts(df, spark.createDataFrame(rules, "host string, allow boolean, pattern string")).collect()
    assert len(found) == len(pages) + 3
    for r in found:
        own = [(x, p) for h, x, p in rules if h == r["host"]]
        assert r["allowed"] == (bool(r["url"]) and r["url"] != "nonsense" and brute_allowed(r["url"], own)), r


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.path, self.headers["User-Agent"]))
            if self.path.startswith("/r"):
                self.send_response(302)
                self.send_header("Location", {"/r1": "/ok", "/rloop": "/rloop"}[self.path])
            else:
                self.send_response({"/ok": 200, "/robots.txt": 404}.get(self.path, 503))
            self.end_headers()
            self.wfile.write("é".encode() if self.path == "/ok" else b"")

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", asked
    own.shutdown()


def test_live_requests_a_host_at_a_time(spark, server):
    base, asked = server
    requests = spark.createDataFrame([(f"{base}/{x}",) for x in ("ok", "r1", "rloop", "down", "ok")] + [("http://127.0.0.1:9/x",), ("nonsense",)], "url string").repartition(4)
    delays = spark.createDataFrame([("127.0.0.1", 150)], "host string, delay_ms int")
    found = {r["url"]: (r["status"], r["body"], r["error"], r["final_url"]) for r in connectors.live("quarry-test", 2000, 0, delays)(requests).collect()}
    assert found[f"{base}/ok"] == (200, "é", None, f"{base}/ok") and found[f"{base}/r1"] == (200, "é", None, f"{base}/ok")
    assert found[f"{base}/rloop"][:3] == (0, None, "too many redirects") and found[f"{base}/down"][:3] == (503, None, "HTTP 503")
    assert all(found[x][0] == 0 and found[x][2] for x in ("http://127.0.0.1:9/x", "nonsense")) and {a for _, _, a in asked} == {"quarry-test"}
    first = [t for t, p, _ in asked if p in ("/ok", "/r1", "/down")]
    assert max(first) - min(first) > 0.25


def rows_out(node, name):
    """Rows that the named operators of an executed plan gave."""
    kind = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return (node.metrics().apply("numOutputRows").value() if kind == name else 0) + sum(rows_out(n, name) for n in inner)


def test_urls_that_rules_cannot_tell_apart_are_looked_up_once(spark):
    pages = spark.createDataFrame([("h", f"https://h/d/{k % 10}/{k}") for k in range(1000)], "host string, url string")
    rules = spark.createDataFrame([("h", k % 2 == 0, "/d/" + str(k)) for k in range(5)] + [("h", False, "/")], "host string, allow boolean, pattern string")
    found = urls.rule_verdicts(pages, rules)
    assert all(r["allowed"] == (r["url"][len("https://h/d/")] in "024") for r in found.collect())
    assert rows_out(found._jdf.queryExecution().executedPlan(), "GenerateExec") == 20  # ten heads, two lengths
