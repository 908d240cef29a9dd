"""Text, URL, name and source semantics that the driver's tables don't show."""

import json

from pyspark.sql import functions as F

from quarry.functions import names, text, urls
from quarry.operators import drafts, mentions
from quarry.sources import connectors, records


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    assert one(spark, "a<script>b</script>c", text.clean_text) == "a c"
    assert one(spark, "<p>x</p><p> </p><p>y</p>", text.clean_text) == "x\ny"
    assert one(spark, "&amp;lt;", text.decode_entities) == "<"
    assert one(spark, "&#65601;&#x1F;", text.decode_entities) == "A\x1f"
    assert one(spark, None, text.clean_text) is None


def test_metadata(spark):
    html = '<html lang="en"><title> own </title><meta content="og" property="og:title"><meta name="description" content="d"><link href="c" rel="canonical">'
    m = one(spark, html, text.page_metadata)
    assert (m["title"], m["description"], m["canonicalUrl"], m["language"], m["ogType"]) == ("og", "d", "c", "en", None)
    assert one(spark, '<title>own</title><meta property="og:title" content="">', text.page_metadata)["title"] == "own"


def test_page_type(spark):
    kind = lambda path, title: spark.range(1).select(text.page_type(F.lit(path), F.lit(title), F.lit(None).cast("string"))).first()[0]
    assert [kind("/", ""), kind("/x", "Terms of Service"), kind("/connecticut", ""), kind("/x", "")] == ["homepage", "product", "contact", "other"]


def test_json_ld(spark):
    block = lambda s: f'<script type="application/ld+json">{s}</script>'
    assert one(spark, "none", text.json_ld) is None
    assert one(spark, block('{"a":1}') + block("{bad"), text.json_ld) == '{"a":1}'
    assert json.loads(one(spark, block('{"a":1}') + block('{"b":2}'), text.json_ld)) == [{"a": 1}, {"b": 2}]


def test_urls(spark):
    assert one(spark, "HTTPS://WWW.Ex.org:443/a/?b=2&a=1&b=1#f", urls.normalized) == "https://www.ex.org/a?a=1&b=2&b=1"
    assert one(spark, "http://ex.org", urls.normalized) == "http://ex.org/"
    assert one(spark, "not a url", urls.normalized) == "not a url"
    assert urls.normalize_any("http://Ex.org:80/a/../b/?q=%20x#f") == "http://ex.org/b?q=+x"
    assert urls.normalize_any("http://") == "http://"
    links = one(spark, "<a href='/a/'>1</a><a href='//o.net/x'>2</a><a href=\"mailto:x\">3</a><a href='b'>4</a>", lambda h: urls.page_links(h, F.lit("https://www.ex.org/d/e")))
    assert (links["internal"], links["external"]) == (["https://www.ex.org/a", "https://www.ex.org/d/b"], ["https://o.net/x"])


def test_globs_and_robots(spark):
    allowed = lambda url, inc, exc: one(spark, url, lambda u: urls.glob_allowed(u, inc, exc))
    assert allowed("https://e.org/a.pdf", [], ["*.pdf"]) and not allowed("https://e.org/a.pdf", [], ["**.pdf"])
    assert allowed("https://e.org/about/x", ["/about/*"], []) and not allowed("https://e.org/about/x/y", ["/about/*"], [])
    groups = urls.parse_robots("User-agent: a\nUser-agent: bot\nDisallow: /x # c\nAllow: /x/y$\n\nUser-agent: *\nDisallow:\n")
    rules = urls.robots_group(groups, "MyBot/2")["rules"]
    ok = lambda path: one(spark, f"https://e.org{path}", lambda u: urls.robots_allowed(u, rules))
    assert [ok("/x"), ok("/x/y"), ok("/x/yz"), ok("/z")] == [False, True, False, True]
    assert urls.robots_group(groups, "other")["rules"] == []


def test_names(spark):
    assert [one(spark, n, names.normalized_name) for n in ("FICO", "Acme, Inc.", "RAC Mexico")] == ["fi", "acme", "rac mexi"]
    assert one(spark, "Rent-A-Center's Policy!", names.slug) == "rent-a-center-s-policy"
    assert one(spark, "www.Big-Co.com", names.domain_slug) == "big-co"
    known = names.alias_map(spark.createDataFrame([("acme-inc", "Acme, Inc.", 1), ("acme", "Acme", 2)], "slug string, name string, ord int"))
    found = names.resolve_names(spark.createDataFrame([("ACME LLC",), ("Acme Inc",), ("New Group",)], "name string"), known)
    assert {r["name"]: r["resolved"] for r in found.collect()} == {"ACME LLC": "acme", "Acme Inc": "acme-inc", "New Group": "new"}


def test_answers(spark):
    perplexity = json.dumps({"answer_results": [{"answer": "A", "sources": [{"name": "n", "url": "u"}]}], "additional_results": {"x": [{"title": "t", "url": "v"}, {"title": "no"}]}})
    a = one(spark, perplexity, mentions.parse_perplexity)
    assert (a["answer"], [tuple(s) for s in a["sources"]]) == ("A", [("n", "u"), ("t", "v")])
    chat = json.dumps({"raw_response": ['data: {"v":"a"}', "data: {bad", 'data: {"v":{"message":{"author":{"role":"assistant"},"content":{"parts":["b","c"]}}}}', "data: [DONE]"]})
    assert one(spark, chat, mentions.parse_chatgpt)["answer"] == "abc"
    note = one(spark, "x\n# Title\nsource: s\nThe statement\nmore\nquote: 'q'", mentions.parse_note)
    assert tuple(note) == ("Title", "The statement", "s", "q")
    assert mentions.CRAWLERS[2][0] == "Claude-Web" and one(spark, "gptbot", mentions.crawler_of) is None


def test_drafts(spark):
    rows = spark.createDataFrame([("a", 0, True, 1, 0), ("a", 1, False, 3, 9), ("b", 0, False, 2, 1), ("b", 1, False, 2, 4), ("b", 2, False, 2, 4)], "slug string, batch_ord int, is_home boolean, rank int, n_pages int")
    assert {r["slug"]: r["batch_ord"] for r in drafts.best_versions(rows).collect()} == {"a": 0, "b": 1}


def test_record_scans_and_connector(spark, tmp_path):
    folder = tmp_path / "topics"
    folder.mkdir()
    (folder / "a.json").write_text('{"slug": "a", "name": "A", "extra": 1}')
    (folder / "b.json").write_text("{bad")
    root = f"file://{tmp_path}"
    assert [r["slug"] for r in records.scan(spark, root, "topics", "DROPMALFORMED").collect()] == ["a"]
    assert {r["file"]: r["_corrupt_record"] is not None for r in records.scan_with_errors(spark, root, "topics").collect()} == {"a.json": False, "b.json": True}
    assert sorted(r["slug"] for r in records.keys_only(spark, root, "topics").collect()) == ["a", "b"]
    assert records.scan(spark, root, "claims").count() == 0
    recording = spark.createDataFrame([("u", 200, "x"), ("v", 404, "")], "url string, status int, body string")
    found = connectors.fetch(spark.createDataFrame([("u",), ("v",), ("w",)], "url string"), recording).collect()
    assert sorted((r["url"], r["status"], r["error"]) for r in found) == [("u", 200, None), ("v", 404, "HTTP 404"), ("w", 0, "not recorded")]


def test_links_keep_their_digits(spark):
    html = "".join(f'<a href=" /n/{k}0{k} ">x</a>' for k in range(12)) + "<a href='https://x.org/0'>"
    links = spark.createDataFrame([(html, "https://e.org/")], "h string, u string").select(urls.page_links(F.col("h"), F.col("u")).alias("l")).first()["l"]
    assert links["internal"] == [f"https://e.org/n/{k}0{k}" for k in range(12)] and links["external"] == ["https://x.org/0"]


def test_long_values_are_whole(spark):
    long = "v" * 1_100_000
    assert one(spark, f"https://e.org/a?z=1&b={long}", urls.sorted_query) == f"?b={long}&z=1"
    note = one(spark, f"# {long}\nsaid\nsource: {long}\nquote: '{long}'", mentions.parse_note)
    assert (note["title"], note["source"], note["quote"], note["statement"]) == (long, long, long, "said")
    event = json.dumps({"raw_response": ["data: " + json.dumps({"v": long}), "data: [DONE]"]})
    assert one(spark, event, mentions.parse_chatgpt)["answer"] == long
