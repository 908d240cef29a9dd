"""Queries over the driver's tables, each with DuckDB SQL for the same rows.

The engine's own tables are stood in for by analogy: claims by orders, citations by lineitem, sources by supplier, entities by
customer, topics by part, the entity hierarchy by nation and region, drafts by documents and labels, visits by events,
crawled pages by pages, and assistants' answers by conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import names, noise, render, text, urls
from quarry.operators import corpus, crawl, drafts, extraction, mentions
from quarry.plans.example_config import EXAMPLE
from quarry.sources.shared import new_folder
from quarry.streaming import batches, visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


class Tables:
    """Tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            SQL[make.__name__] = sql
        return make

    return add


# --- pages -----------------------------------------------------------------------------------------------------------

S = urls.SHAPE
_HOST = f"lower(regexp_replace(regexp_replace(regexp_extract(url, '{S}', 2), '^[^@]*@', ''), ':\\d*\\z', ''))"
_PATH = f"CASE WHEN regexp_extract(url, '{S}', 3) = '' THEN '/' ELSE regexp_extract(url, '{S}', 3) END"


def norm_sql(u: str) -> str:
    """Normal form of a simple absolute URL in SQL."""
    part = lambda k: f"regexp_extract({u}, '{S}', {k})"
    own = f"(CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END)"
    pairs = f"list_filter(string_split(substr({part(4)}, 2), '&'), lambda p: p <> '')"
    keys = f"list_transform({pairs}, lambda p, i: {{'k': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': p}})"
    q = f"array_to_string(list_transform(list_sort({keys}), lambda x: x.p), '&')"
    site = f"(CASE WHEN lower({part(1)}) = 'https' THEN regexp_replace(lower({part(2)}), ':443\\z', '') ELSE regexp_replace(lower({part(2)}), ':80\\z', '') END)"
    trimmed = f"(CASE WHEN {own} <> '/' AND {own} LIKE '%/' THEN {own}[:-2] ELSE {own} END)"
    return f"(lower({part(1)}) || '://' || {site} || {trimmed} || CASE WHEN coalesce({q}, '') = '' THEN '' ELSE '?' || {q} END)"


@query(f"SELECT page_id, {norm_sql('url')} AS normalized_url FROM pages")
def page_normalized_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.normalized(C("url")).alias("normalized_url"))


@query(f"SELECT page_id, left(md5({norm_sql('url')}), 12) AS url_hash FROM pages")
def page_url_hash(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.url_hash(urls.normalized(C("url"))).alias("url_hash"))


@query(f"SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www\\.', '') AS bare_host, {_PATH} AS path, regexp_extract(url, '{S}', 4) AS query, regexp_extract(url, '{S}', 5) AS fragment FROM pages")
def page_url_parts(t: Tables) -> DataFrame:
    u = C("url")
    return t.pages.select("page_id", urls.host(u).alias("host"), urls.bare_host(u).alias("bare_host"), urls.path(u).alias("path"), urls.part(u, 4).alias("query"), urls.part(u, 5).alias("fragment"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(html: str) -> str:
    for pattern, to in text.CLEANING:
        html = f"regexp_replace({html}, {_quoted(pattern)}, {_quoted(to.replace('{1}', chr(92) + '1'))}, 'g')"
    return html


def entities_sql(x: str) -> str:
    for name, char in text.ENTITIES:
        x = f"regexp_replace({x}, {_quoted('(?i)' + name)}, {_quoted(char)}, 'g')"
    return x


_WS = text.SPACE
_LINES = f"list_filter(list_transform(string_split({entities_sql(clean_sql('html'))}, chr(10)), lambda l: regexp_replace(regexp_replace(l, '{_WS}+', ' ', 'g'), '^ +| +\\z', '', 'g')), lambda l: l <> '')"


@query(f"SELECT page_id, length(body) AS n_chars, md5(body) AS text_md5 FROM (SELECT page_id, array_to_string({_LINES}, chr(10)) AS body FROM pages)")
def page_clean_text(t: Tables) -> DataFrame:
    body = t.pages.select("page_id", text.clean_text(C("html")).alias("body"))
    return body.select("page_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("text_md5"))


_TITLE = entities_sql(f"regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '^{_WS}+|{_WS}+\\z', '', 'g')")
_LANG = "regexp_extract(html, '(?i)<html[^>]+lang\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


@query(f"SELECT page_id, {_TITLE} AS title, '' AS description, {_LANG} AS language, NULL::VARCHAR AS canonical_url, NULL::VARCHAR AS og_type FROM pages")
def page_metadata(t: Tables) -> DataFrame:
    m = t.pages.select("page_id", text.page_metadata(C("html")).alias("m"))
    return m.select("page_id", "m.title", "m.description", "m.language", C("m.canonicalUrl").alias("canonical_url"), C("m.ogType").alias("og_type"))


def type_sql(path: str, title: str) -> str:
    out = f"CASE WHEN {path} IN ('/', '') THEN 'homepage'"
    for name, pattern, parts in text.PAGE_TYPES:
        out += f" WHEN regexp_matches({path}, '{pattern}')" + "".join(f" OR contains({title}, '{p}')" for p in parts) + f" THEN '{name}'"
    return out + " ELSE 'other' END"


_TYPED = f"SELECT page_id, url, html, {type_sql(f'lower({_PATH})', f'lower({_TITLE})')} AS page_type FROM pages"


def _typed(t: Tables) -> DataFrame:
    return t.pages.withColumn("page_type", text.page_type(urls.path(C("url")), text.page_title(C("html")), text.meta_content(C("html"), "og:type")))


@query(f"SELECT page_id, page_type FROM ({_TYPED})")
def page_type(t: Tables) -> DataFrame:
    return _typed(t).select("page_id", "page_type")


def resolve_sql(h: str) -> str:
    site = f"(regexp_extract(url, '{S}', 1) || '://' || lower(regexp_extract(url, '{S}', 2)))"
    return f"""CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} WHEN {h} LIKE '//%' THEN regexp_extract(url, '{S}', 1) || ':' || {h}
 WHEN {h} LIKE '/%' THEN {site} || {h} WHEN {h} LIKE '?%' THEN {site} || ({_PATH}) || {h} ELSE {site} || regexp_extract({_PATH}, '^([\\s\\S]*/)', 1) || {h} END"""


_LINKS = f"""SELECT page_id, url, full_url, regexp_replace({_HOST}, '^www\\.', '') AS own, regexp_replace({_HOST.replace('(url', '(full_url')}, '^www\\.', '') AS other
 FROM (SELECT page_id, url, {resolve_sql('h')} AS full_url FROM (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''#]+)', 1))) AS h FROM pages)
 WHERE NOT regexp_matches(h, '^(javascript|mailto|tel|data):')) WHERE regexp_matches(full_url, '(?i)^https?://[^/?#]')"""


@query(f"""SELECT p.page_id, coalesce(n_internal, 0) AS n_internal, coalesce(n_external, 0) AS n_external FROM pages p LEFT JOIN (
 SELECT page_id, count(DISTINCT CASE WHEN own = other THEN {norm_sql('full_url')} END) AS n_internal, count(DISTINCT CASE WHEN own <> other THEN full_url END) AS n_external
 FROM ({_LINKS}) GROUP BY page_id) USING (page_id)""")
def page_links(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", urls.page_links(C("html"), C("url")).alias("l"))
    return links.select("page_id", F.size("l.internal").cast("long").alias("n_internal"), F.size("l.external").cast("long").alias("n_external"))


def _edges(t: Tables) -> DataFrame:
    links = t.pages.select(urls.normalized(C("url")).alias("src"), urls.page_links(C("html"), C("url")).alias("l"))
    return links.select("src", F.explode("l.internal").alias("dst")).distinct()


_EDGES = f"SELECT DISTINCT {norm_sql('url')} AS src, {norm_sql('full_url')} AS dst FROM ({_LINKS}) WHERE own = other"


@query(_EDGES)
def link_edges(t: Tables) -> DataFrame:
    return _edges(t)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(node, depth) AS (SELECT DISTINCT {norm_sql('url')}, 0 FROM pages WHERE page_id < 20 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 2)
 SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def crawl_bfs(t: Tables) -> DataFrame:
    seeds = t.pages.where("page_id < 20").select(urls.normalized(C("url")).alias("node"))
    return crawl.breadth_first(_edges(t), seeds, 2)


_CRAWLED = f"SELECT page_id, url, page_type, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status, strlen(html) AS bytes, page_id % 97 AS ms FROM ({_TYPED})"


def _crawled(t: Tables) -> DataFrame:
    """Pages as a crawl's results: the status and the response time are made from the id."""
    status = F.when(C("page_id") % 17 == 0, 404).otherwise(200)
    return _typed(t).select("page_id", "url", C("page_type").alias("type"), status.alias("status"), F.octet_length("html").cast("long").alias("bytes"), (C("page_id") % 97).alias("ms"))


@query(f"""SELECT count(*) FILTER (status = 200) AS pages_ok, count(*) FILTER (status <> 200) AS pages_failed, coalesce(sum(bytes) FILTER (status = 200), 0)::BIGINT AS total_bytes,
 coalesce(floor(avg(ms) FILTER (status = 200) + 0.5), 0)::BIGINT AS mean_ms, {", ".join(f"count(*) FILTER (status = 200 AND page_type = '{k}') AS type_{k}" for k in crawl.TYPES)} FROM ({_CRAWLED})""")
def crawl_stats(t: Tables) -> DataFrame:
    return crawl.crawl_statistics(_crawled(t))


@query(f"SELECT page_id, page_type FROM ({_CRAWLED}) WHERE status = 200 AND bytes >= 500 AND page_type <> 'legal'")
def crawl_page_filter(t: Tables) -> DataFrame:
    return _crawled(t).where("status = 200 AND bytes >= 500 AND type <> 'legal'").select("page_id", C("type").alias("page_type"))


@query(f"SELECT host, page_id, rank::INT AS rank FROM (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id DESC) AS rank FROM pages) WHERE rank <= 5")
def pages_latest_per_host(t: Tables) -> DataFrame:
    return corpus.newest_per_group(t.pages.select(urls.host(C("url")).alias("host"), "page_id"), ["host"], [F.desc("page_id")], 5)


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: quarry\nDisallow: /en/\nAllow: /en/6\nDisallow: /*.html$\nDisallow:\nCrawl-delay: 2\n"


_RULES = urls.robots_group(urls.parse_robots(ROBOTS), "Quarry/1.0")["rules"]
_ALLOWED = "CASE WHEN regexp_matches(subject, '^/.*\\.html\\z') THEN false WHEN starts_with(subject, '/en/6') THEN true ELSE NOT starts_with(subject, '/en/') END"


@query(f"SELECT page_id, {_ALLOWED} AS allowed FROM (SELECT page_id, ({_PATH}) || regexp_extract(url, '{S}', 4) AS subject FROM pages)")
def robots_allowed(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.robots_allowed(C("url"), _RULES).alias("allowed"))


_INCLUDE, _EXCLUDE = ["/en/**", "**/fr/8*"], ["**?page=*", "*.html", "https://m.**"]


_KEPT = "(regexp_matches(subject, '(?i)^/en/') OR regexp_matches(url, '(?i)^/en/') OR regexp_matches(subject, '(?i)^.*/fr/8[^/]*\\z') OR regexp_matches(url, '(?i)^.*/fr/8[^/]*\\z'))"
_LEFT_OUT = "(contains(lower(url), '?page=') OR regexp_matches(subject, '(?i)^[^/]*\\.html\\z') OR regexp_matches(url, '(?i)^[^/]*\\.html\\z') OR starts_with(lower(url), 'https://m.'))"


@query(f"SELECT page_id, NOT {_LEFT_OUT} AND {_KEPT} AS allowed FROM (SELECT page_id, url, ({_PATH}) || regexp_extract(url, '{S}', 4) AS subject FROM pages)")
def glob_filter(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.glob_allowed(C("url"), _INCLUDE, _EXCLUDE).alias("allowed"))


# --- visits and mentions ---------------------------------------------------------------------------------------------

_AGENTS = ["Mozilla GPTBot/1.1", "x ChatGPT-User", "Claude-Web Anthropic", "Anthropic PerplexityBot", "gptbot lower", "cohere Cohere", "Bytespider; CCBot", "Mozilla/5.0"]
_AGENT = "CASE user_id % 8 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_AGENTS)) + " END"


def _crawler_sql(field: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(agent, '{r[0]}') THEN '{r[field]}'" for r in mentions.CRAWLERS) + " END"


_VISITS = f"SELECT event_id, ts, {_crawler_sql(1)} AS crawler, {_crawler_sql(2)} AS org FROM (SELECT event_id, ts, {_AGENT} AS agent FROM events)"


def _visits(t: Tables) -> DataFrame:
    """Events as visits: the user agent is made from the user."""
    return visits.detected(t.events.withColumn("agent", F.expr(_AGENT)).select("event_id", "ts", "agent"))


@query(f"SELECT event_id, crawler, org FROM ({_VISITS}) WHERE crawler IS NOT NULL")
def crawler_detect(t: Tables) -> DataFrame:
    return _visits(t).select("event_id", "crawler", "org")


@query(f"SELECT crawler, count(*) AS visits FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY crawler")
def crawler_counts(t: Tables) -> DataFrame:
    return visits.counts(_visits(t))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, crawler, count(*) AS visits FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY ALL")
def daily_visits(t: Tables) -> DataFrame:
    return _visits(t).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "crawler").agg(F.count(F.lit(1)).alias("visits"))


@query(f"SELECT event_id, crawler FROM ({_VISITS}) WHERE crawler IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_visits(t: Tables) -> DataFrame:
    return _visits(t).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "crawler")


@query(f"SELECT name, ordinal, visits FROM (SELECT crawler AS name, count(*) AS visits FROM ({_VISITS}) GROUP BY 1) JOIN (VALUES {', '.join(f'({k}, {_quoted(r[1])})' for k, r in enumerate(mentions.CRAWLERS))}) c(ordinal, name) USING (name)")
def visit_totals(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame([(k, r[1]) for k, r in enumerate(mentions.CRAWLERS)], "ordinal int, name string")
    return listed.join(visits.counts(_visits(t)).withColumnRenamed("crawler", "name"), "name").select("name", "ordinal", "visits")


@query(f"SELECT sum(visits)::BIGINT AS total FROM (SELECT count(*) AS visits FROM ({_VISITS}) WHERE crawler IS NOT NULL)")
def visit_grand_total(t: Tables) -> DataFrame:
    return visits.counts(_visits(t)).agg(F.sum("visits").alias("total"))


_CHECKS = "SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, event_type AS platform, 'entity-' || user_id AS entity, json_extract_string(props, '$.k')::INT % 5 = 0 AS cited FROM events"


def _checks(t: Tables) -> DataFrame:
    """Events as citation checks: platform by type, entity by user, cited by a property."""
    cited = F.get_json_object("props", "$.k").cast("int") % 5 == 0
    return t.events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), C("event_type").alias("platform"), F.concat(F.lit("entity-"), "user_id").alias("entity"), cited.alias("cited"))


@query(f"SELECT platform, count(*) AS checked, count(*) FILTER (cited) AS cited FROM ({_CHECKS}) GROUP BY platform")
def platform_breakdown(t: Tables) -> DataFrame:
    return _checks(t).groupBy("platform").agg(F.count(F.lit(1)).alias("checked"), F.count_if("cited").alias("cited"))


@query(f"SELECT count(*) AS total_checks, count(*) FILTER (cited) AS citations, count(DISTINCT entity) AS entities FROM ({_CHECKS})")
def run_totals(t: Tables) -> DataFrame:
    return _checks(t).agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("cited").alias("citations"), F.countDistinct("entity").alias("entities"))


@query(f"SELECT event_id, platform, entity FROM ({_CHECKS}) WHERE cited")
def cited_results(t: Tables) -> DataFrame:
    return _checks(t).where("cited").select("event_id", "platform", "entity")


_DAILY = f"""SELECT d.day, d.total_checks, d.citations, d.platforms, coalesce(c.cited_entities, '') AS cited_entities FROM
 (SELECT day, sum(n)::BIGINT AS total_checks, sum(c)::BIGINT AS citations, string_agg(platform || ':' || n || '/' || c, ',' ORDER BY platform) AS platforms FROM (SELECT day, platform, count(*) AS n, count(*) FILTER (cited) AS c FROM ({_CHECKS}) GROUP BY ALL) GROUP BY day) d
 LEFT JOIN (SELECT day, string_agg(entity, ',' ORDER BY event_id) AS cited_entities FROM ({_CHECKS}) WHERE cited GROUP BY day) c USING (day)"""


def _daily(t: Tables) -> DataFrame:
    return visits.daily_aggregates(_checks(t))


@query(_DAILY)
def daily_aggregate(t: Tables) -> DataFrame:
    d = _daily(t)
    platforms = F.transform(F.array_sort(F.map_entries("platforms")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["checked"].cast("string"), F.lit("/"), e["value"]["cited"].cast("string")))
    return d.select("day", "total_checks", "citations", F.array_join(platforms, ",").alias("platforms"), F.array_join("cited_entities", ",").alias("cited_entities"))


@query(f"SELECT day, citations FROM ({_DAILY}) WHERE citations > 0 ORDER BY day LIMIT 1")
def first_citation(t: Tables) -> DataFrame:
    return _daily(t).where("citations > 0").orderBy("day").limit(1).select("day", "citations")


@query(f"SELECT day, total_checks, citations FROM ({_DAILY}) ORDER BY day DESC LIMIT 10")
def history_top_n(t: Tables) -> DataFrame:
    return _daily(t).orderBy(F.desc("day")).limit(10).select("day", "total_checks", "citations")


@query(f"SELECT sum(total_checks)::BIGINT AS total_checks, sum(citations)::BIGINT AS citations FROM (SELECT * FROM ({_DAILY}) ORDER BY day DESC LIMIT 30)")
def history_totals(t: Tables) -> DataFrame:
    return _daily(t).orderBy(F.desc("day")).limit(30).agg(F.sum("total_checks").alias("total_checks"), F.sum("citations").alias("citations"))


@query(f"SELECT day FROM ({_DAILY}) WHERE CAST(day AS DATE) > DATE '2024-04-15' - 90")
def retention_90d(t: Tables) -> DataFrame:
    return visits.retained(_daily(t), F.lit("2024-04-15").cast("date"), 90).select("day")


@query("""SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS said
 FROM (SELECT event_id, ts, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) // 60000000 AS m FROM events)""")
def relative_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", render.relative_time(C("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("said"))


_PLATFORM = {"click": "Perplexity", "view": "ChatGPT", "signup": "Google AI Mode"}


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PLATFORM.items()) + " ELSE event_type END AS platform_name FROM events")
def platform_name(t: Tables) -> DataFrame:
    return t.events.select("event_id", render.choose(C("event_type"), _PLATFORM, C("event_type")).alias("platform_name"))


@query("SELECT event_id, replace(replace(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z', ':', '-'), '.', '-') AS token, strftime(ts, '%Y%m%d_%H%M%S') AS crawl_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS rfc FROM events")
def time_tokens(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.translate(render.iso_date(C("ts")), ":.", "--").alias("token"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("crawl_id"), render.rfc_date(C("ts")).alias("rfc"))


@query(f"SELECT crawler, count(*) AS visits FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY crawler")
def stream_crawler_counts(t: Tables) -> DataFrame:
    return visits.run_once(t.spark, f"{t.sf_dir}/events.parquet", lambda s: visits.counts(visits.detected(s.withColumn("agent", F.expr(_AGENT)))), "complete")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, crawler, count(*) AS visits FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY ALL")
def stream_daily_visits(t: Tables) -> DataFrame:
    found = visits.run_once(t.spark, f"{t.sf_dir}/events.parquet", lambda s: visits.daily(visits.detected(s.withColumn("agent", F.expr(_AGENT))), "1 day"), "complete")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "crawler", "visits")


@query(f"SELECT event_id, crawler FROM ({_VISITS}) WHERE crawler IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1000")
def stream_recent_visits(t: Tables) -> DataFrame:
    return visits.recent_by_stream(t.spark, f"{t.sf_dir}/events.parquet", lambda s: visits.detected(s.withColumn("agent", F.expr(_AGENT))).select("event_id", "ts", "crawler"), 1000).select("event_id", "crawler")


_LAST_RUNS = f"SELECT * FROM (SELECT *, CASE WHEN hour(ts) < 20 THEN 'a' ELSE 'b' END AS run FROM ({_CHECKS})) QUALIFY run = max(run) OVER (PARTITION BY day)"


@query(f"SELECT day, total_checks, citations, cited_entities FROM ({_DAILY.replace(_CHECKS, _LAST_RUNS)})")
def stream_daily_upsert(t: Tables) -> DataFrame:
    """A day has two runs, of which the last one counts."""

    def checks(s: DataFrame) -> DataFrame:
        cited = F.get_json_object("props", "$.k").cast("int") % 5 == 0
        run = F.when(F.hour("ts") < 20, "a").otherwise("b")
        return s.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), run.alias("run"), C("event_type").alias("platform"), F.concat(F.lit("entity-"), "user_id").alias("entity"), cited.alias("cited"))

    found = visits.upsert_daily_by_stream(t.spark, _event_files(t), checks, files=1)
    return found.select("day", "total_checks", "citations", F.array_join("cited_entities", ",").alias("cited_entities"))


def _event_files(t: Tables, parts: list[int] | None = None, folder: str | None = None, n: int = 4) -> str:
    """The events dealt out to n files by id, so that every day and run is in each of them; the files of `parts`, in this order."""
    folder = folder or new_folder(t.spark, "events")
    for k in range(n) if parts is None else parts:
        t.events.where(C("event_id") % n == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _agents(s: DataFrame) -> DataFrame:
    return visits.detected(s.withColumn("agent", F.expr(_AGENT))).select("event_id", "ts", "crawler")


@query(f"""SELECT 'total' AS kind, crawler AS key, count(*) AS n FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY crawler
 UNION ALL SELECT 'daily', strftime(ts, '%Y-%m-%d') || ' ' || crawler, count(*) FROM ({_VISITS}) WHERE crawler IS NOT NULL AND CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) - 20 FROM ({_VISITS}) WHERE crawler IS NOT NULL) GROUP BY ALL
 UNION ALL SELECT 'recent', crawler, event_id FROM (SELECT * FROM ({_VISITS}) WHERE crawler IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1000)""")
def stream_visit_log(t: Tables) -> DataFrame:
    """One log of list, totals and days over eight files, a batch each, in two runs, with folds between; days expire after 20."""
    source, place = new_folder(t.spark, "events"), new_folder(t.spark, "visit-log")
    log = visits.VisitLog(t.spark, place, 1000, 20)
    for parts in ([0, 5, 2], [1, 3, 4, 7, 6]):
        _event_files(t, parts, source, 8)
        log.follow(_agents(batches.source(t.spark, source, 1)), fold_every=3)
    day = log.daily().select(F.lit("daily").alias("kind"), F.concat("day", F.lit(" "), "crawler").alias("key"), C("visits").alias("n"))
    return log.totals().select(F.lit("total").alias("kind"), C("crawler").alias("key"), C("visits").alias("n")).unionByName(day).unionByName(log.recent().select(F.lit("recent").alias("kind"), C("crawler").alias("key"), C("event_id").alias("n")))


@query(f"SELECT crawler, count(*) AS visits, 4 AS batches FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY crawler")
def stream_restarted(t: Tables) -> DataFrame:
    """Counts in update mode over a run that ended after its first file and was started again with three more; a third run has nothing new."""
    source, place = new_folder(t.spark, "events"), new_folder(t.spark, "restarted")
    for parts in ([2], [0, 1, 3], []):
        _event_files(t, parts, source)
        found = visits.run_once(t.spark, source, lambda s: visits.counts(_agents(s)), "update", ["crawler"], place, 1)
    n = len(batches.BatchLog(t.spark, f"{place}/log").batches())
    return found.withColumn("batches", F.lit(n))


#: Files of the late-data query: ten files by days, of which the eighth also has the rows of earlier days that came late.
_LATE_SQL = "CASE WHEN event_id % 11 = 0 AND day(ts) < 22 THEN 8 ELSE (day(ts) - 1) // 3 END"


@query(f"""WITH v AS (SELECT *, {_LATE_SQL} AS file FROM ({_VISITS}) WHERE crawler IS NOT NULL),
 seen AS (SELECT file, max(ts) AS ts FROM v GROUP BY file), ends AS (SELECT (SELECT max(ts) FROM seen WHERE file <= 6) - INTERVAL 3 DAY AS late, (SELECT max(ts) FROM seen) - INTERVAL 3 DAY AS closed)
 SELECT strftime(ts, '%Y-%m-%d') AS day, crawler, count(*) AS visits FROM v, ends WHERE (file <> 8 OR date_trunc('day', ts) + INTERVAL 1 DAY > late OR day(ts) >= 22) AND date_trunc('day', ts) + INTERVAL 1 DAY <= closed GROUP BY ALL""")
def stream_late_visits(t: Tables) -> DataFrame:
    """Days are given once, when the watermark of three days has passed them: what comes later than that counts no more, what comes late within it does."""
    source = new_folder(t.spark, "events")
    day = F.dayofmonth("ts")
    file = F.when((C("event_id") % 11 == 0) & (day < 22), 8).otherwise(F.floor((day - 1) / 3))
    for k in range(10):
        t.events.where(file == k).coalesce(1).write.mode("append").parquet(source)
    found = visits.run_once(t.spark, source, lambda s: visits.daily(_agents(s), "3 days"), "append", files=1)
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "crawler", "visits")


# --- corpus ----------------------------------------------------------------------------------------------------------

_STATUS = {"F": "asserted", "O": "disputed", "P": "corrected"}
_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'asserted' WHEN 'O' THEN 'disputed' WHEN 'P' THEN 'corrected' ELSE 'tombstoned' END"
_ORDER = ["asserted", "disputed", "corrected", "tombstoned"]


def _claims(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", render.choose(C("o_orderstatus"), _STATUS, "tombstoned").alias("status"))


@query("SELECT 'claims' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'topics', count(*) FROM part")
def corpus_counts(t: Tables) -> DataFrame:
    one = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("claims", t.orders).union(one("entities", t.customer)).union(one("sources", t.supplier)).union(one("topics", t.part))


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS n_claims FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def claims_per_entity(t: Tables) -> DataFrame:
    return corpus.references_per_key(t.customer.select("c_custkey"), t.orders.select(C("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")


@query("SELECT p_partkey, count(DISTINCT l_orderkey) AS n_claims FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def claims_per_topic(t: Tables) -> DataFrame:
    return corpus.references_per_key(t.part.select("p_partkey"), t.lineitem.select(C("l_partkey").alias("p_partkey"), "l_orderkey"), "p_partkey", "l_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_STATUS_SQL} AS status FROM orders) WHERE status = 'disputed'")
def claims_by_status(t: Tables) -> DataFrame:
    return _claims(t).where("status = 'disputed'").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def claims_for_entity(t: Tables) -> DataFrame:
    return _claims(t).where("o_custkey = 7").select("o_orderkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 11")
def claims_for_topic(t: Tables) -> DataFrame:
    return t.lineitem.where("l_partkey = 11").select("l_orderkey").distinct()


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 5")
def claims_for_source(t: Tables) -> DataFrame:
    return t.lineitem.where("l_suppkey = 5").select("l_orderkey").distinct()


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey BETWEEN 10 AND 14)")
def sources_for_claim(t: Tables) -> DataFrame:
    cited = t.lineitem.where("l_orderkey BETWEEN 10 AND 14").select(C("l_suppkey").alias("s_suppkey"))
    return corpus.cited_sources(cited, t.supplier, "s_suppkey").select("s_suppkey", "s_name")


@query("SELECT l_orderkey, string_agg(coalesce(s_name, l_suppkey::VARCHAR), ';' ORDER BY l_linenumber, l_suppkey, l_partkey) AS sources FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON l_suppkey = s_suppkey GROUP BY l_orderkey")
def claim_citations_named(t: Tables) -> DataFrame:
    known = t.supplier.where("s_suppkey % 3 <> 0").select(C("s_suppkey").alias("l_suppkey"), "s_name")
    rows = corpus.named(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), known, "l_suppkey", "s_name", "source")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "source")))
    return rows.groupBy("l_orderkey").agg(F.array_join(ordered["source"], ";").alias("sources"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, l_partkey::VARCHAR) AS topic FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def topic_names(t: Tables) -> DataFrame:
    known = t.part.where("p_size > 10").select(C("p_partkey").alias("l_partkey"), "p_name")
    return corpus.named(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), known, "l_partkey", "p_name", "topic")


@query("SELECT l_orderkey, string_agg('Unknown source: ' || l_suppkey, ';' ORDER BY l_suppkey) AS errors FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0) GROUP BY l_orderkey")
def xref_missing(t: Tables) -> DataFrame:
    refs = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    lost = corpus.missing_references(refs, [t.supplier.where("s_suppkey % 5 <> 0").select(C("s_suppkey").alias("l_suppkey"))], "l_suppkey")
    said = F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda k: F.concat(F.lit("Unknown source: "), k.cast("string")))
    return lost.groupBy("l_orderkey").agg(F.array_join(said, ";").alias("errors"))


@query("""SELECT o_orderkey, l_suppkey, l_partkey, NOT topic_known AS topic_warning, NOT source_known AS source_error FROM (SELECT o_orderkey, l_suppkey, l_partkey, l_suppkey % 5 <> 0 OR l_suppkey % 10 = 0 AS source_known, l_partkey % 4 <> 0 OR l_partkey % 8 = 0 AS topic_known
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE NOT topic_known OR NOT source_known""")
def draft_refs_missing(t: Tables) -> DataFrame:
    refs = t.orders.join(t.lineitem, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "l_suppkey", "l_partkey")
    sources, topics = t.supplier.select(C("s_suppkey").alias("l_suppkey")), t.part.select(C("p_partkey").alias("l_partkey"))
    known_s = sources.where("l_suppkey % 5 <> 0").union(sources.where("l_suppkey % 10 = 0")).distinct().withColumn("_s", F.lit(True))
    known_t = topics.where("l_partkey % 4 <> 0").union(topics.where("l_partkey % 8 = 0")).distinct().withColumn("_t", F.lit(True))
    both = refs.join(known_s, "l_suppkey", "left").join(known_t, "l_partkey", "left")
    return both.where("_s IS NULL OR _t IS NULL").select("o_orderkey", "l_suppkey", "l_partkey", C("_t").isNull().alias("topic_warning"), C("_s").isNull().alias("source_error"))


_HIERARCHY = "SELECT n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey = 24 THEN 99 ELSE n_nationkey // 5 * 5 END AS parent FROM nation"


def _hierarchy(t: Tables) -> DataFrame:
    """Nations as entities: every fifth is a root, the others its children, and one has a parent that doesn't exist."""
    key = C("n_nationkey")
    parent = F.when(key % 5 == 0, F.lit(None)).when(key == 24, 99).otherwise(key - key % 5)
    return t.nation.select(key.alias("key"), C("n_name").alias("name"), parent.alias("parent"))


@query(f"SELECT c.key, c.name, p.name AS parent_name FROM ({_HIERARCHY}) c LEFT JOIN ({_HIERARCHY}) p ON c.parent = p.key")
def parent_entity(t: Tables) -> DataFrame:
    h = _hierarchy(t)
    return h.join(h.select(C("key").alias("parent"), C("name").alias("parent_name")), "parent", "left").select("key", "name", "parent_name")


@query(f"SELECT p.key, coalesce(string_agg(c.name, ',' ORDER BY c.key), '') AS subsidiaries FROM ({_HIERARCHY}) p LEFT JOIN ({_HIERARCHY}) c ON c.parent = p.key GROUP BY p.key")
def subsidiaries(t: Tables) -> DataFrame:
    h = _hierarchy(t)
    below = h.where("parent IS NOT NULL").groupBy(C("parent").alias("key")).agg(F.array_sort(F.collect_list(F.struct("key", "name")))["name"].alias("names"))
    return h.select("key").join(below, "key", "left").select("key", F.coalesce(F.array_join("names", ","), F.lit("")).alias("subsidiaries"))


@query(f"SELECT o_orderkey, status, row_number() OVER (ORDER BY CASE status WHEN 'asserted' THEN 0 WHEN 'disputed' THEN 1 WHEN 'corrected' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey)::INT AS place FROM (SELECT *, {_STATUS_SQL} AS status FROM orders WHERE o_custkey = 7)")
def claims_sorted(t: Tables) -> DataFrame:
    own = _claims(t).where("o_custkey = 7")  # one entity's page
    order = Window.partitionBy(F.lit(0)).orderBy(corpus.status_rank(C("status"), _ORDER), F.desc("o_orderdate"), "o_orderkey")
    return own.select("o_orderkey", "status", F.row_number().over(order).alias("place"))


@query(f"SELECT o_orderkey, {_STATUS_SQL} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def claims_latest(t: Tables) -> DataFrame:
    return _claims(t).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "status")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_claims FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def entity_index(t: Tables) -> DataFrame:
    counted = corpus.references_per_key(t.customer.select("c_custkey", "c_name"), t.orders.select(C("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")
    return counted.orderBy(F.collate("c_name", "UNICODE"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber AS version, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem WHERE l_linenumber > 1")
def corrections_log(t: Tables) -> DataFrame:
    log = t.lineitem.select("l_orderkey", C("l_linenumber").alias("version"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    return corpus.corrections(log).orderBy(F.desc("date"))


@query(f"""SELECT c_custkey, count(DISTINCT o_orderkey) AS claims, count(DISTINCT CASE WHEN status = 'asserted' THEN o_orderkey END) AS asserted, count(DISTINCT CASE WHEN status = 'corrected' THEN o_orderkey END) AS corrections,
 count(DISTINCT l_partkey) AS topics, count(DISTINCT l_suppkey) AS sources FROM customer LEFT JOIN (SELECT *, {_STATUS_SQL} AS status FROM orders) ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey""")
def client_dashboard(t: Tables) -> DataFrame:
    claims = _claims(t)
    per = claims.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("claims"), F.count_if(C("status") == "asserted").alias("asserted"), F.count_if(C("status") == "corrected").alias("corrections"))
    used = claims.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), C("o_orderkey") == C("l_orderkey"))
    topics = used.select("o_custkey", "l_partkey").distinct().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("topics"))
    sources = used.select("o_custkey", "l_suppkey").distinct().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("sources"))
    out = t.customer.select(C("c_custkey").alias("o_custkey")).join(per, "o_custkey", "left").join(topics, "o_custkey", "left").join(sources, "o_custkey", "left")
    return out.select(C("o_custkey").alias("c_custkey"), *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("claims", "asserted", "corrections", "topics", "sources")])


@query(f"SELECT o_orderkey, status FROM (SELECT o_orderkey, {_STATUS_SQL} AS status FROM orders) WHERE status <> 'asserted'")
def non_asserted(t: Tables) -> DataFrame:
    return _claims(t).where("status <> 'asserted'").select("o_orderkey", "status")


# --- names and drafts ------------------------------------------------------------------------------------------------

_SLUG = lambda x: f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+\\z', '', 'g'), 50)"
_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '{names.SUFFIX}', ''), '\\s+', ' ', 'g'))"
_CUT = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '-inc\\z', ''), '-llc\\z', ''), '-corp\\z', ''), '-group\\z', '')"
_COMPANY = "s_name || CASE s_suppkey % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Group' WHEN 3 THEN ' Co' WHEN 4 THEN '''s Policy' ELSE '' END"


@query(f"SELECT s_suppkey, {_SLUG(_COMPANY)} AS slug FROM supplier")
def slugify(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", names.slug(F.expr(_COMPANY.replace("'''s", "\"'s").replace("Policy'", 'Policy"'))).alias("slug"))


@query(f"SELECT p_partkey, {_NORM('p_name')} AS normalized, {_SLUG('p_name')} AS slug FROM part")
def normalize_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.normalized_name(C("p_name")).alias("normalized"), names.slug(C("p_name")).alias("slug"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(h, '^www\\.', ''), '\\.(com|org|net|io|co|ai)\\z', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+\\z', '', 'g') AS slug FROM (SELECT page_id, " + _HOST + " AS h FROM pages)")
def domain_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", names.domain_slug(urls.host(C("url"))).alias("slug"))


_ENTITY = f"SELECT s_suppkey AS ord, {_COMPANY} AS name, {_SLUG(_COMPANY)} AS slug FROM supplier WHERE s_suppkey % 2 = 0"


@query(f"""WITH e AS ({_ENTITY}), sure AS (SELECT alias, arg_max(slug, ord * 2 + kind) AS slug FROM (SELECT slug AS alias, slug, ord, 0 AS kind FROM e UNION ALL SELECT {_NORM('name')}, slug, ord, 1 FROM e) GROUP BY alias),
 cut AS (SELECT alias, arg_min(slug, ord) AS slug FROM (SELECT {_CUT('slug')} AS alias, slug, ord FROM e) WHERE alias <> slug AND alias NOT IN (SELECT alias FROM sure) GROUP BY alias), a AS (SELECT * FROM sure UNION ALL SELECT * FROM cut),
 n AS (SELECT s_suppkey, {_SLUG(_COMPANY)} AS raw, {_NORM(_COMPANY)} AS norm FROM supplier), m AS (SELECT *, regexp_replace({_CUT('raw')}, '-s-.*\\z', '') AS cut FROM n)
 SELECT s_suppkey, coalesce(a1.slug, a2.slug, a3.slug, nullif(m.cut, ''), raw) AS resolved FROM m LEFT JOIN a a1 ON raw = a1.alias LEFT JOIN a a2 ON norm = a2.alias LEFT JOIN a a3 ON m.cut = a3.alias""")
def alias_resolve(t: Tables) -> DataFrame:
    name = F.expr(_COMPANY.replace("'''s", "\"'s").replace("Policy'", 'Policy"')).alias("name")
    known = t.supplier.where("s_suppkey % 2 = 0").select(C("s_suppkey").alias("ord"), name).withColumn("slug", names.slug(C("name")))
    return names.resolve_names(t.supplier.select("s_suppkey", name), names.alias_map(known)).select("s_suppkey", "resolved")


_DRAFT = "SELECT doc_id, 'entity-' || (doc_id % 97) AS slug, source || '-name' AS name, CASE WHEN n_chars % 3 = 0 THEN 'high' WHEN n_chars % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence, 'page-' || (n_chars % 7) AS page, 'batch-' || (doc_id % 5) AS batch, (n_chars % 4)::INT AS n_pages FROM documents"


def _drafts(t: Tables) -> DataFrame:
    """Documents as draft entities."""
    n = C("n_chars")
    level = F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low")
    text_of = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    return t.documents.select("doc_id", text_of("entity-", C("doc_id") % 97).alias("slug"), F.concat("source", F.lit("-name")).alias("name"), level.alias("confidence"), text_of("page-", n % 7).alias("page"), text_of("batch-", C("doc_id") % 5).alias("batch"), (n % 4).cast("int").alias("n_pages"))


_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query(f"""WITH d AS ({_DRAFT}), p AS (SELECT slug, page, min(doc_id) AS first FROM d GROUP BY ALL) SELECT slug, arg_min(name, doc_id) AS name, CASE max({_RANK}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
 (SELECT string_agg(page, ',' ORDER BY first) FROM p WHERE p.slug = d.slug) AS pages FROM d GROUP BY slug""")
def merge_results(t: Tables) -> DataFrame:
    merged = drafts.merge_entities(_drafts(t), "doc_id")
    return merged.select("slug", "name", "confidence", F.array_join("pages", ",").alias("pages"))


@query(f"SELECT doc_id, page FROM ({_DRAFT}) QUALIFY row_number() OVER (PARTITION BY page ORDER BY doc_id) = 1")
def first_source_per_url(t: Tables) -> DataFrame:
    return drafts.first_per_key(_drafts(t).select("doc_id", "page"), "page", "doc_id")


_HOME = {"entity-3": "batch-2", "entity-10": "batch-0", "entity-50": "batch-9"}
_HOME_SQL = "CASE slug " + " ".join(f"WHEN '{k}' THEN starts_with(batch, '{v}')" for k, v in _HOME.items()) + " ELSE false END"


@query(f"SELECT slug, batch, doc_id FROM (SELECT *, {_HOME_SQL} AS home, {_RANK} AS r FROM ({_DRAFT})) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY home DESC, CASE WHEN home THEN 0 ELSE r END DESC, CASE WHEN home THEN 0 ELSE n_pages END DESC, doc_id) = 1")
def best_version(t: Tables) -> DataFrame:
    homes = t.spark.createDataFrame(list(_HOME.items()), "slug string, home string")
    rows = _drafts(t).join(F.broadcast(homes), "slug", "left").withColumn("is_home", F.coalesce(F.startswith("batch", "home"), F.lit(False)))
    best = drafts.best_versions(rows.withColumn("rank", drafts.confidence_rank(C("confidence"))).withColumn("batch_ord", C("doc_id")))
    return best.select("slug", "batch", "doc_id")


@query(f"SELECT slug FROM ({_DRAFT}) GROUP BY slug HAVING count(DISTINCT batch) > 1")
def cross_batch_slugs(t: Tables) -> DataFrame:
    return _drafts(t).groupBy("slug").agg(F.countDistinct("batch").alias("n")).where("n > 1").select("slug")


def _noise_sql(slug: str, name: str, type_: str, description: str) -> str:
    r = EXAMPLE
    either = "(?i)(?:" + "|".join(p.replace("$", "\\z") for p in r.patterns) + ")"
    word = r"(?:^|[^A-Za-z0-9_])" + r.described + r"(?:[^A-Za-z0-9_]|\z)"
    return (
        f"({slug} IN ({', '.join(map(_quoted, r.slugs + r.promotions))}) OR regexp_matches({name}, {_quoted(either)}) OR regexp_matches({slug}, {_quoted(either)})"
        f" OR regexp_matches({slug}, {_quoted('^(?:' + '|'.join(r.prefixes) + ')')}) OR regexp_matches({slug}, {_quoted('|'.join(p.replace('$', chr(92) + 'z') for p in r.slug_patterns))})"
        f" OR (regexp_matches(lower({description}), {_quoted(word)}) AND {type_} NOT IN ('organization', 'person')))"
    )


_DISHES = ["Tuna Roll", "Springdale", "mio-water", "Gift Cards", "Plain name", "Plum Wine", "A to Z Rosé", "Kona Grill Tampa"]
_NOISY = "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {_quoted(d)}" for k, d in enumerate(_DISHES)) + " END AS name, CASE WHEN p_size % 2 = 0 THEN 'organization' ELSE 'product' END AS type, CASE WHEN p_size % 5 = 0 THEN 'A dish of ' || p_name ELSE 'dishes: ' || p_name END AS description FROM part"


@query(f"SELECT p_partkey FROM (SELECT *, {_SLUG('name')} AS slug FROM ({_NOISY})) WHERE {_noise_sql('slug', 'name', 'type', 'description')}")
def noise_filter(t: Tables) -> DataFrame:
    rows = t.spark.sql(_NOISY.replace("FROM part", "FROM {part}"), part=t.part)
    return rows.where(noise.is_noise(names.slug(C("name")), C("name"), C("type"), C("description"), EXAMPLE)).select("p_partkey")


_REFS = "SELECT l_orderkey, l_linenumber AS ord, 'e' || (l_partkey % 3) AS slug, l_returnflag AS role, l_partkey FROM lineitem"


@query(f"SELECT l_orderkey, string_agg(slug || ':' || role, ',' ORDER BY ord, l_partkey, role) AS refs FROM (SELECT * FROM ({_REFS}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, slug ORDER BY ord, l_partkey, role) = 1) GROUP BY l_orderkey")
def ref_dedup(t: Tables) -> DataFrame:
    refs = t.lineitem.select("l_orderkey", F.struct(C("l_linenumber").alias("ord"), "l_partkey", C("l_returnflag").alias("role"), F.concat(F.lit("e"), (C("l_partkey") % 3).cast("string")).alias("slug")).alias("r"))
    per = refs.groupBy("l_orderkey").agg(drafts.first_role_per_slug(F.array_sort(F.collect_list("r"))).alias("refs"))
    return per.select("l_orderkey", F.array_join(F.transform("refs", lambda r: F.concat(r["slug"], F.lit(":"), r["role"])), ",").alias("refs"))


_MOVES = [("entity-1", "entity-2"), ("entity-2", "entity-3"), ("entity-90", "entity-0")]


@query("SELECT doc_id, CASE slug " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MOVES) + f" ELSE slug END AS slug FROM ({_DRAFT})")
def slug_remap(t: Tables) -> DataFrame:
    return drafts.remap(_drafts(t).select("doc_id", "slug"), F.broadcast(t.spark.createDataFrame(_MOVES, "variant string, canonical string")), "slug").select("doc_id", "slug")


_ACTION = "CASE WHEN slug IN ('entity-1', 'entity-2', 'entity-90') THEN 'merge' WHEN row_number() OVER (PARTITION BY slug ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'keep' END"


@query(f"SELECT action, count(*) AS n FROM (SELECT {_ACTION} AS action FROM ({_DRAFT})) GROUP BY action")
def dedup_summary(t: Tables) -> DataFrame:
    per = _drafts(t).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))  # one of a slug's drafts is kept, the others are duplicates
    moved = C("slug").isin([a for a, _ in _MOVES])
    kinds = F.array(F.struct(F.lit("merge").alias("action"), F.when(moved, C("n")).otherwise(0).alias("n")), F.struct(F.lit("keep").alias("action"), F.when(moved, 0).otherwise(1).alias("n")), F.struct(F.lit("duplicate").alias("action"), F.when(moved, 0).otherwise(C("n") - 1).alias("n")))
    return per.select(F.inline(kinds)).groupBy("action").agg(F.sum("n").alias("n")).where("n > 0")


@query(f"SELECT count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM ({_DRAFT})")
def confidence_histogram(t: Tables) -> DataFrame:
    return _drafts(t).agg(*[F.count_if(C("confidence") == k).alias(k) for k in ("high", "medium", "low")])


_RECORD = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'bad id' ELSE 'src_' || lpad(doc_id::VARCHAR, 8, '0') END AS id, left(coalesce(text, ''), 20) AS title, CASE WHEN doc_id % 7 = 0 THEN 'no url' ELSE 'https://example.org/' || doc_id END AS url, CASE WHEN doc_id % 13 = 0 THEN '2026-1-1' ELSE '2026-99-99' END AS accessDate, left(text, 600) AS excerpt FROM documents"


def _records(t: Tables) -> DataFrame:
    d = C("doc_id")
    return t.documents.select(
        d,
        F.when(d % 11 == 0, "bad id").otherwise(F.concat(F.lit("src_"), F.lpad(d.cast("string"), 8, "0"))).alias("id"),
        F.left(F.coalesce("text", F.lit("")), F.lit(20)).alias("title"),
        F.when(d % 7 == 0, "no url").otherwise(F.concat(F.lit("https://example.org/"), d.cast("string"))).alias("url"),
        F.when(d % 13 == 0, "2026-1-1").otherwise("2026-99-99").alias("accessDate"),
        F.left("text", F.lit(600)).alias("excerpt"),
    )


_ERRORS = "concat_ws(',', CASE WHEN NOT regexp_matches(id, '^src_[a-z0-9]{8}\\z') THEN 'id' END, CASE WHEN title = '' THEN 'title' END, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') THEN 'url' END, CASE WHEN NOT regexp_matches(accessDate, '^\\d{4}-\\d{2}-\\d{2}\\z') THEN 'accessDate' END, CASE WHEN length(excerpt) > 500 THEN 'excerpt' END)"


@query(f"SELECT doc_id, {_ERRORS} AS errors FROM ({_RECORD})")
def validate_records(t: Tables) -> DataFrame:
    return drafts.check_rules(_records(t), drafts.some_source_rules()).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query(f"SELECT count(*) AS total, count(*) FILTER (errors = '') AS valid, count(*) FILTER (errors <> '') AS invalid FROM (SELECT {_ERRORS} AS errors FROM ({_RECORD}))")
def validation_summary(t: Tables) -> DataFrame:
    checked = drafts.check_rules(_records(t), drafts.some_source_rules())
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"))


@query(f"""SELECT 'all' AS batch, doc_id FROM ({_RECORD}) WHERE (SELECT count(*) FROM (SELECT {_ERRORS} AS errors FROM ({_RECORD})) WHERE errors <> '') = 0
 UNION ALL SELECT 'good', doc_id FROM (SELECT doc_id, {_ERRORS} AS errors FROM ({_RECORD})) WHERE errors = ''""")
def approval_gate(t: Tables) -> DataFrame:
    """A batch with any bad record gives none of its records; one without gives all of them."""
    checked = drafts.check_rules(_records(t), drafts.some_source_rules())
    some = drafts.all_or_nothing(checked).select(F.lit("all").alias("batch"), "doc_id")
    return some.union(drafts.all_or_nothing(checked.where(F.size("errors") == 0)).select(F.lit("good").alias("batch"), "doc_id"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'old' ELSE 'new' END AS version FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def approve_upsert(t: Tables) -> DataFrame:
    new = t.labels.where("quality IS NOT NULL").select("doc_id").distinct().join(t.documents.select("doc_id"), "doc_id", "left_semi").withColumn("version", F.lit("new"))
    return corpus.upsert(t.documents.select("doc_id").withColumn("version", F.lit("old")), new, "doc_id")


# --- publishing ------------------------------------------------------------------------------------------------------


@query(f"""SELECT o_orderkey, '{{"@context":"https://schema.org","@type":"Claim","@id":"{render.BASE}/claims/' || o_orderkey || '","name":"Order ' || o_orderkey || '","description":"' || o_orderpriority || '","dateCreated":"' || d || '","dateModified":"' || d || '","author":{{"@type":"Organization","name":"c' || o_custkey || '"}},"claimReviewed":"' || o_orderpriority || '","appearance":[' || coalesce(works, '') || '],"reviewRating":{{"@type":"Rating","ratingValue":' || CASE status WHEN 'asserted' THEN 5 WHEN 'disputed' THEN 3 WHEN 'corrected' THEN 2 ELSE 1 END || ',"bestRating":5,"worstRating":1,"ratingExplanation":"Claim status: ' || status || '"}}}}' AS json
 FROM (SELECT *, {_STATUS_SQL} AS status, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) LEFT JOIN (SELECT l_orderkey, string_agg('{{"@type":"CreativeWork","@id":"{render.BASE}/sources/' || s_suppkey || '","name":"' || s_name || '","url":"{render.BASE}/s/' || s_suppkey || '","publisher":{{"@type":"Organization","name":"n' || s_nationkey || '"}}}}', ',' ORDER BY s_suppkey) AS works
 FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def claim_jsonld(t: Tables) -> DataFrame:
    source = F.struct(C("s_suppkey").cast("string").alias("id"), C("s_name").alias("title"), F.concat(F.lit(f"{render.BASE}/s/"), "s_suppkey").alias("url"), F.concat(F.lit("n"), "s_nationkey").alias("publisher"))
    works = t.lineitem.select("l_orderkey", "l_suppkey").distinct().join(t.supplier, C("l_suppkey") == C("s_suppkey")).groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", source.alias("s"))))["s"].alias("works"))
    rows = _claims(t).join(works, "o_orderkey", "left")
    day, none = F.date_format("o_orderdate", "yyyy-MM-dd"), F.from_json(F.lit("[]"), "array<struct<id:string,title:string,url:string,publisher:string>>")
    return rows.select("o_orderkey", render.claim_json_ld(C("o_orderkey").cast("string"), F.concat(F.lit("Order "), "o_orderkey"), C("o_orderpriority"), C("status"), F.concat(F.lit("c"), "o_custkey"), day, day, F.coalesce("works", none)).alias("json"))


@query(f"""SELECT s_suppkey, '{{"@context":"https://schema.org","@type":"' || CASE s_suppkey % 3 WHEN 0 THEN 'WebPage' WHEN 1 THEN 'DigitalDocument' ELSE 'CreativeWork' END || '","@id":"{render.BASE}/sources/' || s_suppkey || '","name":"' || s_name || '","url":"{render.BASE}/s","dateAccessed":"2026-01-01","publisher":{{"@type":"Organization","name":"p"}}' || CASE WHEN s_suppkey % 2 = 0 THEN ',"author":{{"@type":"Person","name":"a"}}' ELSE '' END || '}}' AS json FROM supplier""")
def source_jsonld(t: Tables) -> DataFrame:
    k = C("s_suppkey")
    kind = F.when(k % 3 == 0, "webpage").when(k % 3 == 1, "pdf").otherwise("unheard-of")
    null = F.lit(None).cast("string")
    return t.supplier.select("s_suppkey", render.source_json_ld(k.cast("string"), C("s_name"), F.lit(f"{render.BASE}/s"), F.lit("2026-01-01"), null, F.lit("p"), kind, F.when(k % 2 == 0, "a").otherwise(""), F.lit("")).alias("json"))


@query(f"""WITH h AS ({_HIERARCHY}) SELECT c.key, '{{"@context":"https://schema.org","@type":"Place","@id":"{render.BASE}/entities/' || c.key || '","name":"' || c.name || '","description":"d","sameAs":[' || CASE WHEN c.key % 2 = 0 THEN '"https://example.org/w"' ELSE '' END || ']' || CASE WHEN p.key IS NULL THEN '' ELSE ',"parentOrganization":{{"@type":"Place","@id":"{render.BASE}/entities/' || p.key || '","name":"' || p.name || '"}}' END
 || coalesce((SELECT ',"subOrganization":[' || string_agg('{{"@type":"Place","@id":"{render.BASE}/entities/' || k.key || '","name":"' || k.name || '"}}', ',' ORDER BY k.key) || ']' FROM h k WHERE k.parent = c.key), '') || '}}' AS json FROM h c LEFT JOIN h p ON c.parent = p.key""")
def entity_jsonld(t: Tables) -> DataFrame:
    h = _hierarchy(t)
    ref = F.struct(C("key").cast("string").alias("slug"), "name", F.lit("place").alias("type"))
    parents = h.select(C("key").alias("parent"), ref.alias("parent_ref"))
    below = h.where("parent IS NOT NULL").groupBy(C("parent").alias("key")).agg(F.array_sort(F.collect_list(F.struct("key", ref.alias("r"))))["r"].alias("children"))
    rows = h.join(parents, "parent", "left").join(below, "key", "left")
    links = F.array(F.when(C("key") % 2 == 0, "https://example.org/w"), F.lit(None).cast("string"))
    return rows.select("key", render.entity_json_ld(C("key").cast("string"), C("name"), F.lit("d"), F.lit("place"), F.lit(None).cast("string"), links, C("parent_ref"), C("children")).alias("json"))


@query(f"""SELECT o_orderkey, '<item><title>Order &lt;' || o_orderkey || '&gt; &amp; &apos;co&apos;</title><link>{render.BASE}/claims/' || o_orderkey || '</link><guid isPermaLink="true">{render.BASE}/claims/' || o_orderkey || '</guid><description>' || o_orderpriority || '</description><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><category>' || {_STATUS_SQL} || '</category></item>' AS item FROM orders""")
def rss_items(t: Tables) -> DataFrame:
    title = F.concat(F.lit("Order <"), "o_orderkey", F.lit("> & 'co'"))
    return _claims(t).select("o_orderkey", render.rss_item(C("o_orderkey").cast("string"), title, C("o_orderpriority"), C("status"), C("o_orderdate")).alias("item"))


@query(f"SELECT '<url><loc>{render.BASE}/' || kind || '/' || key || '</loc><lastmod>2026-01-01</lastmod></url>' AS entry FROM (SELECT 'claims' AS kind, o_orderkey AS key FROM orders UNION ALL SELECT 'entities', c_custkey FROM customer UNION ALL SELECT 'sources', s_suppkey FROM supplier UNION ALL SELECT 'topics', p_partkey FROM part)")
def sitemap_urls(t: Tables) -> DataFrame:
    one = lambda kind, df, key: df.select(render.sitemap_url(kind, C(key).cast("string"), F.lit("2026-01-01")).alias("entry"))
    return one("claims", t.orders, "o_orderkey").union(one("entities", t.customer, "c_custkey")).union(one("sources", t.supplier, "s_suppkey")).union(one("topics", t.part, "p_partkey"))


@query("SELECT '- claims: ' || (SELECT count(*) FROM orders) || chr(10) || '- entities: ' || (SELECT count(*) FROM customer) || chr(10) || '- sources: ' || (SELECT count(*) FROM supplier) || chr(10) || '- topics: ' || (SELECT count(*) FROM part) AS body")
def llms_counts(t: Tables) -> DataFrame:
    lines = corpus_counts(t).agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "kind", F.lit(": "), C("n").cast("string")))).alias("lines"))
    return lines.select(F.array_join("lines", "\n").alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS excerpt, left(text, 200) || '...' AS alert FROM documents")
def excerpts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncated(C("text"), 100).alias("excerpt"), F.concat(F.left("text", F.lit(200)), F.lit("...")).alias("alert"))


# --- answers ---------------------------------------------------------------------------------------------------------

@query("SELECT conv_id, turn, coalesce(text, '') AS answer, coalesce(role, '') || '=https://example.org/' || conv_id || ';more=https://other.net/' || turn AS sources, 'https://example.org/' || conv_id AS cited FROM conversations")
def parse_answers(t: Tables) -> DataFrame:
    link = lambda name, kind, site, k: F.struct(name.alias(kind), F.concat(F.lit(site), k.cast("string")).alias("url"))
    result = F.struct(C("text").alias("answer"), F.array(link(C("role"), "title", "https://example.org/", C("conv_id"))).alias("citations"))
    content = F.to_json(F.struct(F.array(result).alias("answer_results"), F.array(link(F.lit("more"), "name", "https://other.net/", C("turn"))).alias("additional_results")))
    parsed = t.conversations.select("conv_id", "turn", mentions.parse_perplexity(content).alias("a"))
    shown = F.array_join(F.transform("a.sources", lambda s: F.concat(s["title"], F.lit("="), s["url"])), ";")
    return parsed.select("conv_id", "turn", "a.answer", shown.alias("sources"), mentions.cited_url(C("a.sources"), "example.org").alias("cited"))


@query("SELECT conv_id, turn, coalesce(text, '') AS answer FROM conversations")
def parse_event_stream(t: Tables) -> DataFrame:
    half = (F.length("text") / 2).cast("int")
    delta = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(x.alias("v"))))
    lines = F.array(F.lit("event: delta"), delta(F.left("text", half)), F.lit("data: {broken"), delta(F.substr("text", half + 1)), F.lit("data: [DONE]"))
    parsed = mentions.parse_chatgpt(F.to_json(F.struct(lines.alias("raw_response"))))
    return t.conversations.select("conv_id", "turn", parsed["answer"].alias("answer"))


@query("SELECT conv_id, turn, coalesce(text, '') AS answer, 'example.org=https://example.org/' || conv_id || ';t=https://last.net' AS sources FROM conversations")
def parse_overview(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://example.org/"), "conv_id")
    cited = F.struct(C("text").alias("text"), F.array(F.concat(url, F.lit("#top")), url, F.lit("ftp://no")).alias("urls"))
    content = F.to_json(F.struct(F.array(cited).alias("citations"), F.array(F.struct(F.lit("t").alias("name"), F.lit("https://last.net").alias("link"))).alias("sources")))
    parsed = t.conversations.select("conv_id", "turn", mentions.parse_google(content).alias("a"))
    return parsed.select("conv_id", "turn", "a.answer", F.array_join(F.transform("a.sources", lambda s: F.concat(s["title"], F.lit("="), s["url"])), ";").alias("sources"))


_NOTE_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"
_NOTE_REST = f"list_filter({_NOTE_LINES}, lambda x: NOT starts_with(x, '# ') AND NOT starts_with(lower(x), 'source:') AND NOT starts_with(lower(x), 'quote:'))"


@query(f"SELECT doc_id, 'Note ' || doc_id AS title, coalesce(trim({_NOTE_REST}[1]), '') AS statement, 'https://example.org/' || doc_id AS source, 'said' AS quote FROM documents")
def ingest_parse(t: Tables) -> DataFrame:
    """A note around each text; no text has lines of a note's own forms."""
    note = F.concat(F.lit("skipped line\n# Note "), C("doc_id").cast("string"), F.lit("\n\nSource: https://example.org/"), C("doc_id").cast("string"), F.lit('\nQUOTE: "said"\n'), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", mentions.parse_note(note).alias("n")).select("doc_id", "n.title", "n.statement", "n.source", "n.quote")


@query("SELECT doc_id, doc_id % 4 <> 0 AS valid, CASE WHEN doc_id % 4 <> 0 THEN 'N' || doc_id END AS first_entity FROM documents")
def extraction_parse(t: Tables) -> DataFrame:
    level = F.when(C("doc_id") % 4 == 0, "certain").otherwise("high")
    entity = F.struct(F.concat(F.lit("N"), "doc_id").alias("name"), F.lit("product").alias("type"), F.lit("d").alias("description"), level.alias("confidence"))
    info = F.struct(F.lit("T").alias("title"), F.lit("P").alias("publisher"), F.lit("webpage").alias("type"), F.lit("high").alias("confidence"))
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(entity).alias("entities"), F.from_json(F.lit("[]"), "array<struct<title:string>>").alias("claims"), info.alias("sourceInfo"))), F.lit("\n```\nthanks"))
    parsed = t.documents.select("doc_id", extraction.reply(reply).alias("x"))
    return parsed.select("doc_id", C("x").isNotNull().alias("valid"), F.get("x.entities", F.lit(0))["name"].alias("first_entity"))


@query("SELECT doc_id, platform FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN (VALUES ('a'), ('b'), ('c')) p(platform)")
def monitor_checks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, "abc"))).alias("platform"))
