"""Crawl frontier and statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.sources.shared import exists, new_folder, written

TYPES = ["homepage", "about", "team", "product", "news", "contact", "legal", "other"]


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: what is reached from seeds (node) over edges (src, dst) within max_depth links.

    One level at a time: the frontier's links, without what was visited. Every level is cut with checkpoint(), so the plan doesn't grow
    and a lost executor doesn't cost earlier levels.
    """
    context = edges.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(new_folder(edges.sparkSession, "crawl"))
    visited = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = visited
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = found.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def crawl_statistics(pages: DataFrame) -> DataFrame:
    """pages: status, bytes, type, ms. One row: successes, failures, bytes, pages by type (all types), mean response (halves up)."""
    ok = F.col("status") == 200
    by_type = [F.count_if(ok & (F.col("type") == t)).alias(f"type_{t}") for t in TYPES]
    mean = F.coalesce(F.floor(F.avg(F.when(ok, F.col("ms"))) + 0.5), F.lit(0)).cast("long")
    return pages.agg(F.count_if(ok).alias("pages_ok"), F.count_if(~ok).alias("pages_failed"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("total_bytes"), mean.alias("mean_ms"), *by_type)


@dataclass(frozen=True)
class CrawlConfig:
    """What a crawl may do; fields that are not given have the usual values."""

    seed: str
    max_pages: int = 50
    max_depth: int = 3
    delay_ms: int = 1000
    timeout_ms: int = 30_000
    agent: str = "quarry/1.0"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    respect_robots: bool = True
    started: str = ""

    @classmethod
    def of(cls, seed: str, **given) -> CrawlConfig:
        """Values that are None count as not given."""
        return cls(seed, **{k: v for k, v in given.items() if v is not None})

    def with_robots(self, text: str) -> CrawlConfig:
        """With the robots.txt's delay where it is longer."""
        return replace(self, delay_ms=urls.crawl_delay_ms(urls.parse_robots(text), self.agent, self.delay_ms)) if self.respect_robots else self

    def crawl_id(self) -> str:
        """The folder's name for what this crawl gives: by its seed's host and, where it is told, its time."""
        return f"{urls.host_text(self.seed)}_{self.started}" if self.started else urls.host_text(self.seed)

    def allows(self, url: Column, robots: str) -> Column:
        group = urls.robots_group(urls.parse_robots(robots), self.agent) if self.respect_robots else None
        rules = group["rules"] if group else []
        return urls.robots_allowed(url, rules) & urls.glob_allowed(url, list(self.include), list(self.exclude))


def completed_configs(crawls: DataFrame) -> DataFrame:
    """crawls (seed and any of a configuration's fields) with every field, the usual value where it is null or isn't there; others of its columns stay."""
    usual = CrawlConfig("")
    out = crawls
    for name in ("max_pages", "max_depth", "delay_ms", "timeout_ms", "agent", "respect_robots"):
        value = F.lit(getattr(usual, name))
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in crawls.columns else value)
    for name in ("include", "exclude"):
        none = F.array().cast("array<string>")
        out = out.withColumn(name, F.coalesce(F.col(name), none) if name in crawls.columns else none)
    return out


def error_status(error: Column) -> Column:
    """A status code for the text of an error."""
    out = F.when(error.contains("404"), 404)
    for part, code in (("403", 403), ("500", 500), ("timeout", 408)):
        out = out.when(error.contains(part), code)
    return out.otherwise(0)


STATE = "url string, depth int, place array<int>, status int, ok boolean"


def crawl(spark: SparkSession, pages: DataFrame, config: CrawlConfig, robots: str = "", folder: str | None = None, levels: int | None = None) -> DataFrame:
    """url, depth, place, status, ok of the URLs that a crawl visits, in the order of place within a depth.

    pages: url (normal form), error (null for a page that was fetched), links (array of normal forms); a URL without a row is an error. First come, first served: a
    level's URLs stand in the order of the pages that link to them and of their links; visited, too deep and forbidden URLs are passed over, and the crawl ends
    with max_pages pages that were fetched. Each level is written below folder, so the crawl can be resumed there: a call with a folder that has levels goes on after the last. `levels`
    ends it after so many more.
    """
    folder = folder or new_folder(spark, "crawl")
    # a URL that is recorded twice is one page: one that was fetched, if there is any
    first = F.struct(F.col("error").isNotNull(), F.coalesce("error", F.lit("")), "links")
    pages = pages.groupBy("url").agg(F.min_by(F.struct("error", "links"), first).alias("r")).select("url", "r.*")
    done, last = _levels(spark, folder), -1
    if done:
        last = max(done)
    for depth in range(last + 1, config.max_depth + 1 if levels is None else min(config.max_depth, last + levels) + 1):
        visited = spark.read.schema(STATE).parquet(*[f"{folder}/level{d}" for d in done]) if done else spark.createDataFrame([], STATE)
        fetched = visited.agg(F.count_if("ok")).first()[0]
        if fetched >= config.max_pages:
            break
        if depth == 0:
            queue = spark.createDataFrame([(config.seed, [0])], "url string, place array<int>").select(urls.normalized(F.col("url")).alias("url"), "place")
        else:
            parents = visited.where(f"depth = {depth - 1} AND ok").select("url", "place").join(pages.select("url", "links"), "url")
            found = parents.select("place", F.posexplode("links").alias("at", "link")).select(F.col("link").alias("url"), F.concat("place", F.array("at")).alias("place"))
            queue = found.groupBy("url").agg(F.min("place").alias("place")).join(visited.select("url"), "url", "left_anti")
        queue = queue.where(config.allows(F.col("url"), robots))
        tried = queue.join(pages.select("url", "error", F.lit(True).alias("known")), "url", "left").withColumn("error", F.when(F.col("known"), F.col("error")).otherwise("not recorded"))
        tried = tried.select("url", F.lit(depth).alias("depth"), "place", F.when(F.col("error").isNull(), 200).otherwise(error_status(F.col("error"))).alias("status"), F.col("error").isNull().alias("ok"))
        tried.write.mode("overwrite").parquet(f"{folder}/queue{depth}")
        tried = spark.read.schema(STATE).parquet(f"{folder}/queue{depth}")
        ends = tried.where("ok").select("place").orderBy("place").limit(config.max_pages - fetched)  # bounded by the page limit
        cut = ends.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("end"))
        own = tried.join(F.broadcast(cut), (F.col("n") < config.max_pages - fetched) | (F.col("place") <= F.col("end"))).drop("n", "end")
        own.write.mode("overwrite").parquet(f"{folder}/level{depth}")
        done.append(depth)
        if spark.read.schema(STATE).parquet(f"{folder}/level{depth}").isEmpty():
            break
    return spark.read.schema(STATE).parquet(*[f"{folder}/level{d}" for d in done]) if done else spark.createDataFrame([], STATE)


FETCHED = "url string, status int, body string, error string, final_url string, ms long"
RUN_STATE = "url string, depth int, place array<int>, status int, ok boolean, error string, final_url string"
#: URLs that a level asks for beyond those that the page limit still allows, in case some fail.
SPARE = 32


def crawl_run(spark: SparkSession, config: CrawlConfig, fetch: Callable[[DataFrame], DataFrame], folder: str, completed: str | None = None, levels: int | None = None) -> DataFrame:
    """A crawl from its seed to stored pages and a manifest below folder; what it visited, as RUN_STATE.

    fetch takes requests (url) and gives url, status, body, error, final_url and ms, a row for each; see `connectors.replay` and `connectors.live`. A level at a time: the robots.txt of hosts that are new are fetched, URLs that the rules or
    the configuration forbid are passed over, the others are fetched in the order of the pages that link to them and of their links, and the pages' links make the next level. Failed pages
    are kept with their error. The crawl ends with max_pages pages that were fetched, or max_depth levels.

    Each level is written once: `level<d>` (state), `pages<d>` (html, text, metadata, links) and, of hosts that are new, `hosts<d>` (robots text, delay, sitemaps) and `rules<d>`; a call with a folder that has levels goes on after the last whole one, and only its pages and the
    URLs of the others are read. `levels` ends the call after so many more.
    """
    done = _levels(spark, folder)
    last = max(done, default=-1)
    fetched, columns = _state(spark, folder, done).where("ok").count(), []
    for depth in range(last + 1, config.max_depth + 1 if levels is None else min(config.max_depth, last + levels) + 1):
        if fetched >= config.max_pages:
            break
        if depth == 0:
            queue = spark.createDataFrame([(config.seed, [0])], "url string, place array<int>").select(urls.normalized(F.col("url")).alias("url"), "place")
        else:
            parents = spark.read.parquet(f"{folder}/pages{depth - 1}").where("status = 200")
            found = parents.select("place", F.posexplode("internal").alias("at", "url")).select("url", F.concat("place", F.array("at")).alias("place"))
            queue = found.groupBy("url").agg(F.min("place").alias("place")).join(_state(spark, folder, done).select("url"), "url", "left_anti")
        queue = written(_permitted(spark, config, queue, fetch, folder, depth, done), "queue")
        got, after, rest = spark.createDataFrame([], f"place array<int>, {FETCHED}"), [], config.max_pages - fetched
        while rest:
            part = queue.where(F.size("place") > 0) if not after else queue.where(F.col("place") > F.lit(after))
            part = part.orderBy("place").limit(rest + SPARE)  # bounded by the page limit
            pages = written(part.join(fetch(part.select("url")), "url"), "fetched")
            tried = sorted((r["place"], r["failed"]) for r in pages.select("place", F.col("error").isNotNull().alias("failed")).collect())
            ok = [place for place, failed in tried if not failed][:rest]
            if len(ok) == rest:
                pages = pages.where(F.col("place") <= F.lit(ok[-1]))
            got = got.unionByName(pages) if after else pages
            rest -= len(ok)
            if len(tried) < len(ok) + rest + SPARE:
                break
            after = tried[-1][0]
        fetched = config.max_pages - rest
        # the depth is a column and no constant, so every level runs the code that was compiled for the first
        columns = columns or _page_columns()
        rows = got.join(F.broadcast(spark.createDataFrame([(depth,)], "depth int"))).select(*columns)  # one row
        rows.select("*", "links.internal", "links.external").drop("links").write.mode("overwrite").parquet(f"{folder}/pages{depth}")
        state = spark.read.parquet(f"{folder}/pages{depth}").select("url", "depth", "place", "status", F.col("error").isNull().alias("ok"), "error", "final_url")
        state.write.mode("overwrite").parquet(f"{folder}/level{depth}")
        done.append(depth)
        if not tried:
            break
    visited = _state(spark, folder, done)
    pages = _read_levels(spark, folder, "pages", done)
    if pages is not None:
        entries = pages.select("urlHash", "url", "status", "type", F.col("metadata.title").alias("title"), "depth", "bytes", "ms")
        site = manifest(entries, urls.host_text(config.seed), config.crawl_id(), completed)
        errors = visited.where("NOT ok").agg(F.array_sort(F.collect_list(F.struct("url", "error", "status"))).alias("errors"))  # bounded like the pages
        site.join(errors).write.mode("overwrite").parquet(f"{folder}/manifest")  # one row each
    return visited


def _read_levels(spark: SparkSession, folder: str, name: str, depths: list[int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{folder}/{name}{d}" for d in depths]) if depths else None


def _state(spark: SparkSession, folder: str, depths: list[int]) -> DataFrame:
    return spark.read.schema(RUN_STATE).parquet(*[f"{folder}/level{d}" for d in depths]) if depths else spark.createDataFrame([], RUN_STATE)


def _permitted(spark: SparkSession, config: CrawlConfig, queue: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, depth: int, done: list[int]) -> DataFrame:
    """The URLs of queue that the hosts' robots.txt and the configuration permit; hosts<depth> gets the hosts that are new."""
    kept = queue.where(urls.glob_allowed(F.col("url"), list(config.include), list(config.exclude))).withColumn("host", urls.host(F.col("url")))
    if not config.respect_robots:
        return kept.drop("host")
    sites = kept.groupBy("host").agg(F.min(F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.part(F.col("url"), 2), F.lit("/robots.txt"))).alias("url"))
    had = [d for d in done if exists(spark, f"{folder}/hosts{d}")]  # levels that met new hosts
    if had:
        sites = sites.join(_read_levels(spark, folder, "hosts", had).select("host"), "host", "left_anti")
    sites = written(sites, "sites")
    if not sites.isEmpty():
        got = sites.join(fetch(sites.select("url")), "url").select("host", F.when(F.col("error").isNull(), F.coalesce("body", F.lit(""))).otherwise("").alias("text"))
        texts = written(got, "robots")
        rules, known = urls.robots_sites(texts, config.agent, config.delay_ms)
        rules.write.mode("overwrite").parquet(f"{folder}/rules{depth}")
        texts.join(known, "host").write.mode("overwrite").parquet(f"{folder}/hosts{depth}")
        had.append(depth)
    return urls.rule_verdicts(kept, _read_levels(spark, folder, "rules", had)).where("allowed").drop("host", "allowed") if had else kept.drop("host")


def _page_columns() -> list[Column]:
    """What is kept of each page that was fetched or tried; a failed one has the parts of an empty page. The expressions are large, so a crawl makes them once."""
    html, url = F.coalesce("body", F.lit("")), F.col("url")
    kind = F.when(F.col("error").isNull(), text.page_type(urls.path(url), text.page_title(html), text.meta_content(html, "og:type"))).otherwise("other")
    status = F.when(F.col("error").isNull(), 200).otherwise(F.when(F.col("status") > 0, F.col("status")).otherwise(error_status(F.col("error"))))
    return [
        urls.url_hash(url).alias("urlHash"), url, F.col("place"), status.alias("status"), kind.alias("type"), text.page_metadata(html).alias("metadata"), html.alias("html"), text.clean_text(html).alias("text"),
        urls.page_links(html, url).alias("links"), text.json_ld(html).alias("jsonLd"), F.col("depth"), F.octet_length(html).cast("long").alias("bytes"), F.col("ms"), F.col("error"), F.col("final_url"),
    ]


def _levels(spark: SparkSession, folder: str) -> list[int]:
    """Depths whose level was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, depth = [], 0
    while system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/level{depth}/_SUCCESS")):
        found.append(depth)
        depth += 1
    return found


def manifest(pages: DataFrame, domain: str, crawl_id: str, completed: str | None) -> DataFrame:
    """One row: domain, crawlId, status, completedAt, stats and the list of pages; pages: url, urlHash, status, type, title, depth, bytes, ms.

    The list is the feature; a crawl's size is bounded by its page limit.
    """
    entry = F.struct("urlHash", "url", "status", "type", "title", "depth", "bytes")
    stats = crawl_statistics(pages)
    listed = pages.where("status = 200").agg(F.array_sort(F.collect_list(entry)).alias("pages"))
    head = stats.select(F.struct(*stats.columns).alias("stats"))
    status = F.lit("completed" if completed else "in progress")
    return head.join(listed).select(F.lit(domain).alias("domain"), F.lit(crawl_id).alias("crawlId"), status.alias("status"), F.lit(completed).cast("string").alias("completedAt"), "stats", "pages")  # one row each


def save_crawl(pages: DataFrame, texts: DataFrame, folder: str, domain: str, crawl_id: str, completed: str | None) -> None:
    """Pages (with html, text and metadata) and the manifest below folder; texts: urlHash, cleanText."""
    pages.join(texts, "urlHash", "left").write.mode("overwrite").parquet(f"{folder}/pages")
    manifest(pages, domain, crawl_id, completed).write.mode("overwrite").parquet(f"{folder}/manifest")
