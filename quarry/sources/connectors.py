"""Connectors to the network: by recorded responses, which are a table, and by requests from the executors, a host at a time.

In a recording, a request without a row fails; nothing is made up.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.operators import extraction
from quarry.operators.crawl import FETCHED
from quarry.sources.shared import written


def fetch(requests: DataFrame, recording: DataFrame) -> DataFrame:
    """requests (url) with status, body and error; recording: url, status, body. A status of 400 or more, or no recording, is an error with status and text."""
    both = requests.join(recording.select("url", F.col("status").alias("_status"), F.col("body").alias("_body")), "url", "left")
    failed = F.coalesce(F.col("_status") >= 400, F.lit(True))
    said = F.when(F.col("_status").isNull(), F.lit("not recorded")).when(failed, F.concat(F.lit("HTTP "), F.col("_status").cast("string")))
    return both.select(*requests.columns, F.coalesce("_status", F.lit(0)).alias("status"), F.when(~failed, F.col("_body")).alias("body"), said.alias("error"))


def one_response(recording: DataFrame) -> DataFrame:
    """recording with one row a URL: of several, the one with the smallest status (a null one last), then location and body."""
    least = F.struct(F.col("status").isNull(), "status", F.coalesce("location", F.lit("")), F.coalesce("body", F.lit("")))
    return recording.groupBy("url").agg(F.min_by(F.struct("status", "location", "body"), least).alias("r")).select("url", "r.*")


def settled_redirects(recording: DataFrame, most: int = 20) -> DataFrame:
    """url, final_url, hops of the recorded redirects (status 300 to 399 with a location, which may be relative): where each chain ends.

    final_url is null for a chain of more than `most` hops, so for one that comes back to itself. Each round of pointer jumping doubles how far every redirect is followed, so there are as many
    rounds as `most` has binary digits, whatever the chains.
    """
    target = urls.normalized(urls.resolved(F.col("location"), F.col("url")))
    jumps = written(recording.where("status BETWEEN 300 AND 399 AND location <> ''").select("url", target.alias("final_url"), F.lit(1).alias("hops")), "redirects")
    while True:
        on = jumps.select(F.col("url").alias("final_url"), F.col("final_url").alias("_further"), F.col("hops").alias("_more"))
        joined = jumps.join(on, "final_url", "left").select("url", F.coalesce("_further", "final_url").alias("final_url"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_more").isNotNull().alias("_moved"))
        joined = written(joined, "redirects")
        if joined.where(F.col("_moved") & (F.col("hops") <= most)).isEmpty():
            return joined.select("url", F.when(~F.col("_moved") & (F.col("hops") <= most), F.col("final_url")).alias("final_url"), "hops")
        jumps = joined.drop("_moved")


def replay(recording: DataFrame, most_redirects: int = 20):
    """A fetch function over a recording (url, status, location, body): requests (url) give url, status, body, error, final_url and ms.

    Redirects are followed; a chain that is too long or comes back to itself is an error. Every request has a row, those that fail too.
    """
    once = one_response(recording)
    chains = settled_redirects(once, most_redirects)

    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select("url").distinct().join(chains, "url", "left").withColumn("_lost", F.col("hops").isNotNull() & F.col("final_url").isNull()).withColumn("final_url", F.when(F.col("hops").isNull(), F.col("url")).otherwise(F.col("final_url")))
        got = fetch(asked.select(F.col("url").alias("_asked"), "_lost", F.col("final_url").alias("url")), once)
        lost = lambda c, value: F.when(F.col("_lost"), value).otherwise(F.col(c))
        return got.select(F.col("_asked").alias("url"), lost("status", F.lit(0)).alias("status"), lost("body", None).alias("body"), lost("error", F.lit("too many redirects")).alias("error"), F.col("url").alias("final_url"), F.lit(0).cast("long").alias("ms"))

    return run


def live(agent: str, timeout_ms: int = 30_000, delay_ms: int = 1000, delays: DataFrame | None = None):
    """A fetch function over the network: a task has the requests of some hosts, one after another, with a pause of a host's delay between two of its requests; delays: host, delay_ms.

    Redirects are followed as far as the HTTP library goes. What fails has its status, or 0, and the error's text. A task that is run again asks again.
    """

    def ask(url: str) -> tuple:
        began = time.monotonic()
        took = lambda: int(1000 * (time.monotonic() - began))
        try:
            request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"})
            with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as r:
                return url, r.status, r.read().decode("utf-8", "replace"), None, r.geturl(), took()
        except urllib.error.HTTPError as e:
            return url, 0 if 300 <= e.code < 400 else e.code, None, "too many redirects" if 300 <= e.code < 400 else f"HTTP {e.code}", None, took()
        except TimeoutError:
            return url, 408, None, "Request timeout", None, took()
        except (OSError, ValueError) as e:
            late = isinstance(getattr(e, "reason", None), TimeoutError)
            return url, 408 if late else 0, None, "Request timeout" if late else str(e) or type(e).__name__, None, took()

    def run_host(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for part in parts:
            rows = []
            for url, pause in zip(part["url"], part["delay_ms"], strict=True):
                host = urlsplit(url).netloc
                if host == before:
                    time.sleep(pause / 1000)
                rows.append(ask(url))
                before = host
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")])

    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select("url", urls.host(F.col("url")).alias("host")).distinct()
        known = asked.join(delays.select("host", "delay_ms"), "host", "left") if delays is not None else asked.withColumn("delay_ms", F.lit(None).cast("int"))
        paced = known.withColumn("delay_ms", F.coalesce("delay_ms", F.lit(delay_ms))).repartition("host").sortWithinPartitions("host", "url")
        return paced.select("url", "delay_ms").mapInPandas(run_host, FETCHED)

    return run


def rendered_request(url: Column) -> Column:
    """The JSON of a request to a rendering proxy."""
    return F.to_json(F.struct(F.lit("universal").alias("source"), url.alias("url"), F.lit("html").alias("render")))


def rendered_fetch(requests: DataFrame, recording: DataFrame) -> DataFrame:
    """requests (url) with body and error; recording: payload, status, response (JSON with results). The first result's content is the page."""
    both = requests.withColumn("payload", rendered_request(F.col("url"))).join(recording.select("payload", F.col("status").alias("_status"), "response"), "payload", "left")
    body = F.when(F.col("_status") == 200, F.get_json_object("response", "$.results[0].content"))
    said = F.when(F.col("_status").isNull(), F.lit("not recorded")).when(F.col("_status") != 200, F.concat(F.lit("HTTP "), F.col("_status").cast("string"))).when(body.isNull(), F.lit("no content"))
    return both.select(*requests.columns, body.alias("body"), said.alias("error"))


def robots_fetch(sites: DataFrame, recording: DataFrame) -> DataFrame:
    """host, text: the robots.txt of each site (url); empty, so that all is allowed, for one that isn't there. A URL without a host fails and has no row."""
    asked = sites.where(urls.part(F.col("url"), 2) != "").select(urls.host(F.col("url")).alias("host"), F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.part(F.col("url"), 2), F.lit("/robots.txt")).alias("url"))
    one = asked.groupBy("host").agg(F.min("url").alias("url"))
    return fetch(one, recording).select("host", F.when(F.col("status") == 200, F.coalesce("body", F.lit(""))).otherwise(F.lit("")).alias("text"))


def extraction_replies(pages: DataFrame, recording: DataFrame) -> DataFrame:
    """pages (url, text, ...) with x, the checked reply, and its tokens; recording: url, answer, input_tokens, output_tokens. Pages with little text aren't asked about."""
    asked = pages.withColumn("_key", F.when(extraction.enough_text(F.col("text")), F.col("url")))
    both = asked.join(recording.withColumnRenamed("url", "_key"), "_key", "left")
    return both.select(*pages.columns, extraction.reply(F.col("answer")).alias("x"), "input_tokens", "output_tokens")
