"""Answers of assistants and crawler visits: parsing, citations and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crawlers in order of precedence, as (pattern, name, organisation).
CRAWLERS = [
    ("GPTBot", "GPTBot", "OpenAI"), ("ChatGPT-User", "ChatGPT-User", "OpenAI"), ("Claude-Web", "Claude-Web", "Anthropic"), ("Anthropic", "Anthropic-AI", "Anthropic"),
    ("PerplexityBot", "PerplexityBot", "Perplexity"), ("Cohere", "Cohere-AI", "Cohere"), ("Google-Extended", "Google-Extended", "Google"),
    ("Bytespider", "Bytespider", "ByteDance"), ("CCBot", "CCBot", "Common Crawl"),
]
_LINKS = "array<struct<title:string,name:string,url:string,link:string>>"


def crawler_of(agent: Column, field: int = 1) -> Column:
    """The first crawler whose pattern the user agent contains (case-sensitive); null for none. field 1: name, 2: organisation."""
    out = F.when(F.lit(False), F.lit(None))
    for row in CRAWLERS:
        out = out.when(agent.contains(row[0]), row[field])
    return out


def _named(s: Column) -> Column:
    empty = F.lit("")
    return F.struct(F.coalesce(F.nullif(s["title"], empty), F.nullif(s["name"], empty), empty).alias("title"), F.coalesce(F.nullif(s["url"], empty), empty).alias("url"))


def _first_text(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def html_links(html: Column, unwanted: str = "perplexity.ai") -> Column:
    """Links of plain anchors: title (or URL) and URL, http only."""
    pattern = r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]*)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("title"))
    kept = F.filter(pairs, lambda p: p["url"].startswith("http") & ~p["url"].contains(unwanted))
    return F.transform(kept, lambda p: F.struct(F.coalesce(F.nullif(F.trim(p["title"]), F.lit("")), p["url"]).alias("title"), p["url"].alias("url")))


def distinct_sources(sources: Column) -> Column:
    """Sources with a URL, the first of each."""
    some = F.filter(sources, lambda s: s["url"] != "")
    return F.filter(some, lambda s, i: F.array_position(F.transform(some, lambda x: x["url"]), s["url"]) == i + 1)


def parse_perplexity(content: Column) -> Column:
    """answer and sources of a JSON answer: citations and sources of each result, then additional results (an array, or arrays by name)."""
    base = F.from_json(content, f"answer_results_md string, answer_results array<struct<answer:string,text:string,citations:{_LINKS},sources:{_LINKS}>>, additional_results string")
    none = F.from_json(F.lit("[]"), _LINKS)
    results = F.coalesce(base["answer_results"], F.from_json(F.lit("[]"), f"array<struct<answer:string,text:string,citations:{_LINKS},sources:{_LINKS}>>"))
    own = F.flatten(F.transform(results, lambda r: F.concat(F.coalesce(r["citations"], none), F.coalesce(r["sources"], none))))
    extra = base["additional_results"]
    more = F.when(F.ltrim(extra).startswith("["), F.from_json(extra, _LINKS)).otherwise(F.flatten(F.map_values(F.from_json(extra, f"map<string,{_LINKS}>"))))
    more = F.filter(F.coalesce(more, none), lambda s: F.coalesce(s["url"], F.lit("")) != "")
    answer = _first_text(base["answer_results_md"], F.get(results, F.lit(0))["answer"], F.get(results, F.lit(0))["text"])
    return F.struct(answer.alias("answer"), F.transform(F.concat(own, more), _named).alias("sources"))


def parse_chatgpt(content: Column) -> Column:
    """answer: the response text, else the text deltas of the event stream's data lines, else answer or response. There are no sources."""
    base = F.from_json(content, "response_text string, raw_response array<string>, answer string, response string")
    lines = F.filter(F.coalesce(base["raw_response"], F.array().cast("array<string>")), lambda x: x.startswith("data: ") & (x != "data: [DONE]"))
    data = F.transform(lines, lambda x: F.substr(x, F.lit(7)))
    parts = F.transform(data, lambda x: F.when(F.get_json_object(x, "$.v.message.author.role") == "assistant", F.array_join(F.from_json(F.get_json_object(x, "$.v.message.content.parts"), "array<string>"), "")).when(F.get_json_object(x, "$.v.message").isNull() & ~F.coalesce(F.get_json_object(x, "$.v"), F.lit("{")).startswith("{"), F.get_json_object(x, "$.v")).otherwise(""))
    return F.struct(_first_text(base["response_text"], F.array_join(parts, ""), base["answer"], base["response"]).alias("answer"), F.from_json(F.lit("[]"), "array<struct<title:string,url:string>>").alias("sources"))


def parse_google(content: Column) -> Column:
    """answer: citation texts, a blank line between; sources: their http URLs without fragment, titled by host, then other sources; distinct."""
    base = F.from_json(content, f"citations array<struct<text:string,urls:array<string>>>, sources {_LINKS}, ai_overview string, answer string, response string")
    cited = F.coalesce(base["citations"], F.from_json(F.lit("[]"), "array<struct<text:string,urls:array<string>>>"))
    texts = F.filter(F.transform(cited, lambda c: c["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    urls = F.filter(F.flatten(F.transform(cited, lambda c: F.coalesce(c["urls"], F.array().cast("array<string>")))), lambda u: F.coalesce(u.startswith("http"), F.lit(False)))
    own = F.transform(urls, lambda u: F.struct(F.regexp_extract(u, r"https?://([^/:#?]+)", 1).alias("title"), F.regexp_extract(u, r"^([^#]*)", 1).alias("url")))
    other = F.transform(F.coalesce(base["sources"], F.from_json(F.lit("[]"), _LINKS)), lambda s: F.struct(_first_text(s["title"], s["name"]).alias("title"), _first_text(s["url"], s["link"]).alias("url")))
    return F.struct(_first_text(F.array_join(texts, "\n\n"), base["ai_overview"], base["answer"], base["response"]).alias("answer"), distinct_sources(F.concat(own, other)).alias("sources"))


def cited_url(sources: Column, site: str) -> Column:
    """The first source whose URL contains the site's domain; null for none."""
    return F.get(F.filter(sources, lambda s: s["url"].contains(site)), F.lit(0))["url"]


def parse_note(text: Column) -> Column:
    """title, statement, source, quote of a short text: a `# ` line, `source:` and `quote:` lines, and the first other line after the title."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    last = lambda found: F.coalesce(F.element_at(found, -1), F.lit(""))
    starts = lambda x, p: F.lower(x).startswith(p)
    safe = lambda xs: F.when(F.size(xs) > 0, xs)
    heads = F.filter(lines, lambda x: x.startswith("# "))
    first = F.array_position(F.transform(lines, lambda x: x.startswith("# ") & (F.trim(F.substr(x, F.lit(3))) != "")), F.lit(True))
    after = F.when(first > 0, F.slice(lines, first.cast("int") + 1, F.greatest(F.size(lines), F.lit(1))))
    rest = F.filter(after, lambda x: ~(x.startswith("# ") | starts(x, "source:") | starts(x, "quote:")))
    return F.struct(
        F.trim(F.substr(last(safe(heads)), F.lit(3))).alias("title"),
        F.coalesce(F.trim(F.get(rest, F.lit(0))), F.lit("")).alias("statement"),
        F.trim(F.substr(last(safe(F.filter(lines, lambda x: starts(x, "source:")))), F.lit(8))).alias("source"),
        F.regexp_replace(F.trim(F.substr(last(safe(F.filter(lines, lambda x: starts(x, "quote:")))), F.lit(7))), r"^[\"']|[\"']\z", "").alias("quote"),
    )
