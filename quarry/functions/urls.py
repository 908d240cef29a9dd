"""URLs as column expressions: parts, normal form, resolution, hashes, globs and robots rules."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.text import let
from quarry.sources.shared import written

#: Scheme, authority, path, query, fragment.
SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#[\s\S]*)?\z"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, SHAPE, k)


def host(url: Column) -> Column:
    """Host name in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^[^@]*@", ""), r":\d*\z", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))


def authority(url: Column) -> Column:
    """Host with port; the scheme's own port is left out."""
    own = F.lower(part(url, 2))
    return F.when(F.lower(part(url, 1)) == "https", F.regexp_replace(own, r":443\z", "")).otherwise(F.regexp_replace(own, r":80\z", ""))


def sorted_query(url: Column) -> Column:
    """The query with its parameters in order of their names; equal names keep their order."""
    pairs = F.filter(F.split(F.substr(part(url, 4), F.lit(2)), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(F.regexp_extract(p, r"^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def normalized(url: Column) -> Column:
    """Normal form of an absolute http(s) URL without dot segments or characters to escape; any other is returned as it is.

    No fragment, no trailing slash except the root's, parameters by name, host in lower case, no default port.
    """
    own = path(url)
    trimmed = F.when((own != "/") & own.endswith("/"), F.regexp_replace(own, r"/\z", "")).otherwise(own)
    made = F.concat(F.lower(part(url, 1)), F.lit("://"), authority(url), trimmed, sorted_query(url))
    return F.when(url.rlike(r"^(?i)https?://[^/?#]"), made).otherwise(url)


def url_hash(url: Column) -> Column:
    return F.left(F.md5(url), F.lit(12))


#: Parent segments that a path may have one after another.
MOST_PARENTS = 16


def without_dots(url: Column) -> Column:
    """The URL with the dot segments of its path resolved, at most MOST_PARENTS parents deep; the query stays as it is."""
    head, own = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*([\s\S]*)\z", 1)
    site, where = F.regexp_extract(head, r"^([^/]*//[^/]*)", 1), F.regexp_extract(head, r"^[^/]*//[^/]*([\s\S]*)\z", 1)
    for _ in range(2):  # segments that touch
        where = F.regexp_replace(where, r"/\.(/|\z)", "/")
    for _ in range(MOST_PARENTS):
        where = F.regexp_replace(where, r"^((?:/[^/]+)*?)/(?!\.\.(?:/|\z))[^/]+/\.\.(?:/|\z)", "$1/")
    where = F.regexp_replace(where, r"^(?:/\.\.(?=/|\z))+", "")
    return F.when(F.instr(head, "/.") > 0, F.concat(site, F.when(where == "", F.lit("/")).otherwise(where), own)).otherwise(url)


def resolved(href: Column, base: Column) -> Column:
    """An absolute URL of a reference that is absolute, //host, /path, ?query or a relative path, with dot segments resolved."""
    return let(_joined(href, base), without_dots)


def _joined(href: Column, base: Column) -> Column:
    scheme, site = F.lower(part(base, 1)), F.concat(F.lower(part(base, 1)), F.lit("://"), authority(base))
    folder = F.regexp_extract(path(base), r"^([\s\S]*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, path(base), href))
        .otherwise(F.concat(site, folder, href))
    )


def page_links(html: Column, url: Column) -> Column:
    """A struct of the distinct internal (normal form) and external links, in order."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)"), F.lit(1)), lambda h: F.trim(h))
    plain = F.filter(hrefs, lambda h: ~(h.startswith("javascript:") | h.startswith("mailto:") | h.startswith("tel:") | h.startswith("data:")))
    full = F.filter(F.transform(plain, lambda h: resolved(h, url)), lambda u: u.rlike(r"(?i)^https?://[^/?#]"))
    own = bare_host(url)
    internal = F.array_distinct(F.transform(F.filter(full, lambda u: bare_host(u) == own), normalized))
    return F.struct(internal.alias("internal"), F.array_distinct(F.filter(full, lambda u: bare_host(u) != own)).alias("external"))


def normalize_any(url: str) -> str:
    """Normal form of any URL: dot segments resolved and parameters written anew; an invalid URL is returned as it is."""
    try:
        p = urlsplit(url.strip())
        if not p.scheme or p.scheme.lower() in ("http", "https") and not p.hostname:
            return url
        port = p.port
    except ValueError:
        return url
    scheme, site = p.scheme.lower(), (p.hostname or "").lower()
    if port and port != {"http": 80, "https": 443}.get(scheme):
        site += f":{port}"
    own = urlsplit(urljoin(f"{scheme}://{site}/", p.path or "/")).path or "/"
    own = quote(own, safe="/%:@!$&'()*+,;=~-._")
    if own != "/" and own.endswith("/"):
        own = own[:-1]
    query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True), key=lambda kv: kv[0]))
    return urlunsplit((scheme, site, own, query, ""))


@F.pandas_udf(StringType())
def normalized_full(url: pd.Series) -> pd.Series:
    """normalize_any for rows that `normalized` does not cover."""
    return url.map(normalize_any, na_action="ignore")


def host_text(url: str) -> str:
    """The host of one URL, in lower case; empty for what is none."""
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** is anything, * anything but a slash, ? one character but a slash."""
    out, k = "", 0
    while k < len(glob):
        if glob[k] == "*":
            double = glob[k : k + 2] == "**"
            out, k = out + (".*" if double else "[^/]*"), k + 1 + double
        else:
            out, k = out + ("[^/]" if glob[k] == "?" else re.escape(glob[k]) if glob[k] in ".+^${}()|[]\\" else glob[k]), k + 1
    return rf"(?i)^{out}\z"


def glob_allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion first; then any inclusion, if there are some. Tested on path with query and on the whole URL; false for no URL."""
    subjects = [F.concat(path(url), part(url, 4)), url]
    hit = lambda globs: F.expr("false") if not globs else [s.rlike(glob_pattern(g)) for g in globs for s in subjects]

    def any_of(globs: list[str]) -> Column:
        found = F.lit(False)
        for c in hit(globs) if globs else []:
            found = found | c
        return found

    allowed = ~any_of(exclude) & (any_of(include) if include else F.lit(True))
    return F.coalesce(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]") & allowed, F.lit(False))


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def _directives(text: str) -> list[tuple[str, str]]:
    """Names in lower case and values, in order; lines without a colon or a value don't count."""
    pairs = (line.split("#", 1)[0].partition(":") for line in text.split("\n"))
    return [(name.strip().lower(), value.strip()) for name, colon, value in pairs if colon and value.strip()]


def parse_robots(text: str) -> list[dict]:
    """Groups of a robots.txt: agents, rules as (allow, pattern), crawl delay.

    An agent joins the group before it until that has a rule or a delay. A delay is the number that its value begins with, if it isn't negative.
    """
    groups: list[dict] = []
    for name, value in _directives(text):
        last = groups[-1] if groups else None
        if name == "user-agent":
            if last is None or last["rules"] or last["delay"] is not None:
                last = {"agents": [], "rules": [], "delay": None}
                groups.append(last)
            last["agents"].append(value.lower())
        elif last is not None and name in ("allow", "disallow"):
            last["rules"].append((name == "allow", value))
        elif last is not None and name == "crawl-delay" and (number := _NUMBER.match(value)) and float(number[0]) >= 0:
            last["delay"] = float(number[0])
    return groups


def robots_sitemaps(text: str) -> list[str]:
    return [value for name, value in _directives(text) if name == "sitemap"]


def crawl_delay_ms(groups: list[dict], agent: str, configured: int) -> int:
    """The delay of the agent's group where it is longer than the configured one."""
    group = robots_group(groups, agent)
    return max(configured, int(1000 * (group["delay"] or 0))) if group else configured


def robots_group(groups: list[dict], agent: str) -> dict | None:
    """The group with the longest agent name inside `agent` (the first of equals), else the first for all agents."""
    named = [(len(a), -k, g) for k, g in enumerate(groups) for a in g["agents"] if a != "*" and a in agent.lower()]
    if named:
        return max(named, key=lambda x: x[:2])[2]
    return next((g for g in groups if "*" in g["agents"]), None)


def robots_pattern(pattern: str) -> str:
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*"))
    return "^" + body + (r"\z" if end else "")


#: A robots.txt as rows: a rule per agent and pattern.
ROBOTS_ROWS = "array<struct<group:int,agent:string,allow:boolean,pattern:string,delay:double>>"


def robots_rows(text: pd.Series) -> pd.Series:
    """The groups of each robots.txt as rows (group, agent, allow, pattern, delay); a group without rules has one without a pattern."""

    def rows(t: str | None) -> list[dict]:
        out = []
        for k, g in enumerate(parse_robots(t or "")):
            for agent in g["agents"]:
                out += [{"group": k, "agent": agent, "allow": a, "pattern": p, "delay": g["delay"]} for a, p in g["rules"] or [(True, None)]]
        return out

    return text.map(rows)


def rule_pattern(pattern: Column) -> Column:
    """robots_pattern of a column of patterns: * is anything, a last $ the end, all else stands for itself."""
    end = pattern.endswith("$")
    body = F.when(end, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    plain = F.regexp_replace(body, r"[\\\[\](){}+?.^$|]", r"\\$0")
    return F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(end, F.lit("\\z")).otherwise(F.lit("")))


def robots_sites(robots: DataFrame, agent: str, configured: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The rules that hold for the agent (host, allow, pattern), and of each host delay_ms and sitemaps; robots: host, text, one row a host.

    The group with the longest agent name inside `agent` counts, else the first for all agents. A delay counts where it is longer than the configured one; sitemaps are
    everybody's. A null or empty text allows all.
    """
    rows = robots.select("host", F.explode(F.pandas_udf(robots_rows, ROBOTS_ROWS)("text")).alias("r")).select("host", "r.*")
    fits = rows.withColumn("named", F.when(F.col("agent") == "*", F.lit(0)).when(F.lit(agent.lower()).contains(F.col("agent")), F.length("agent"))).where("named IS NOT NULL")
    best = fits.groupBy("host").agg(F.max_by("group", F.struct("named", -F.col("group"))).alias("group"))
    own = fits.join(best, ["host", "group"], "left_semi")
    delays = own.groupBy("host").agg(F.max("delay").alias("delay"))
    lines = F.regexp_extract_all(F.regexp_replace("text", r"#[^\n]*", ""), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:([^\n]*)$"), F.lit(1))
    maps = F.coalesce(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    longer = F.greatest(F.lit(configured), F.floor(F.coalesce("delay", F.lit(0.0)) * 1000).cast("int"))
    sites = robots.select("host", maps.alias("sitemaps")).join(delays, "host", "left").select("host", longer.alias("delay_ms"), "sitemaps")
    return own.where("pattern IS NOT NULL").select("host", "allow", "pattern").distinct(), sites


def robots_subject(url: Column) -> Column:
    """Path with query, which rules are about."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*(?:\?[^#]*)?)(?:#[\s\S]*)?\z", 1)
    return let(raw, lambda x: F.when((x == "") | x.startswith("?"), F.concat(F.lit("/"), x)).otherwise(x))


def rule_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url, host and other columns) with `allowed`, by rules (host, allow, pattern).

    The rule with the most characters besides * that fits decides; allow wins ties; no rule allows; what is no URL is denied. A rule is a row of its literal beginning, and beginnings of URLs, of the lengths
    that their host's rules have, are joined with them. So a host's many rules are looked up, not scanned. URLs of one host that are alike up to its longest rule without a * or a last $ have the same
    rules of this kind, so each such head is looked up once; rules with one, if there are any, are tried as expressions on distinct URLs. Rules and their lengths are written, so that
    the lengths of a few hosts are known to be few and URLs aren't shuffled by their host.
    """
    first = F.regexp_extract("pattern", r"^([^*]*?)(?=\*|\$\z|\z)", 1)
    rows = rules.where("pattern <> ''").select("host", "allow", first.alias("_begin"), F.when(F.length(first) < F.length("pattern"), rule_pattern(F.col("pattern"))).alias("_regex"), F.length(F.replace("pattern", F.lit("*"), F.lit(""))).alias("_weight"))
    rows = written(rows.withColumnRenamed("host", "_host"), "rules")
    lengths = rows.groupBy(F.col("_host").alias("host"), F.col("_regex").isNull().alias("_plain")).agg(F.collect_set(F.length("_begin")).alias("_lengths"))  # no more than the longest rule has characters
    lengths = written(lengths.where("host IS NOT NULL"), "rule-lengths")
    of = {own: lengths.where(F.col("_plain") == own).drop("_plain") for own in (True, False)}

    def best(asked: DataFrame, text: str, plain: bool) -> DataFrame:
        """host, text, and the best of its host's rules that begin it and fit it."""
        begun = asked.select("host", text).distinct().join(of[plain], "host").select("host", text, F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.length(text))
        found = begun.join(rows.where(F.col("_regex").isNull() == plain), (F.col("host") == F.col("_host")) & (F.left(text, F.col("_n")) == F.col("_begin")))
        fits = found if plain else found.where(F.call_function("rlike", F.col(text), F.col("_regex")))
        return fits.groupBy("host", text).agg(F.max(F.struct("_weight", "allow")).alias(f"{text}_best"))

    is_url = F.coalesce(F.col("url").rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]"), F.lit(False))
    longest = of[True].select("host", F.array_max("_lengths").alias("_longest"))
    asked = pages.join(longest, "host", "left").withColumn("_subject", robots_subject(F.col("url"))).withColumn("_ok", is_url)
    asked = asked.withColumn("_head", F.when(F.col("_longest").isNull(), F.col("_subject")).otherwise(F.left("_subject", F.col("_longest"))))
    found, verdicts = asked.join(best(asked, "_head", True), ["host", "_head"], "left"), [F.col("_head_best")]
    if not of[False].isEmpty():
        found, verdicts = found.join(best(asked, "_subject", False), ["host", "_subject"], "left"), [*verdicts, F.col("_subject_best")]
    decided = F.greatest(*verdicts)["allow"] if len(verdicts) > 1 else verdicts[0]["allow"]
    return found.withColumn("allowed", F.col("_ok") & F.coalesce(decided, F.lit(True))).select(*pages.columns, "allowed")


def robots_verdicts(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages (url, host and other columns) with `allowed`, by robots (host, text), one robots.txt a host; a host without one allows all."""
    return rule_verdicts(pages, robots_sites(robots, agent)[0])


def robots_allowed(url: Column, rules: list[tuple[bool, str]]) -> Column:
    """The rule with the most characters besides * decides; allow wins ties; no rule allows; no URL is denied."""
    subject = F.concat(path(url), part(url, 4))
    best = lambda allow: F.greatest(F.lit(-1), *[F.when(subject.rlike(robots_pattern(p)), len(p.replace("*", ""))).otherwise(-1) for a, p in rules if a == allow], F.lit(-1))
    return F.coalesce(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]") & (best(True) >= best(False)), F.lit(False))
