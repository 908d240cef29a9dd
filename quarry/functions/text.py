"""HTML and text as column expressions: cleaning, metadata, page type, links, entities. Built-in functions only.

Patterns are written in the common part of Java's and RE2's syntax, so that they read the same in an oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the pages' scripting language, as a character class.
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Elements and classes that hold no content.
DROPPED_ELEMENTS = ["nav", "header", "footer", "aside", "noscript", "iframe", "form", "svg", "canvas"]
DROPPED_CLASSES = "nav|menu|sidebar|footer|header|cookie|banner|popup|modal|advertisement|ad-|ads-"
#: Named entities, decoded one after another in this order.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&bull;", "•"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
]
#: Page types in order of precedence, with path patterns and title parts.
PAGE_TYPES = [
    ("about", r"/(about|company|who-we-are|our-story|mission|values)", ["about us", "our company", "who we are"]),
    ("team", r"/(team|leadership|people|management|executives|staff|our-team)", ["our team", "leadership", "management team"]),
    ("product", r"/(product|service|solution|offering|platform|feature)", ["product", "service", "solution"]),
    ("news", r"/(news|press|blog|article|post|stories|media|announcement)", ["news", "press release", "blog"]),
    ("contact", r"/(contact|get-in-touch|reach-us|connect|inquiry)", ["contact", "get in touch"]),
    ("legal", r"/(privacy|terms|legal|policy|disclaimer|cookie|gdpr|ccpa)", ["privacy policy", "terms of", "legal"]),
]
#: (pattern, replacement group or text) in order. The class pattern hands back the element start that ends it.
CLEANING = [
    (r"(?i)<script\b[\s\S]*?</script>", " "),
    (r"(?i)<style\b[\s\S]*?</style>", " "),
    *[(rf"(?i)<{e}\b[^>]*>[\s\S]*?</{e}>", " ") for e in DROPPED_ELEMENTS],
    (rf"(?i)class\s*=\s*[\"'][^\"']*(?:{DROPPED_CLASSES})[^\"']*[\"'][^>]*>[\s\S]*?(<(?:div|section|article|main|body)|\z)", " {1}"),
    (r"<!--[\s\S]*?-->", " "),
    (r"(?i)</(?:p|div|h[1-6]|li|tr|br|hr)>", "\n"),
    (r"(?i)<(?:br|hr)\s*/?>", "\n"),
    (r"<[^>]+>", " "),
]


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def _numeric(text: Column, pattern: str, base: int) -> Column:
    """Numeric entities as UTF-16 code units, modulo 2^16; a unit that is half a pair becomes U+FFFD."""
    unit = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.conv(x, base, 10).cast("long") % 65536), 4, "0")), "UTF-16BE")

    def decoded(t: Column) -> Column:
        codes, parts = F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.split(t, pattern, -1)
        return F.array_join(F.zip_with(parts, codes, lambda p, c: F.concat(p, F.coalesce(unit(c), F.lit("")))), "")

    return let(text, lambda t: F.when(t.contains("&#"), decoded(t)).otherwise(t))


def decode_entities(text: Column) -> Column:
    """Named entities, then decimal, then hexadecimal ones; unknown names stay."""

    def decoded(t: Column) -> Column:
        for name, char in ENTITIES:
            t = F.regexp_replace(t, f"(?i){name}", char)
        return _numeric(_numeric(t, r"&#(\d+);", 10), r"(?i)&#x([0-9a-f]+);", 16)

    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def clean_text(html: Column) -> Column:
    """The visible text, one line per block, without empty lines."""
    for pattern, to in CLEANING:
        html = F.regexp_replace(html, pattern, to.replace("{1}", "$1"))
    lines = F.split(decode_entities(html), "\n")
    lines = F.transform(lines, lambda x: js_trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match; null without a match (an empty group stays empty)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def meta_content(html: Column, name: str) -> Column:
    """Content of a meta element by name or property, in either order of attributes."""
    forms = [
        rf"(?i)<meta[^>]+name\s*=\s*[\"']{name}[\"'][^>]+content\s*=\s*[\"']([^\"']*)[\"']",
        rf"(?i)<meta[^>]+content\s*=\s*[\"']([^\"']*)[\"'][^>]+name\s*=\s*[\"']{name}[\"']",
        rf"(?i)<meta[^>]+property\s*=\s*[\"']{name}[\"'][^>]+content\s*=\s*[\"']([^\"']*)[\"']",
        rf"(?i)<meta[^>]+content\s*=\s*[\"']([^\"']*)[\"'][^>]+property\s*=\s*[\"']{name}[\"']",
    ]
    return decode_entities(F.coalesce(*[first_group(html, f) for f in forms]))


def filled(value: Column) -> Column:
    """value, or null if it is empty."""
    return let(value, lambda v: F.when(v != "", v))


def page_title(html: Column) -> Column:
    own = decode_entities(js_trim(first_group(html, r"(?i)<title[^>]*>([^<]*)</title>")))
    return F.coalesce(filled(meta_content(html, "og:title")), own, F.lit(""))


def page_language(html: Column) -> Column:
    return first_group(html, r"(?i)<html[^>]+lang\s*=\s*[\"']([^\"']*)[\"']")


def page_metadata(html: Column) -> Column:
    """A struct of title, description, canonical URL, language, Open Graph fields, author and dates."""
    empty = F.lit("")
    either = lambda a, b: F.coalesce(filled(meta_content(html, a)), meta_content(html, b))
    return F.struct(
        page_title(html).alias("title"),
        F.coalesce(filled(meta_content(html, "og:description")), meta_content(html, "description"), empty).alias("description"),
        F.coalesce(
            first_group(html, r"(?i)<link[^>]+rel\s*=\s*[\"']canonical[\"'][^>]+href\s*=\s*[\"']([^\"']*)[\"']"),
            first_group(html, r"(?i)<link[^>]+href\s*=\s*[\"']([^\"']*)[\"'][^>]+rel\s*=\s*[\"']canonical[\"']"),
        ).alias("canonicalUrl"),
        meta_content(html, "og:image").alias("ogImage"),
        meta_content(html, "og:type").alias("ogType"),
        page_language(html).alias("language"),
        meta_content(html, "author").alias("author"),
        either("article:published_time", "datePublished").alias("publishedDate"),
        either("article:modified_time", "dateModified").alias("modifiedDate"),
    )


def page_type(path: Column, title: Column, og_type: Column) -> Column:
    """The first type whose path pattern or title part fits; a root path is the homepage."""

    def chosen(path: Column, title: Column) -> Column:
        out = F.when((path == "/") | (path == ""), "homepage")
        for name, pattern, parts in PAGE_TYPES:
            hit = path.rlike(pattern)
            for part in parts:
                hit = hit | title.contains(part)
            if name == "news":
                hit = hit | F.coalesce(og_type == "article", F.lit(False))
            out = out.when(hit, name)
        return out.otherwise("other")

    return let(F.lower(path), lambda p: let(F.lower(title), lambda t: chosen(p, t)))


def json_ld(html: Column) -> Column:
    """The JSON of all ld+json scripts as one string: null for none that parses, the object for one, an array for more."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]+type\s*=\s*[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"), F.lit(1))
    good = F.filter(F.transform(blocks, js_trim), lambda x: F.try_parse_json(x).isNotNull())
    joined = F.concat(F.lit("["), F.array_join(good, ","), F.lit("]"))
    return F.when(F.size(good) == 0, F.lit(None)).when(F.size(good) == 1, F.element_at(good, 1)).otherwise(joined)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)
