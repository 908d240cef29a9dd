"""JSON-LD, feeds, sitemaps and dates as column expressions. `base` is the address of the site that publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "https://example.org"
#: Schema.org types of sources.
SOURCE_TYPES = {
    "webpage": "WebPage", "pdf": "DigitalDocument", "academic-paper": "ScholarlyArticle", "press-release": "NewsArticle",
    "news-article": "NewsArticle", "government-document": "GovernmentDocument", "social-media": "SocialMediaPosting", "video": "VideoObject",
    "podcast": "PodcastEpisode", "book": "Book", "report": "Report", "other": "CreativeWork",
}

#: Schema.org types of entities.
ENTITY_TYPES = {
    "organization": "Organization", "person": "Person", "product": "Product", "project": "Project", "event": "Event", "place": "Place",
    "concept": "Thing", "other": "Thing",
}


def choose(key: Column, table: dict, default=None) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rfc_date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rating(status: Column) -> Column:
    return choose(status, {"asserted": 5, "disputed": 3, "corrected": 2}, 1)


def claim_json_ld(id_: Column, title: Column, statement: Column, status: Column, author: Column, created: Column, updated: Column, sources: Column, base: str = BASE) -> Column:
    """sources: an array of structs (id, title, url, publisher)."""
    work = lambda s: F.struct(
        F.lit("CreativeWork").alias("@type"), F.concat(F.lit(f"{base}/sources/"), s["id"]).alias("@id"), s["title"].alias("name"), s["url"].alias("url"),
        F.struct(F.lit("Organization").alias("@type"), s["publisher"].alias("name")).alias("publisher"),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("Claim").alias("@type"), F.concat(F.lit(f"{base}/claims/"), id_).alias("@id"),
            title.alias("name"), statement.alias("description"), created.alias("dateCreated"), updated.alias("dateModified"),
            F.struct(F.lit("Organization").alias("@type"), author.alias("name")).alias("author"),
            statement.alias("claimReviewed"), F.transform(sources, work).alias("appearance"),
            F.struct(
                F.lit("Rating").alias("@type"), rating(status).alias("ratingValue"), F.lit(5).alias("bestRating"), F.lit(1).alias("worstRating"),
                F.concat(F.lit("Claim status: "), status).alias("ratingExplanation"),
            ).alias("reviewRating"),
        )
    )


def source_json_ld(id_: Column, title: Column, url: Column, accessed: Column, published: Column, publisher: Column, type_: Column, author: Column, excerpt: Column, base: str = BASE) -> Column:
    """Fields that are null, and an empty author or excerpt, are left out."""
    person = F.when(author != "", F.struct(F.lit("Person").alias("@type"), author.alias("name")))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), choose(type_, SOURCE_TYPES, "CreativeWork").alias("@type"), F.concat(F.lit(f"{base}/sources/"), id_).alias("@id"),
            title.alias("name"), url.alias("url"), accessed.alias("dateAccessed"), published.alias("datePublished"),
            F.struct(F.lit("Organization").alias("@type"), publisher.alias("name")).alias("publisher"), person.alias("author"), F.nullif(excerpt, F.lit("")).alias("description"),
        )
    )


def entity_json_ld(slug: Column, name: Column, description: Column, type_: Column, site: Column, links: Column, parent: Column, children: Column, base: str = BASE) -> Column:
    """links: an array of URLs with nulls; parent: a struct (slug, name, type) or null; children: an array of such structs."""
    ref = lambda x: F.struct(choose(x["type"], ENTITY_TYPES, "Organization").alias("@type"), F.concat(F.lit(f"{base}/entities/"), x["slug"]).alias("@id"), x["name"].alias("name"))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), choose(type_, ENTITY_TYPES, "Thing").alias("@type"), F.concat(F.lit(f"{base}/entities/"), slug).alias("@id"),
            name.alias("name"), description.alias("description"), F.nullif(site, F.lit("")).alias("url"), F.filter(F.array_compact(links), lambda x: x != "").alias("sameAs"),
            F.when(parent.isNotNull(), ref(parent)).alias("parentOrganization"), F.when(F.size(children) > 0, F.transform(children, ref)).alias("subOrganization"),
        )
    )


def topic_json_ld(slug: Column, name: Column, description: Column, base: str = BASE) -> Column:
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("DefinedTerm").alias("@type"), F.concat(F.lit(f"{base}/topics/"), slug).alias("@id"),
            name.alias("name"), description.alias("description"),
        )
    )


def website_json_ld(name: str | Column, description: str | Column, base: str = BASE) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    publisher = F.struct(F.lit("Organization").alias("@type"), text(name).alias("name"))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("WebSite").alias("@type"), F.lit(base).alias("@id"), text(name).alias("name"),
            text(description).alias("description"), F.lit(base).alias("url"), publisher.alias("publisher"),
        )
    )


def script_tag(json: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), json, F.lit("</script>"))


def document(spark, head: str, lines: DataFrame, foot: str) -> DataFrame:
    """place, line: a document's head, its lines (order: any sortable column, line) and its foot; sorted by (place, order) it can be written as text of any size."""
    ends = spark.createDataFrame([(0, head), (2, foot)], "place int, line string").withColumn("order", F.lit(None).cast(lines.schema["order"].dataType))
    return ends.select("place", "order", "line").unionByName(lines.select(F.lit(1).alias("place"), "order", "line"))


def rss_document(spark, items: DataFrame, title: str, description: str, built: str, base: str = BASE) -> DataFrame:
    """items: order, line (rss_item)."""
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel>'
        f"<title>{title}</title><link>{base}</link><description>{description}</description><language>en-us</language><lastBuildDate>{built}</lastBuildDate>"
        f'<atom:link href="{base}/rss.xml" rel="self" type="application/rss+xml"/>'
    )
    return document(spark, head, items, "</channel></rss>")


SITEMAP = "http://www.sitemaps.org/schemas/sitemap/0.9"


def sitemap_document(spark, kind: str, entries: DataFrame, base: str = BASE) -> DataFrame:
    """entries: order, key, modified (text, or null for none)."""
    changed = F.when(F.col("modified").isNull(), F.lit("")).otherwise(F.concat(F.lit("<lastmod>"), F.col("modified"), F.lit("</lastmod>")))
    line = F.concat(F.lit(f"<url><loc>{base}/{kind}/"), F.col("key"), F.lit("</loc>"), changed, F.lit("<changefreq>weekly</changefreq><priority>0.9</priority></url>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{SITEMAP}"><url><loc>{base}/{kind}</loc><changefreq>daily</changefreq><priority>0.8</priority></url>'
    return document(spark, head, entries.select("order", line.alias("line")), "</urlset>")


def sitemap_index(kinds: list[str], base: str = BASE) -> str:
    listed = "".join(f"<sitemap><loc>{base}/sitemaps/{k}.xml</loc></sitemap>" for k in kinds)
    return f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{SITEMAP}">{listed}</sitemapindex>'


def sitemap_index_document(spark, counts: DataFrame, most: int = 50_000, base: str = BASE) -> DataFrame:
    """The index of the sitemaps of each kind that has records (counts: kind, n); a kind of more than `most` entries has several, numbered from 1 after the first."""
    files = counts.where("n > 0").select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("k"))
    name = F.concat("kind", F.when(F.col("k") == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("k").cast("string"))))
    line = F.concat(F.lit(f"<sitemap><loc>{base}/sitemaps/"), name, F.lit(".xml</loc></sitemap>"))
    return document(spark, f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{SITEMAP}">', files.select(F.struct("kind", "k").alias("order"), line.alias("line")), "</sitemapindex>")


def llms_text(counts: DataFrame, title: str, about: str, base: str = BASE) -> DataFrame:
    """One row, body: what the site holds (counts: kind, n), where it is, and how its addresses are made."""
    lines = counts.agg(F.array_sort(F.collect_list(F.struct("kind", F.concat(F.lit("- "), F.col("n").cast("string"), F.lit(" "), F.col("kind")).alias("line"))))["line"].alias("lines"))
    pages = "\n".join(f"- {name}: {base}/{path}" for name, path in (("Claims", "claims"), ("Entities", "entities"), ("Sources", "sources"), ("Corrections", "corrections"), ("Feed", "rss.xml"), ("Sitemap", "sitemap.xml")))
    shapes = "\n".join(f"- {name}: {base}/{path}" for name, path in (("claim", "claims/{claim_id}"), ("entity", "entities/{entity_slug}"), ("source", "sources/{source_id}")))
    return lines.select(F.concat(F.lit(f"# {title}\n\n> {about}\n\n## Content\n\n"), F.array_join("lines", "\n"), F.lit(f"\n\n## Key URLs\n\n{pages}\n\n## URL Patterns\n\n{shapes}\n")).alias("body"))


def shown_url(url: Column) -> Column:
    return F.regexp_replace(url, "https?://", "")


def rss_item(id_: Column, title: Column, statement: Column, status: Column, updated: Column, base: str = BASE) -> Column:
    link = F.concat(F.lit(f"{base}/claims/"), id_)
    return F.concat(
        F.lit("<item><title>"), escape_xml(title), F.lit("</title><link>"), link, F.lit('</link><guid isPermaLink="true">'), link, F.lit("</guid><description>"),
        escape_xml(statement), F.lit("</description><pubDate>"), rfc_date(updated), F.lit("</pubDate><category>"), status, F.lit("</category></item>"),
    )


def sitemap_url(kind: str, key: Column, modified: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"<url><loc>{base}/{kind}/"), key, F.lit("</loc><lastmod>"), modified, F.lit("</lastmod></url>"))


def relative_time(ts: Column, as_of: Column) -> Column:
    """just now, minutes, hours, days under a week, else the date."""
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(60_000_000))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m")).when(hours < 24, say(hours, "h")).when(days < 7, say(days, "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
